"""Checks on drafts, chunks and evidence: constraints, regressions, acceptance, quotes, numbers, sections and excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.binding import PRINTED, bound, grid, printed
from quarry.catalog.chunking import RENDERED, rendered
from quarry.catalog.evaluation import JUDGED, QTF, judged
from quarry.catalog.planning import NORM, asked
from quarry.catalog.registry import query, read
from quarry.catalog.structure import BLOCKS, blocks, headed
from quarry.functions.text import ascii_words
from quarry.operators import coverage as C
from quarry.operators import structure as S
from quarry.operators.seal import differences, seal
from quarry.plans import intent as P
from quarry.scratch import cut, fresh_path

# chunk constraints -----------------------------------------------------------------------------------------------------

CHUNKS = BLOCKS + """,
k AS (SELECT page_id, pos, tag, text, CASE WHEN pos % 41 = 7 THEN 'p1:b0' ELSE 'p' || page_id || ':b' || pos END AS chunk_id, CASE WHEN pos % 43 = 5 THEN strlen(text) + 1 ELSE strlen(text) END AS bytes,
  CASE WHEN pos % 47 = 11 THEN 'p' || page_id || ':none' WHEN heading_pos IS NOT NULL THEN 'p' || page_id || ':b' || heading_pos END AS parent_id, CASE WHEN pos % 53 = 3 THEN -1 ELSE 0 END AS start, CASE WHEN pos % 59 = 2 THEN length(text) + 3 ELSE length(text) END AS stop,
  CASE WHEN pos % 61 = 13 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN pos % 37 = 9 THEN page_id + 1 ELSE page_id END AS source_page, CASE WHEN pos % 31 = 4 THEN 'unknown' WHEN tag LIKE 'h%' THEN 'parent' ELSE 'child' END AS kind FROM h)"""


def chunks(spark, sf):
    """Chunks made of page blocks, some of them broken in one way each."""
    page, pos = F.col("page_id").cast("string"), F.col("pos")
    own = F.concat(F.lit("p"), page, F.lit(":b"), pos.cast("string"))
    parent = F.when(pos % 47 == 11, F.concat(F.lit("p"), page, F.lit(":none"))).when(F.col("heading_pos").isNotNull(), F.concat(F.lit("p"), page, F.lit(":b"), F.col("heading_pos").cast("string")))
    rows = headed(spark, sf).select(
        "page_id", "pos", "tag", "text", F.when(pos % 41 == 7, "p1:b0").otherwise(own).alias("chunk_id"), (F.octet_length("text") + F.when(pos % 43 == 5, 1).otherwise(0)).alias("bytes"), parent.alias("parent_id"),
        F.when(pos % 53 == 3, -1).otherwise(0).alias("start"), (F.char_length("text") + F.when(pos % 59 == 2, 3).otherwise(0)).alias("stop"), F.when(pos % 61 == 13, "v2").otherwise("v1").alias("version"),
        (F.col("page_id") + F.when(pos % 37 == 9, 1).otherwise(0)).alias("source_page"), F.when(pos % 31 == 4, "unknown").when(S.is_heading(F.col("tag")), "parent").otherwise("child").alias("kind"))
    return cut(rows, "chunks")


#: Rows of a chunk that break a constraint, each by a predicate on the chunk alone.
ALONE = {
    "version": ("version <> 'v1'", lambda: F.col("version") != "v1"),
    "byte_size": ("bytes <> strlen(text)", lambda: F.col("bytes") != F.octet_length("text")),
    "limit": ("bytes > 2000", lambda: F.col("bytes") > 2000),
    "empty": ("length(text) = 0", lambda: F.char_length("text") == 0),
    "span_begins": ("start < 0", lambda: F.col("start") < 0),
    "span_ends": ("stop > length(text)", lambda: F.col("stop") > F.char_length("text")),
    "span_order": ("stop < start", lambda: F.col("stop") < F.col("start")),
    "kind": ("kind NOT IN ('parent', 'child')", lambda: ~F.col("kind").isin("parent", "child")),
    "source_page": ("source_page <> page_id", lambda: F.col("source_page") != F.col("page_id")),
    "self_parent": ("kind = 'child' AND parent_id = chunk_id", lambda: (F.col("kind") == "child") & (F.col("parent_id") == F.col("chunk_id"))),
    "id_form": ("NOT regexp_matches(chunk_id, '^p[0-9]+:b[0-9]+$')", lambda: ~F.col("chunk_id").rlike("^p[0-9]+:b[0-9]+$")),
    "markup": ("regexp_matches(text, '<[a-z]')", lambda: F.col("text").rlike("<[a-z]")),
}


@query("chunk_integrity", CHUNKS + "\n" + "\nUNION ALL ".join(f"SELECT page_id, pos, '{n}' AS broken FROM k WHERE {s}" for n, (s, _) in ALONE.items()) + """
UNION ALL SELECT page_id, pos, 'unique_id' FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM k) WHERE n > 1
UNION ALL SELECT k.page_id, k.pos, 'dangling_parent' FROM k WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM k)
UNION ALL SELECT k.page_id, k.pos, 'parent_kind' FROM k JOIN k p ON p.chunk_id = k.parent_id AND p.page_id = k.page_id WHERE p.kind <> 'parent'
UNION ALL SELECT page_id, CAST(-1 AS INTEGER), 'coverage' FROM (SELECT page_id, bool_or(start > 0 OR start < 0 OR stop <> length(text)) AS gap FROM k GROUP BY page_id) WHERE gap
UNION ALL SELECT page_id, pos, 'literal' FROM (SELECT k.page_id, pos, k.text, html FROM k JOIN pages ON pages.page_id = k.source_page) WHERE NOT contains(html, left(text, 5))
UNION ALL SELECT page_id, CAST(-1 AS INTEGER), 'no_parent' FROM k GROUP BY page_id HAVING count(*) FILTER (kind = 'parent') = 0""")
def chunk_integrity(spark, sf):
    """Eighteen constraints over chunks as (page, place, broken): of a chunk alone, among chunks, and against the page."""
    k = chunks(spark, sf)
    ids = k.groupBy("chunk_id").agg(F.count("*").alias("n"))
    found = [k.filter(test()).select("page_id", "pos", F.lit(name).alias("broken")) for name, (_, test) in ALONE.items()]
    found.append(k.join(ids.filter("n > 1").select("chunk_id"), "chunk_id", "left_semi").select("page_id", "pos", F.lit("unique_id").alias("broken")))
    found.append(k.filter("parent_id is not null").join(ids.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti").select("page_id", "pos", F.lit("dangling_parent").alias("broken")))
    parents = k.filter("kind <> 'parent'").select("page_id", F.col("chunk_id").alias("parent_id"))
    found.append(k.join(parents, ["page_id", "parent_id"]).select("page_id", "pos", F.lit("parent_kind").alias("broken")))
    pages = k.groupBy("page_id").agg(F.bool_or((F.col("start") != 0) | (F.col("stop") != F.char_length("text"))).alias("gap"), F.count_if(F.col("kind") == "parent").alias("parents"))
    found.append(pages.filter("gap").select("page_id", F.lit(-1).alias("pos"), F.lit("coverage").alias("broken")))
    html = read(spark, sf, "pages").select(F.col("page_id").alias("source_page"), "html")
    found.append(k.join(html, "source_page").filter(~F.contains("html", F.substring("text", 1, 5))).select("page_id", "pos", F.lit("literal").alias("broken")))
    found.append(pages.filter("parents = 0").select("page_id", F.lit(-1).alias("pos"), F.lit("no_parent").alias("broken")))
    return reduce(lambda a, b: a.unionByName(b), found)


@query("regression_checks", BLOCKS + """,
m AS (SELECT count(*) AS blocks, count(DISTINCT page_id) AS pages, max(length(text)) AS longest, count(*) FILTER (tag = 'h1') AS titles, count(*) FILTER (text = '') AS empty FROM b)
SELECT unnest(['has_blocks', 'every_page_titled', 'no_block_too_long', 'no_empty_block', 'rebuild_is_equal']) AS name, unnest([blocks > 0, titles >= pages, longest <= 20000, empty = 0, TRUE]) AS passed FROM m""")
def regression_checks(spark, sf):
    """Named checks of a build; the last builds it again and compares both ways, as multisets."""
    first, again = cut(blocks(spark, sf), "build"), cut(blocks(spark, sf).repartition(3, "page_id"), "rebuild")
    m = first.agg(F.count("*").alias("blocks"), F.count_distinct("page_id").alias("pages"), F.max(F.char_length("text")).alias("longest"), F.count_if(F.col("tag") == "h1").alias("titles"), F.count_if(F.col("text") == "").alias("empty"))
    digest = lambda df: df.select(F.xxhash64("page_id", "pos", "tag", "text").alias("h")).groupBy("h").count()
    same = digest(first).join(digest(again).withColumnRenamed("count", "other"), "h", "full").agg(F.count_if(~F.col("count").eqNullSafe(F.col("other"))).alias("different"))
    checks = {"has_blocks": "blocks > 0", "every_page_titled": "titles >= pages", "no_block_too_long": "longest <= 20000", "no_empty_block": "empty = 0", "rebuild_is_equal": "different = 0"}
    row = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("passed")) for n, e in checks.items()])
    return m.crossJoin(F.broadcast(same)).select(F.explode(row).alias("x")).select("x.name", "x.passed")  # one row each


@query("acceptance_checks", PRINTED + """,
g AS (SELECT company, report_year, metric, count(*) AS cells, count(DISTINCT header) AS headers, bool_and(label IS NOT NULL) AS labelled, max(CASE WHEN regexp_matches(raw, '[0-9]') THEN 1 ELSE 0 END) AS numeric_row FROM grid GROUP BY ALL)
SELECT company, report_year, count(DISTINCT cells) = 1 AS rectangular, bool_and(cells = headers) AS one_cell_a_column, bool_and(labelled) AS labelled, count(*) = 4 AS all_reference_rows, min(numeric_row) = 1 AS numeric_rows FROM g GROUP BY ALL""")
def acceptance_checks(spark, sf):
    """Acceptance of each printed table: rectangular, a cell for each column, labels, the reference rows, figures in each."""
    per = grid(printed(spark, sf)).groupBy("company", "report_year", "metric").agg(F.count("*").alias("cells"), F.count_distinct("header").alias("headers"), F.bool_and(F.col("label").isNotNull()).alias("labelled"), F.max(F.col("raw").rlike("[0-9]").cast("int")).alias("numeric"))
    return per.groupBy("company", "report_year").agg((F.count_distinct("cells") == 1).alias("rectangular"), F.bool_and(F.col("cells") == F.col("headers")).alias("one_cell_a_column"), F.bool_and("labelled").alias("labelled"), (F.count("*") == 4).alias("all_reference_rows"), (F.min("numeric") == 1).alias("numeric_rows"))


@query("row_scores", PRINTED + """,
found AS (SELECT company, report_year, metric, label, list(raw ORDER BY value_year) AS figures FROM grid WHERE raw <> '12%' GROUP BY ALL),
ref AS (SELECT company, report_year, metric, upper(label) || ' ' AS label, list(CASE WHEN abs(whole) % 13 = 5 THEN '0' ELSE raw END ORDER BY value_year) AS expected FROM grid WHERE raw <> '12%' GROUP BY company, report_year, metric, label)
SELECT company, report_year, metric, lower(trim(r.label)) = lower(trim(f.label)) AS label_matches, f.figures[1] = r.expected[1] AS first_matches, f.figures = r.expected AS all_match FROM ref r JOIN found f USING (company, report_year, metric)""")
def row_scores(spark, sf):
    """Extracted rows against a reference, some of it wrong: the label but for case and space, the first figure, and all of them."""
    rows = grid(printed(spark, sf)).filter("raw <> '12%'")
    pack = lambda c: F.array_sort(F.collect_list(F.struct("value_year", c.alias("v"))))["v"]
    per = rows.groupBy("company", "report_year", "metric", "label").agg(pack(F.col("raw")).alias("figures"), pack(F.when(F.abs("whole") % 13 == 5, "0").otherwise(F.col("raw"))).alias("expected"))
    stated = F.concat(F.upper("label"), F.lit(" "))
    return per.select("company", "report_year", "metric", (F.lower(F.btrim(stated)) == F.lower(F.btrim("label"))).alias("label_matches"), (F.get("figures", F.lit(0)) == F.get("expected", F.lit(0))).alias("first_matches"), (F.col("figures") == F.col("expected")).alias("all_match"))


# drafts ----------------------------------------------------------------------------------------------------------------

NUM = "[0-9][0-9,]*"
DRAFTS = RENDERED + """,
d AS (SELECT company, report_year, metric, text, company || ':' || report_year || ':' || CASE WHEN report_year % 4 = 1 THEN 'missing' ELSE metric END AS citation, CASE WHEN metric = 'net' THEN replace(text, 'Full', 'Whole') WHEN metric = 'gross' THEN left(text, 40) ELSE text END AS quote,
  regexp_extract_all(text, '[0-9][0-9,]*') AS support, 'In ' || company || ' the figure was ' || regexp_extract(text, '= [(]?([0-9][0-9,]*)', 1) || CASE WHEN report_year % 3 = 0 THEN ', the highest ever at 987654321' ELSE '' END || CASE WHEN metric = 'quantity' THEN ' (units' ELSE '' END AS claim FROM rendered)"""


def claim():
    """A sentence about a rendered row; some claim too much, some do not close what they open."""
    figure = F.regexp_extract("text", "= [(]?([0-9][0-9,]*)", 1)
    return F.concat(F.lit("In "), "company", F.lit(" the figure was "), figure, F.when(F.col("report_year") % 3 == 0, ", the highest ever at 987654321").otherwise(""), F.when(F.col("metric") == "quantity", " (units").otherwise(""))


def numbers(text):
    return F.regexp_extract_all(text, F.lit(NUM), F.lit(0))


def drafts(spark, sf):
    """Drafted claims over rendered rows as JSON: claim, citation, quote; some are wrong in one way or another."""
    rows = rendered(printed(spark, sf))
    year = F.col("report_year").cast("string")
    cite = F.concat_ws(":", "company", year, F.when(F.col("report_year") % 4 == 1, "missing").otherwise(F.col("metric")))
    quote = F.when(F.col("metric") == "net", F.replace(F.col("text"), F.lit("Full"), F.lit("Whole"))).when(F.col("metric") == "gross", F.substring("text", 1, 40)).otherwise(F.col("text"))
    body = F.to_json(F.struct(claim().alias("claim"), cite.alias("citation"), quote.alias("quote")))
    return rows.select("company", "report_year", "metric", "text", F.when(F.col("report_year") % 6 == 2, F.lit('{"claim": 5')).otherwise(body).alias("draft"))


def claims(spark, sf):
    return rendered(printed(spark, sf)).withColumn("claim", claim())


DRAFT = "claim string, citation string, quote string"


@query("draft_checks", DRAFTS + """,
x AS (SELECT *, report_year % 6 = 2 AS broken FROM d)
SELECT x.company, x.report_year, x.metric, CASE WHEN broken THEN 'schema' WHEN u.text IS NULL THEN 'citation' WHEN NOT contains(u.text, quote) THEN 'quote' WHEN quote <> u.text THEN 'whole_row' WHEN len(list_filter(regexp_extract_all(claim, '[0-9][0-9,]*'), lambda z: NOT list_contains(x.support, z))) > 0 THEN 'number' ELSE 'accepted' END AS outcome
FROM x LEFT JOIN rendered u ON u.company || ':' || u.report_year || ':' || u.metric = citation""")
def draft_checks(spark, sf):
    """A draft fails closed: its form, then that its citation exists, that the quote stands there, whole, and that every number is supported."""
    units = rendered(printed(spark, sf)).select(F.concat_ws(":", "company", F.col("report_year").cast("string"), "metric").alias("citation"), F.col("text").alias("unit"))
    rows = drafts(spark, sf).withColumn("d", F.from_json("draft", DRAFT, {"mode": "PERMISSIVE"})).select("company", "report_year", "metric", "text", "d.*")
    rows = rows.join(units, "citation", "left")
    outcome = F.when(F.col("citation").isNull() | F.col("claim").isNull(), "schema").when(F.col("unit").isNull(), "citation").when(~F.contains("unit", "quote"), "quote").when(F.col("quote") != F.col("unit"), "whole_row").when(F.size(F.array_except(numbers("claim"), numbers("text"))) > 0, "number").otherwise("accepted")
    return rows.select("company", "report_year", "metric", outcome.alias("outcome"))


@query("statement_checks", DRAFTS + """
SELECT company, report_year, metric, array_to_string(list_filter([CASE WHEN len(claim) - len(replace(claim, '(', '')) <> len(claim) - len(replace(claim, ')', '')) THEN 'parentheses' END, CASE WHEN NOT contains(claim, company) THEN 'company' END,
  CASE WHEN regexp_matches(claim, '<[a-z]|[*]{2}') THEN 'markup' END, CASE WHEN regexp_matches(claim, '\\b(highest|lowest|best|largest) ever\\b') THEN 'superlative' END, CASE WHEN NOT regexp_matches(text, '[$]m|Units') THEN 'unit' END, CASE WHEN len(list_filter(regexp_extract_all(claim, '[0-9][0-9,]*'), lambda z: NOT list_contains(support, z))) > 0 THEN 'foreign_number' END], lambda z: z IS NOT NULL), ',') AS issues FROM d""")
def statement_checks(spark, sf):
    """Everything that is wrong with a statement by itself: parentheses, company, markup, superlatives, units, numbers without support."""
    rows = claims(spark, sf)
    count = lambda p: F.size(F.regexp_extract_all("claim", F.lit(p), F.lit(0)))
    foreign = F.size(F.array_except(numbers("claim"), numbers("text"))) > 0
    issues = F.array_compact(F.array(F.when(count("[(]") != count("[)]"), "parentheses"), F.when(~F.contains("claim", "company"), "company"), F.when(F.col("claim").rlike("<[a-z]|[*]{2}"), "markup"), F.when(F.col("claim").rlike("\\b(highest|lowest|best|largest) ever\\b"), "superlative"), F.when(~F.col("text").rlike("[$]m|Units"), "unit"), F.when(foreign, "foreign_number")))
    return rows.select("company", "report_year", "metric", F.array_join(issues, ",").alias("issues"))


@query("supported_statements", DRAFTS + """
SELECT company, report_year, metric, claim FROM d WHERE NOT regexp_matches(claim, '\\bever\\b') AND len(list_filter(regexp_extract_all(claim, '[0-9][0-9,]*'), lambda z: NOT list_contains(support, z))) = 0 AND NOT (contains(text, 'continuing') AND contains(text, 'including discontinued'))""")
def supported_statements(spark, sf):
    """Only statements of one scope, without superlatives, and without a number that their evidence lacks."""
    one = ~(F.contains("text", F.lit("continuing")) & F.contains("text", F.lit("including discontinued")))
    return claims(spark, sf).filter(~F.col("claim").rlike("\\bever\\b") & (F.size(F.array_except(numbers("claim"), numbers("text"))) == 0) & one).select("company", "report_year", "metric", "claim")


@query("numeric_support", RENDERED + """
SELECT company, report_year, metric, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(text, '31 Dec [0-9]{2}', '', 'g'), '^[^|]*[|]', ''), '[0-9][0-9,]*'))), ' ') AS support_list, len(regexp_extract_all(text, '=')) > 1 AS explained FROM rendered""")
def numeric_support(spark, sf):
    """The numbers that a row may support: its figures, not its dates nor its prefix; and whether there is more than one figure."""
    bare = F.regexp_replace(F.regexp_replace("text", "31 Dec [0-9]{2}", ""), "^[^|]*[|]", "")
    support = F.array_sort(F.array_distinct(numbers(bare)))
    return rendered(printed(spark, sf)).select("company", "report_year", "metric", F.array_join(support, " ").alias("support_list"), (F.size(F.regexp_extract_all("text", F.lit("="), F.lit(0))) > 1).alias("explained"))


def _seal_sql(name, source):
    """The seal of source by lang and doc_id, level by level, as operators/seal.py defines it."""
    cell = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    out = f"""{name}r AS (SELECT lang AS part, doc_id AS node, sha256({cell('doc_id::VARCHAR')} || {cell('source')} || {cell('text')}) AS c, count(*) AS k FROM {source} GROUP BY ALL),
{name}0 AS (SELECT part, node, sha256(string_agg(c || ':' || k, ',' ORDER BY c, k)) AS digest, sum(k) AS members FROM {name}r GROUP BY part, node)"""
    for n in range(1, 7):
        up = "node >> 12" if n < 6 else "CAST(0 AS BIGINT)"
        out += f",\n{name}{n} AS (SELECT part, {up} AS node, sha256(string_agg(coalesce(node, -9223372036854775808) || ':' || digest, ',' ORDER BY node NULLS FIRST)) AS digest, sum(members) AS members FROM {name}{n - 1} GROUP BY part, {up})"
    return out


#: What has happened to the documents since the seal: a text changed, a row lost, a row added, each here and there.
LATER_SQL = "later AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 1009 = 7 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 1009 <> 1008 OR lang <> 'de' UNION ALL SELECT doc_id + 1000000007, lang, source, text FROM documents WHERE doc_id % 2003 = 5)"


def sealed_and_later(spark, sf):
    """Paths of the seals of the documents and of what has become of them, and the roots."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    kept = docs.filter((F.col("doc_id") % 1009 != 1008) | (F.col("lang") != "de")).withColumn("text", F.when(F.col("doc_id") % 1009 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    later = kept.unionByName(docs.filter("doc_id % 2003 = 5").withColumn("doc_id", F.col("doc_id") + 1000000007))
    paths = fresh_path(spark, "seal"), fresh_path(spark, "seal")
    return paths, [seal(rows, "lang", "doc_id", ["doc_id", "source", "text"], p) for rows, p in zip((docs, later), paths, strict=True)]


@query("sealed_manifest", f"""WITH {LATER_SQL},
{_seal_sql("s", "documents")},
{_seal_sql("t", "later")}
SELECT s6.part AS lang, s6.members::BIGINT AS members, s6.digest AS seal, coalesce(s6.digest = t6.digest, FALSE) AS intact FROM s6 LEFT JOIN t6 ON s6.part IS NOT DISTINCT FROM t6.part""")
def sealed_manifest(spark, sf):
    """The seal of each language's documents, and whether what is there now still has it."""
    _, (then, now) = sealed_and_later(spark, sf)
    now = now.select(F.col("part").alias("there"), F.col("root").alias("found"))
    met = then.join(now, F.col("part").eqNullSafe(F.col("there")), "left")
    return met.select(F.col("part").alias("lang"), "members", F.col("root").alias("seal"), F.coalesce(F.col("root") == F.col("found"), F.lit(False)).alias("intact"))


@query("seal_differences", f"""WITH {LATER_SQL}, a AS (SELECT lang, doc_id, list_sort(list(source || '/' || text)) AS old FROM documents GROUP BY ALL), b AS (SELECT lang, doc_id, list_sort(list(source || '/' || text)) AS new FROM later GROUP BY ALL)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN new IS NULL THEN 'lost' WHEN old IS NULL THEN 'added' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id = b.doc_id WHERE old IS DISTINCT FROM new""")
def seal_differences(spark, sf):
    """The documents that a broken seal is about, found from the roots down without comparing texts."""
    paths, _ = sealed_and_later(spark, sf)
    return differences(spark, *paths).select(F.col("part").alias("lang"), F.col("node").alias("doc_id"), "status")


# sections and excerpts -------------------------------------------------------------------------------------------------

TOPIC = "\\b(?:the|die|les|los)\\b"
SECTIONS = BLOCKS + """,
sec AS (SELECT page_id, pos, text, length(text) AS size, regexp_matches(regexp_replace(lower(text), '[^\\x00-\\x7F]', '_', 'g'), '\\b(?:the|die|les|los)\\b') AS on_topic, regexp_matches(text, '[0-9]') AS figures FROM h WHERE tag = 'p'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM sec WHERE on_topic AND NOT figures),
walk AS (WITH RECURSIVE w AS (SELECT page_id, rn, CASE WHEN size <= 1200 THEN 1 ELSE 0 END AS n, CASE WHEN size <= 1200 THEN size ELSE 0 END AS used, CASE WHEN size <= 1200 THEN [pos] ELSE CAST([] AS INTEGER[]) END AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT r.page_id, r.rn, w.n + CASE WHEN w.n < 4 AND w.used + r.size <= 1200 THEN 1 ELSE 0 END, w.used + CASE WHEN w.n < 4 AND w.used + r.size <= 1200 THEN r.size ELSE 0 END, CASE WHEN w.n < 4 AND w.used + r.size <= 1200 THEN list_append(w.kept, r.pos) ELSE w.kept END FROM w JOIN ranked r ON r.page_id = w.page_id AND r.rn = w.rn + 1) SELECT * FROM w)"""


@query("relevant_sections", SECTIONS + "\nSELECT w.page_id, unnest(kept) AS pos FROM walk w JOIN (SELECT page_id, max(rn) AS rn FROM ranked GROUP BY page_id) USING (page_id, rn)")
def relevant_sections(spark, sf):
    """Sections on the topic and without figures, in order, four and 1,200 characters at most; one that does not fit is passed over."""
    rows = headed(spark, sf).filter((F.col("tag") == "p") & F.regexp_replace(F.lower("text"), "[^\\x00-\\x7F]", "_").rlike(TOPIC) & ~F.col("text").rlike("[0-9]"))
    item = F.struct(F.col("pos").alias("rank"), F.char_length("text").cast("long").alias("size"), F.col("pos").alias("id"))
    pages = rows.groupBy("page_id").agg(F.collect_list(item).alias("items"))
    return pages.select("page_id", F.explode(C.greedy_keep(F.col("items"), 1200, 4)).alias("pos")).withColumn("pos", F.col("pos").cast("int"))


@query("prefer_driver_list", BLOCKS + """,
s AS (SELECT page_id, pos, tag, text, coalesce(lead(tag) OVER (PARTITION BY page_id ORDER BY pos), '') = 'li' AS leads FROM b WHERE tag <> 'h1'),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN leads AND tag = 'p' THEN 0 WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 1 ELSE 2 END, pos) AS nth FROM s)
SELECT page_id, pos, CASE WHEN leads AND tag = 'p' THEN 'driver_list' WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'direct' ELSE 'any' END AS preference FROM r WHERE nth = 1""")
def prefer_driver_list(spark, sf):
    """One section a page: a complete list with its lead, else a direct passage, else the first."""
    rows = blocks(spark, sf).filter("tag <> 'h1'").withColumn("leads", F.coalesce(F.lead("tag").over(Window.partitionBy("page_id").orderBy("pos")), F.lit("")) == "li")
    rank = F.when(F.col("leads") & (F.col("tag") == "p"), 0).when(F.col("text").rlike(ascii_words("(?i)\\bthe\\b")), 1).otherwise(2)
    best = rows.groupBy("page_id").agg(F.min(F.struct(rank.alias("rank"), "pos")).alias("m"))
    return best.select("page_id", "m.pos", F.when(F.col("m.rank") == 0, "driver_list").when(F.col("m.rank") == 1, "direct").otherwise("any").alias("preference"))


@query("focus_excerpts", NORM + """,
e AS (SELECT t.conv_id, t.turn, t.tags, LAG(t.tags) OVER (PARTITION BY conv_id ORDER BY turn) AS heading_tags FROM t)
SELECT conv_id, turn, len(tags) = 0 OR heading_tags IS NULL OR len(heading_tags) = 0 OR len(list_intersect(tags, heading_tags)) > 0 AS kept FROM e""")
def focus_excerpts(spark, sf):
    """An excerpt goes when its heading is about other measures than the one asked for (here: the turn before stands for the heading)."""
    heading = F.lag("tags").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = asked(spark, sf).select("conv_id", "turn", "tags").withColumn("heading", heading)
    kept = (F.size("tags") == 0) | F.col("heading").isNull() | (F.size("heading") == 0) | F.coalesce(F.arrays_overlap("tags", "heading"), F.lit(False))
    return rows.select("conv_id", "turn", kept.alias("kept"))


LABELS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in P.LABELS.items())


@query("measure_labels", NORM + f", q AS (SELECT conv_id, turn, unnest(tags) AS tag FROM t) SELECT conv_id, turn, tag, coalesce(label, tag) AS label FROM q LEFT JOIN (VALUES {LABELS_SQL}) m(name, label) ON name = tag")
def measure_labels(spark, sf):
    """The words that stand for each measure in a search."""
    label = F.create_map(*[F.lit(x) for kv in P.LABELS.items() for x in kv])
    return asked(spark, sf).select("conv_id", "turn", F.explode("tags").alias("tag")).withColumn("label", F.coalesce(F.element_at(label, F.col("tag")), F.col("tag")))


@query("literal_spans", BLOCKS + """,
s AS (SELECT DISTINCT page_id, pos, substr(text, a + 1, 60) AS span FROM (SELECT page_id, pos, text, unnest([0, 30, 0]) AS a FROM b WHERE tag = 'p'))
SELECT page_id, pos, count(*) AS spans, sum(length(span))::BIGINT AS chars FROM s WHERE span <> '' GROUP BY ALL""")
def literal_spans(spark, sf):
    """The literal spans of a record for ranking, each once."""
    cut_out = F.array(*[F.substring("text", a + 1, 60) for a in (0, 30, 0)])
    rows = blocks(spark, sf).filter("tag = 'p'").select("page_id", "pos", F.filter(F.array_distinct(cut_out), lambda x: x != "").alias("s")).filter(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))
    return rows.select("page_id", "pos", F.size("s").cast("long").alias("spans"), total.alias("chars"))


@query("prompt_cards", PRINTED + """
SELECT sha256('{"company":"' || company || '","metric":"' || metric || '","period_end":"' || period_end || '","value":' || value || '}') AS card FROM bound WHERE status = 'bound'""")
def prompt_cards(spark, sf):
    """Only the allowed fields of a bound cell go on, as canonical JSON."""
    rows = bound(spark, sf).filter("status = 'bound'").select(F.to_json(F.struct("company", "metric", "period_end", "value")).alias("j"))
    return rows.select(F.sha2("j", 256).alias("card"))


@query("unit_names", """
SELECT p_partkey, CASE WHEN contains(u, 'billion') OR contains(u, '$bn') THEN 'AUD billion' WHEN contains(u, 'million') OR contains(u, '$m') THEN 'AUD million' WHEN contains(u, 'cent') THEN 'cents/share' WHEN contains(u, '%') OR contains(u, 'percent') THEN 'percent' ELSE 'unknown' END AS unit
FROM (SELECT p_partkey, lower(['$ Million', 'A$m', 'cents per share', 'in %', 'US Billions', '$BN', 'boxes'][1 + p_partkey % 7]) AS u FROM part)""")
def unit_names(spark, sf):
    """Units brought to one name by what they contain."""
    raw = F.array(*map(F.lit, ["$ Million", "A$m", "cents per share", "in %", "US Billions", "$BN", "boxes"]))
    rows = read(spark, sf, "part").select("p_partkey", F.lower(F.element_at(raw, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("u"))
    has = lambda x: F.contains("u", F.lit(x))
    return rows.select("p_partkey", F.when(has("billion") | has("$bn"), "AUD billion").when(has("million") | has("$m"), "AUD million").when(has("cent"), "cents/share").when(has("%") | has("percent"), "percent").otherwise("unknown").alias("unit"))


# references ------------------------------------------------------------------------------------------------------------


@query("anchor_unique", QTF + JUDGED + """
SELECT q.query, count(j.id) FILTER (gain = 2) AS holders, CASE count(j.id) FILTER (gain = 2) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status FROM q LEFT JOIN judged j ON j.query = q.query GROUP BY q.query""")
def anchor_unique(spark, sf):
    """A reference passage should stand in exactly one document."""
    holders = judged(spark, sf).filter("gain = 2").groupBy("query").agg(F.count("*").alias("holders"))
    rows = read(spark, sf, "benchmark").select(F.col("item_id").alias("query")).join(holders, "query", "left").fillna(0, ["holders"])
    return rows.select("query", "holders", F.when(F.col("holders") == 0, "none").when(F.col("holders") == 1, "one").otherwise("many").alias("status"))


@query("unanswered_audit", """
WITH topic AS (SELECT conv_id AS id, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), intent AS (SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) >= 2),
summary AS (SELECT c.conv_id AS id, max(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) = 0 AS refused, min_by(text, turn) AS first_text FROM conversations c GROUP BY conv_id)
SELECT 1 + t.id % 3 AS cutoff, count(*) AS questions, count(*) FILTER (refused) AS refused FROM topic t JOIN intent USING (id) JOIN summary s ON s.id = t.id AND s.first_text = t.question GROUP BY 1""")
def unanswered_audit(spark, sf):
    """Topics, intents and summaries joined by id and by the words of the question; how many of those in all three were refused."""
    rows = read(spark, sf, "conversations")
    topic = rows.filter("role = 'user'").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("question"))
    intent = rows.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).filter("n >= 2").select("id")
    summary = rows.groupBy(F.col("conv_id").alias("id")).agg((F.max(F.col("text").rlike("[0-9]").cast("int")) == 0).alias("refused"), F.min_by("text", "turn").alias("question"))
    both = topic.join(summary, ["id", "question"]).join(intent, "id", "left_semi")
    return both.groupBy((F.col("id") % 3 + 1).alias("cutoff")).agg(F.count("*").alias("questions"), F.count_if("refused").alias("refused"))


@query("topic_ids", "SELECT item_id, 'W' || CASE WHEN item_id < 10 THEN '0' ELSE '' END || item_id AS topic FROM benchmark")
def topic_ids(spark, sf):
    """Question ids to topic ids: W1Q1 is of topic W01."""
    name = F.concat(F.lit("W"), F.col("item_id").cast("string"), F.lit("Q1"))
    number = F.regexp_extract(name, "^W([0-9]+)Q", 1)
    return read(spark, sf, "benchmark").select("item_id", F.concat(F.lit("W"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)).alias("topic"))


@query("selection_validity", BLOCKS + """,
c AS (SELECT page_id, count(*) AS n FROM b WHERE tag = 'p' AND length(text) >= 40 GROUP BY page_id),
s AS (SELECT page_id, n, list_concat([1], list_concat(CASE WHEN page_id % 5 = 0 THEN [1] ELSE CAST([] AS INTEGER[]) END, list_concat(CASE WHEN page_id % 7 = 0 THEN [999] ELSE CAST([] AS INTEGER[]) END, CASE WHEN page_id % 11 = 0 THEN [2, 3, 4, 5] ELSE CAST([] AS INTEGER[]) END))) AS ids FROM c)
SELECT page_id, CASE WHEN len(ids) > 4 THEN 'too_many' WHEN len(list_distinct(ids)) < len(ids) THEN 'repeated' WHEN len(list_filter(ids, lambda z: z > n)) > 0 THEN 'unknown' ELSE 'valid' END AS outcome FROM s""")
def selection_validity(spark, sf):
    """A selection of numbered passages: four at most, none twice, all of them there."""
    cards = blocks(spark, sf).filter((F.col("tag") == "p") & (F.char_length("text") >= 40)).groupBy("page_id").agg(F.count("*").alias("n"))
    some = lambda k, ids: F.when(F.col("page_id") % k == 0, F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<int>"))
    rows = cards.withColumn("ids", F.concat(F.array(F.lit(1)), some(5, [1]), some(7, [999]), some(11, [2, 3, 4, 5])))
    outcome = F.when(F.size("ids") > 4, "too_many").when(F.size(F.array_distinct("ids")) < F.size("ids"), "repeated").when(F.exists("ids", lambda z: z > F.col("n")), "unknown").otherwise("valid")
    return rows.select("page_id", outcome.alias("outcome"))


@query("row_contexts", BLOCKS + """,
m AS (SELECT page_id, heading_pos, pos, length(text) % 3 AS indent, tag = 'p' AND length(text) < 120 AS local FROM h),
g AS (SELECT *, sum(CASE WHEN indent = 0 AND NOT local THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, heading_pos ORDER BY pos) AS part FROM m)
SELECT page_id, pos, heading_pos AS section, last_value(CASE WHEN local THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id, heading_pos, part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS local_heading FROM g""")
def row_contexts(spark, sf):
    """The section of each row and the last local heading in it; a row without indentation that is no local heading resets the local one."""
    local = (F.col("tag") == "p") & (F.char_length("text") < 120)
    rows = headed(spark, sf).withColumn("local", local).withColumn("reset", ((F.char_length("text") % 3 == 0) & ~local).cast("int"))
    rows = rows.withColumn("part", F.sum("reset").over(Window.partitionBy("page_id", "heading_pos").orderBy("pos")))
    w = Window.partitionBy("page_id", "heading_pos", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("page_id", "pos", F.col("heading_pos").alias("section"), F.last(F.when(F.col("local"), F.col("pos")), ignorenulls=True).over(w).alias("local_heading"))
