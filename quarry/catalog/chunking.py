"""Tables and pages to chunks: column paths, rendered rows, grouped children, corpora, record views, unit maps, verified inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.binding import PRINTED, grid, printed
from quarry.catalog.registry import query, read
from quarry.catalog.structure import BLOCKS, blocks, headed
from quarry.functions.text import ascii_words
from quarry.operators import coverage as C
from quarry.operators import structure as S
from quarry.scratch import cut, fresh_path

# table: rows by measure, columns by value year, and a comparison column at the end ------------------------------------

TABLE = PRINTED + """,
cols AS (SELECT company, report_year, value_year, row_number() OVER (PARTITION BY company, report_year ORDER BY value_year) AS col FROM (SELECT DISTINCT company, report_year, value_year FROM printed)),
width AS (SELECT company, report_year, max(col) AS n FROM cols GROUP BY ALL),
spans AS (SELECT company, report_year, 'Full year' AS grp, 1 AS first, n + 1 AS stop FROM width UNION ALL SELECT company, report_year, 'Change', n + 1, n + 2 FROM width),
leaves AS (SELECT company, report_year, col, '31 Dec ' || right(CAST(value_year AS VARCHAR), 2) AS leaf FROM cols UNION ALL SELECT company, report_year, n + 1, 'v prior %' FROM width),
paths AS (SELECT l.company, l.report_year, l.col, s.grp || ' / ' || l.leaf AS path FROM leaves l JOIN spans s ON s.company = l.company AND s.report_year = l.report_year AND l.col >= s.first AND l.col < s.stop),
placed AS (SELECT g.company, g.report_year, g.metric, g.label, CASE WHEN g.raw = '12%' THEN w.n + 1 ELSE c.col END AS col, g.raw FROM grid g JOIN width w USING (company, report_year) LEFT JOIN cols c ON c.company = g.company AND c.report_year = g.report_year AND c.value_year = g.value_year)"""


def widths(rows):
    return rows.groupBy("company", "report_year").agg(F.array_sort(F.collect_set("value_year")).alias("years"))


def paths(rows):
    """company, report_year, col, path: every column under the group whose explicit span covers it; spans are expanded, never filled forward."""
    wide = widths(rows).withColumn("n", F.size("years"))
    leaf = F.concat(F.transform("years", lambda y: F.concat(F.lit("31 Dec "), F.substring(y.cast("string"), -2, 2))), F.array(F.lit("v prior %")))
    leaves = wide.select("company", "report_year", F.posexplode(leaf).alias("i", "leaf")).withColumn("col", F.col("i") + 1)
    spans = F.array(F.struct(F.lit("Full year").alias("grp"), F.lit(1).alias("first"), (F.col("n") + 1).alias("stop")), F.struct(F.lit("Change").alias("grp"), (F.col("n") + 1).alias("first"), (F.col("n") + 2).alias("stop")))
    covered = wide.select("company", "report_year", F.explode(spans).alias("s")).select("company", "report_year", "s.grp", F.explode(F.sequence(F.col("s.first"), F.col("s.stop") - 1)).alias("col"))
    return leaves.join(covered, ["company", "report_year", "col"]).select("company", "report_year", "col", F.concat_ws(" / ", "grp", "leaf").alias("path"))


def placed(rows):
    """company, report_year, metric, label, col, raw of every printed cell."""
    at = F.when(F.col("raw") == "12%", F.size("years") + 1).otherwise(F.array_position("years", F.col("value_year")).cast("int"))
    return grid(rows).join(widths(rows), ["company", "report_year"]).select("company", "report_year", "metric", "label", at.alias("col"), "raw")


@query("column_paths", TABLE + "\nSELECT company, report_year, CAST(col AS INTEGER) AS col, path FROM paths")
def column_paths(spark, sf):
    return paths(printed(spark, sf)).select("company", "report_year", F.col("col").cast("int").alias("col"), "path")


@query("scatter_grid", TABLE + """,
all_cols AS (SELECT p.company, p.report_year, m.metric, p.col FROM paths p JOIN (SELECT DISTINCT company, report_year, metric FROM placed) m USING (company, report_year))
SELECT a.company, a.report_year, a.metric, string_agg(coalesce(x.raw, ''), '|' ORDER BY a.col) AS cells FROM all_cols a LEFT JOIN placed x ON x.company = a.company AND x.report_year = a.report_year AND x.metric = a.metric AND x.col = a.col GROUP BY ALL""")
def scatter_grid(spark, sf):
    """Cells (row, column, text) scattered into a dense grid; places without a cell are empty texts."""
    rows = printed(spark, sf)
    found = placed(rows).groupBy("company", "report_year", "metric").agg(F.map_from_entries(F.collect_list(F.struct("col", "raw"))).alias("m"))
    wide = found.join(widths(rows), ["company", "report_year"])
    line = F.transform(F.sequence(F.lit(1), F.size("years") + 1), lambda c: F.coalesce(F.element_at("m", c), F.lit("")))
    return wide.select("company", "report_year", "metric", F.array_join(line, "|").alias("cells"))


RENDERED = TABLE + """,
rendered AS (SELECT x.company, x.report_year, x.metric, x.company || ' FY' || x.report_year || ' | ' || x.label || ': ' || string_agg(p.path || ' = ' || x.raw, '; ' ORDER BY x.col) AS text, count(*) FILTER (x.raw <> '12%') AS figures
  FROM placed x JOIN paths p ON p.company = x.company AND p.report_year = x.report_year AND p.col = x.col GROUP BY x.company, x.report_year, x.metric, x.label)"""


def rendered(rows):
    """A line for each row of each table, with document prefix, label and column paths."""
    both = placed(rows).join(paths(rows), ["company", "report_year", "col"]).groupBy("company", "report_year", "metric", "label")
    got = both.agg(F.array_sort(F.collect_list(F.struct("col", F.concat_ws(" = ", "path", "raw").alias("t")))).alias("l"), F.count_if(F.col("raw") != "12%").alias("figures"))
    text = F.concat("company", F.lit(" FY"), F.col("report_year").cast("string"), F.lit(" | "), "label", F.lit(": "), F.array_join("l.t", "; "))
    return got.select("company", "report_year", "metric", text.alias("text"), "figures")


@query("render_rows", RENDERED + "\nSELECT company, report_year, metric, text FROM rendered")
def render_rows(spark, sf):
    return rendered(printed(spark, sf)).drop("figures")


#: A child chunk holds rows of one context, three at most, and so many bytes at most.
MAX_ROWS, MAX_BYTES, TOO_LARGE = 3, 400, 360

CHILDREN = RENDERED + f""",
seq AS (SELECT *, strlen(text) AS size, CASE WHEN metric = 'quantity' THEN 'units' ELSE 'money' END AS context, row_number() OVER (PARTITION BY company, report_year ORDER BY metric) AS rn FROM rendered),
walk AS (WITH RECURSIVE w AS (SELECT company, report_year, metric, context, size, rn, 1 AS grp, 1 AS n, size AS used FROM seq WHERE rn = 1
  UNION ALL SELECT s.company, s.report_year, s.metric, s.context, s.size, s.rn, CASE WHEN s.context <> w.context OR w.n >= {MAX_ROWS} OR w.used + s.size > {MAX_BYTES} THEN w.grp + 1 ELSE w.grp END,
    CASE WHEN s.context <> w.context OR w.n >= {MAX_ROWS} OR w.used + s.size > {MAX_BYTES} THEN 1 ELSE w.n + 1 END, CASE WHEN s.context <> w.context OR w.n >= {MAX_ROWS} OR w.used + s.size > {MAX_BYTES} THEN s.size ELSE w.used + s.size END
  FROM w JOIN seq s ON s.company = w.company AND s.report_year = w.report_year AND s.rn = w.rn + 1) SELECT * FROM w),
child AS (SELECT w.company, w.report_year, grp, string_agg(w.metric, ',' ORDER BY w.rn) AS metrics, CAST(sum(w.size) AS BIGINT) AS bytes, max(CASE WHEN w.size > {TOO_LARGE} THEN 1 ELSE 0 END) AS large, max(CASE WHEN r.figures = 0 THEN 1 ELSE 0 END) AS bare FROM walk w JOIN rendered r USING (company, report_year, metric) GROUP BY w.company, w.report_year, grp)"""


def grouped(rows):
    """company, report_year, grp, metric, size, figures: consecutive rows in groups that a context change, a row cap or a byte cap ends."""
    seq = rows.withColumn("size", F.octet_length("text")).withColumn("context", F.when(F.col("metric") == "quantity", "units").otherwise("money"))
    tables = seq.groupBy("company", "report_year").agg(F.array_sort(F.collect_list(F.struct("metric", "context", "size", "figures"))).alias("rows"))
    begin = F.struct(F.lit("").alias("context"), F.lit(0).alias("grp"), F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        fresh = (x.context != s.context) | (s.n >= MAX_ROWS) | (s.used + x["size"] > MAX_BYTES)
        grp = s.grp + F.when(fresh, 1).otherwise(0)
        return F.struct(x.context.alias("context"), grp.alias("grp"), F.when(fresh, 1).otherwise(s.n + 1).alias("n"), F.when(fresh, x["size"]).otherwise(s.used + x["size"]).alias("used"), F.concat(s.out, F.array(grp)).alias("out"))

    numbered = tables.select("company", "report_year", "rows", F.aggregate("rows", begin, step, lambda s: s.out).alias("grp"))
    return numbered.select("company", "report_year", F.explode(F.arrays_zip("rows", "grp")).alias("z")).select("company", "report_year", F.col("z.grp").alias("grp"), "z.rows.*")


@query("table_children", CHILDREN + """
SELECT company, report_year, CAST(grp AS INTEGER) AS grp, metrics, bytes, CASE WHEN bare = 1 THEN 'quarantined:no_header' WHEN large = 1 THEN 'quarantined:oversize' ELSE 'ready' END AS status,
  max(CASE WHEN bare = 1 OR large = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY company, report_year) = 1 AS parent_quarantined FROM child""")
def table_children(spark, sf):
    """Child chunks of each table with their quarantine; the literal parent is quarantined if any child is."""
    rows = grouped(rendered(printed(spark, sf)))
    per = rows.groupBy("company", "report_year", "grp").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"), F.sum("size").alias("bytes"), F.max((F.col("size") > TOO_LARGE).cast("int")).alias("large"), F.max((F.col("figures") == 0).cast("int")).alias("bare"))
    status = F.when(F.col("bare") == 1, "quarantined:no_header").when(F.col("large") == 1, "quarantined:oversize").otherwise("ready")
    bad = F.max(F.greatest("bare", "large")).over(Window.partitionBy("company", "report_year")) == 1
    return per.select("company", "report_year", "grp", "metrics", "bytes", status.alias("status"), bad.alias("parent_quarantined"))


@query("anchor_units", RENDERED + """,
units AS (SELECT company || ':' || report_year || ':' || metric AS unit_id, md5(text) AS body FROM rendered UNION ALL SELECT company || ':' || report_year || ':head', md5(string_agg(path, '|' ORDER BY col)) FROM paths GROUP BY company, report_year),
anchors AS (SELECT DISTINCT company, report_year, metric, unnest([company || ':' || report_year || ':' || metric, company || ':' || report_year || ':head', company || ':' || report_year || ':gross']) AS unit_id FROM rendered)
SELECT a.company, a.report_year, a.metric, a.unit_id, u.body FROM anchors a JOIN units u USING (unit_id)""")
def anchor_units(spark, sf):
    """The units that a row's chunk rests on, each once: the row, the header and the context row."""
    rows = printed(spark, sf)
    lines = cut(rendered(rows), "rendered")
    name = lambda m: F.concat_ws(":", "company", F.col("report_year").cast("string"), m)
    heads = paths(rows).groupBy("company", "report_year").agg(F.array_sort(F.collect_list(F.struct("col", "path"))).alias("l"))
    units = lines.select(name("metric").alias("unit_id"), F.md5("text").alias("body")).unionByName(heads.select(name(F.lit("head")).alias("unit_id"), F.md5(F.array_join("l.path", "|")).alias("body")))
    wanted = F.array_union(F.array(name("metric"), name(F.lit("head"))), F.array(name(F.lit("gross"))))
    return lines.select("company", "report_year", "metric", F.explode(wanted).alias("unit_id")).join(units, "unit_id")


# pages ---------------------------------------------------------------------------------------------------------------


@query("page_chunks", BLOCKS + """,
c AS (SELECT *, list_filter(list(CASE WHEN tag LIKE 'h%' THEN text END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), lambda x: x IS NOT NULL) AS heads FROM b)
SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN length(text) < 20 THEN 'excluded' ELSE 'child' END AS kind, md5(array_to_string(heads[-2:], ' > ')) AS context, substr(sha256(page_id || '|' || array_to_string(heads[-2:], ' > ')), 1, 24) AS parent_id FROM c""")
def page_chunks(spark, sf):
    """Blocks of a page as children under their last two headings, or as exclusions that say so."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.collect_list(F.when(S.is_heading(F.col("tag")), F.col("text"))).over(w)  # a page's headings; nulls are not collected
    rows = blocks(spark, sf).withColumn("heads", heads)
    context = F.array_join(F.slice("heads", F.greatest(F.size("heads") - 1, F.lit(1)), 2), " > ")
    kind = F.when(S.is_heading(F.col("tag")), "heading").when(F.char_length("text") < 20, "excluded").otherwise("child")
    return rows.select("page_id", "pos", kind.alias("kind"), F.md5(context).alias("context"), F.substring(F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), context), 256), 1, 24).alias("parent_id"))


@query("two_corpora", BLOCKS + """,
whole AS (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text, count(*) FILTER (tag = 'li') AS notes FROM b GROUP BY page_id),
win AS (SELECT page_id, notes, text, unnest(range(0, greatest(length(text), 1), 1050)) AS start FROM whole)
SELECT 'structured' AS corpus, b.page_id, CAST(pos AS BIGINT) AS start, md5(b.text) AS body, notes FROM b JOIN whole USING (page_id)
UNION ALL SELECT 'windows', page_id, start, md5(substr(text, start + 1, 1200)), notes FROM win WHERE start = 0 OR start + 150 < length(text)""")
def two_corpora(spark, sf):
    """The same evidence chunked two ways, by structure and by windows, with the notes of a page linked in both."""
    rows = cut(blocks(spark, sf), "blocks")
    whole = rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"), F.count_if(F.col("tag") == "li").alias("notes"))
    one = rows.join(whole.select("page_id", "notes"), "page_id").select(F.lit("structured").alias("corpus"), "page_id", F.col("pos").cast("long").alias("start"), F.md5("text").alias("body"), "notes")
    two = whole.select("page_id", "notes", F.explode(S.fixed_windows(F.col("text"), 1200, 150)).alias("w")).select(F.lit("windows").alias("corpus"), "page_id", F.col("w.start").cast("long").alias("start"), F.md5("w.text").alias("body"), "notes")
    return one.unionByName(two)


RECORDS = BLOCKS + """,
per AS (SELECT page_id, page_id // 50 AS doc, bool_or(pos < 8 AND regexp_matches(lower(text), '\\bof\\b')) AS explicit, count(*) FILTER (length(text) < 40) >= 6 AS short FROM b GROUP BY page_id),
br AS (SELECT *, CASE WHEN explicit THEN 0 WHEN short AND coalesce(lag(page_id) OVER (PARTITION BY doc ORDER BY page_id) = page_id - 1, FALSE) THEN 0 ELSE 1 END AS broken FROM per),
seg AS (SELECT *, sum(broken) OVER (PARTITION BY doc ORDER BY page_id) AS run FROM br),
gl AS (SELECT page_id, max(CASE WHEN explicit THEN 1 ELSE 0 END) OVER (PARTITION BY doc, run ORDER BY page_id) = 1 AS glossary FROM seg)"""


@query("record_view", RECORDS + """
SELECT b.page_id, b.pos, CASE WHEN glossary AND tag = 'p' THEN 'definition' WHEN tag = 'li' THEN 'row' WHEN tag = 'p' THEN 'passage' ELSE 'label' END AS kind FROM b JOIN gl USING (page_id)""")
def record_view(spark, sf):
    """Blocks as typed records. A glossary goes on over the pages that follow without a gap and look like one: a recursion over pages as runs."""
    rows = cut(blocks(spark, sf), "blocks")
    per = rows.groupBy("page_id").agg(F.bool_or((F.col("pos") < 8) & F.lower("text").rlike(ascii_words("\\bof\\b"))).alias("explicit"), (F.count_if(F.char_length("text") < 40) >= 6).alias("short")).withColumn("doc", F.floor(F.col("page_id") / 50))
    order = Window.partitionBy("doc").orderBy("page_id")
    follows = F.coalesce(F.lag("page_id").over(order) == F.col("page_id") - 1, F.lit(False))
    per = per.withColumn("broken", F.when(F.col("explicit"), 0).when(F.col("short") & follows, 0).otherwise(1))
    per = per.withColumn("run", F.sum("broken").over(order))
    glossary = F.max(F.col("explicit").cast("int")).over(Window.partitionBy("doc", "run").orderBy("page_id")) == 1
    kind = F.when(F.col("glossary") & (F.col("tag") == "p"), "definition").when(F.col("tag") == "li", "row").when(F.col("tag") == "p", "passage").otherwise("label")
    return rows.join(per.select("page_id", glossary.alias("glossary")), "page_id").select("page_id", "pos", kind.alias("kind"))


@query("prose_blocks", BLOCKS + """,
n AS (SELECT *, lead(text) OVER (PARTITION BY page_id ORDER BY pos) AS next, lead(tag) OVER (PARTITION BY page_id ORDER BY pos) AS next_tag FROM b),
m AS (SELECT page_id, pos, tag, CASE WHEN NOT regexp_matches(text, '[.;:]$') AND next_tag = 'p' THEN text || ' ' || next ELSE text END AS text FROM n WHERE tag = 'p')
SELECT page_id, pos, md5(text) AS body FROM m WHERE len(regexp_extract_all(text, '[^ ]+')) >= 10 AND len(regexp_extract_all(text, '[^ ]+')) > 2 * len(regexp_extract_all(text, '[0-9]')) AND regexp_matches(text, '[.;:]$')""")
def prose_blocks(spark, sf):
    """Paragraphs that read as prose, one that breaks off joined with the next."""
    order = Window.partitionBy("page_id").orderBy("pos")
    rows = blocks(spark, sf).withColumn("next", F.lead("text").over(order)).withColumn("next_tag", F.lead("tag").over(order)).filter("tag = 'p'")
    rows = rows.withColumn("text", F.when(~F.col("text").rlike("[.;:]$") & (F.col("next_tag") == "p"), F.concat_ws(" ", "text", "next")).otherwise(F.col("text")))
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return rows.filter((count("[^ ]+") >= 10) & (count("[^ ]+") > 2 * count("[0-9]")) & F.col("text").rlike("[.;:]$")).select("page_id", "pos", F.md5("text").alias("body"))


@query("unit_map", BLOCKS + "\nSELECT 'p' || page_id || ':b' || pos AS unit_id, text FROM b")
def unit_map(spark, sf):
    """Pages written as JSON files, scanned back by a glob, and their blocks as a map from unit to text."""
    pages = blocks(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "text"))).alias("blocks"))
    path = fresh_path(spark, "pages-json")
    pages.write.json(path)
    back = spark.read.schema("page_id long, blocks array<struct<pos: int, tag: string, text: string>>").json(f"{path}/part-*.json")
    units = back.select("page_id", F.explode_outer("blocks").alias("b"))
    return units.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(":b"), F.col("b.pos").cast("string")).alias("unit_id"), "b.text")


@query("report_library", BLOCKS + """,
x AS (SELECT h.page_id, h.pos, h.text, t.text AS section FROM h LEFT JOIN b t ON t.page_id = h.page_id AND t.pos = h.heading_pos WHERE h.tag = 'p' AND length(h.text) >= 60)
SELECT page_id, pos, md5(coalesce(section, '')) AS section, nullif(regexp_extract(coalesce(section, '') || ' ' || text, '(19|20)[0-9]{2}'), '') AS period, sha256(text) AS checksum FROM x""")
def report_library(spark, sf):
    """Prose blocks of all pages with section, period and checksum: what a library caches."""
    rows = headed(spark, sf).filter((F.col("tag") == "p") & (F.char_length("text") >= 60))
    section = F.coalesce("heading", F.lit(""))
    period = F.nullif(F.regexp_extract(F.concat_ws(" ", section, F.col("text")), "(19|20)[0-9]{2}", 0), F.lit(""))
    return rows.select("page_id", "pos", F.md5(section).alias("section"), period.alias("period"), F.sha2("text", 256).alias("checksum"))


@query("verified_load", """
WITH m AS (SELECT source, sha256(string_agg(sha256(CASE WHEN doc_id % 197 = 3 THEN text || '!' ELSE text END), '' ORDER BY doc_id)) AS want FROM documents GROUP BY source),
a AS (SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS got FROM documents GROUP BY source)
SELECT d.doc_id, CASE WHEN got = want THEN 'loaded' ELSE 'refused' END AS status FROM documents d JOIN m USING (source) JOIN a USING (source)""")
def verified_load(spark, sf):
    """Documents of a source are loaded only if all hashes of the source are those of the manifest; one changed text refuses its source."""
    docs = read(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("got"), F.sha2(F.when(F.col("doc_id") % 197 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("want"))
    good = docs.groupBy("source").agg(F.bool_and(F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("good"))
    return docs.join(good, "source").select("doc_id", F.when(F.col("good"), "loaded").otherwise("refused").alias("status"))


@query("tree_walk", """
WITH RECURSIVE n AS (SELECT s_suppkey AS id FROM supplier), w AS (
  SELECT id, id AS root, [id] AS path FROM n WHERE id < 4 UNION ALL SELECT n.id, w.root, list_append(w.path, n.id) FROM w JOIN n ON n.id // 4 = w.id AND n.id >= 4)
SELECT id, root, len(path) - 1 AS depth, row_number() OVER (PARTITION BY root ORDER BY path) AS nth FROM w""")
def tree_walk(spark, sf):
    """Reading order of a tree that is given by parents (here id / 4): paths level by level, one join for each level, then their order."""
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    level = cut(rows.filter("id < 4").select("id", F.col("id").alias("root"), F.array("id").alias("path")), "level")
    found, inner = level, rows.filter("id >= 4").withColumn("up", F.floor(F.col("id") / 4))
    while not level.isEmpty():  # as many rounds as the tree is deep
        level = cut(inner.join(level.select(F.col("id").alias("up"), "root", F.col("path").alias("above")), "up").select("id", "root", F.concat("above", F.array("id")).alias("path")), "level")
        found = found.unionByName(level)
    nth = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return found.select("id", "root", (F.size("path") - 1).cast("long").alias("depth"), nth.cast("long").alias("nth"))


@query("driver_lists", BLOCKS + """,
f AS (SELECT *, lag(tag) OVER (PARTITION BY page_id ORDER BY pos) AS before, lag(text) OVER (PARTITION BY page_id ORDER BY pos) AS lead_text, length(text) % 5 AS x0, length(text) % 5 + 20 + length(text) % 7 AS x1, pos * 20 AS y FROM b),
g AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y) OVER w AS py FROM f WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
i AS (SELECT *, CASE WHEN tag = 'li' AND (before IS DISTINCT FROM 'li' OR (least(x1, px1) - greatest(x0, px0)) * 10 < 7 * least(x1 - x0, px1 - px0) OR y - py > 22) THEN 1 ELSE 0 END AS fresh FROM g),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM i)
SELECT page_id, island, min(pos) AS start, count(*) AS bullets, md5(coalesce(max(CASE WHEN fresh = 1 AND before <> 'li' THEN lead_text END), '')) AS lead FROM j WHERE tag = 'li' GROUP BY page_id, island""")
def driver_lists(spark, sf):
    """Bullets of one column without gaps, with the block that leads them: columns must overlap by seven tenths, gaps be 22 at most."""
    order = Window.partitionBy("page_id").orderBy("pos")
    n = F.char_length("text")
    rows = blocks(spark, sf).withColumn("x0", n % 5).withColumn("x1", n % 5 + 20 + n % 7).withColumn("y", F.col("pos") * 20)
    for c, name in (("tag", "before"), ("text", "lead_text"), ("x0", "px0"), ("x1", "px1"), ("y", "py")):
        rows = rows.withColumn(name, F.lag(c).over(order))
    apart = (F.least("x1", "px1") - F.greatest("x0", "px0")) * 10 < 7 * F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0"))
    fresh = (F.col("tag") == "li") & (~F.col("before").eqNullSafe(F.lit("li")) | F.coalesce(apart, F.lit(False)) | F.coalesce(F.col("y") - F.col("py") > 22, F.lit(False)))
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order)).filter("tag = 'li'")
    lead = F.max(F.when((F.col("fresh") == 1) & (F.col("before") != "li"), F.col("lead_text")))
    return rows.groupBy("page_id", "island").agg(F.min("pos").alias("start"), F.count("*").alias("bullets"), F.md5(F.coalesce(lead, F.lit(""))).alias("lead"))


@query("resume_extraction", """
WITH done AS (SELECT page_id FROM pages WHERE page_id % 3 = 0), todo AS (SELECT page_id, html FROM pages WHERE page_id NOT IN (SELECT page_id FROM done))
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<article') THEN 'structured' ELSE 'failed' END AS status, CASE WHEN NOT regexp_matches(html, '(?i)<article') THEN 'no article element' END AS error FROM todo""")
def resume_extraction(spark, sf):
    """Pages that an earlier run has not finished, each with its own status and error; one bad page stops nothing."""
    pages = read(spark, sf, "pages").select("page_id", "html")
    todo = pages.join(pages.filter("page_id % 3 = 0").select("page_id"), "page_id", "left_anti")
    good = F.col("html").rlike("(?i)<article")
    return todo.select("page_id", F.when(good, "structured").otherwise("failed").alias("status"), F.when(~good, "no article element").alias("error"))


@query("extractor_arms", """
SELECT page_id, arm, CAST(len(found) AS BIGINT) AS found, md5(array_to_string(found, '|')) AS digest FROM (
  SELECT page_id, unnest([('paragraphs', regexp_extract_all(html, '(?s)<p[^>]*>([^<]*)', 1)), ('links', regexp_extract_all(html, 'href="([^"]*)"', 1)), ('headings', regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)', 1))], recursive := true) FROM pages) t(page_id, arm, found)""")
def extractor_arms(spark, sf):
    """Several extractors behind one signature, by name."""
    arms = {"paragraphs": "(?s)<p[^>]*>([^<]*)", "links": 'href="([^"]*)"', "headings": "<h[1-6][^>]*>([^<]*)"}
    both = F.array(*[F.struct(F.lit(n).alias("arm"), F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("found")) for n, p in arms.items()])
    rows = read(spark, sf, "pages").select("page_id", F.explode(both).alias("x"))
    return rows.select("page_id", "x.arm", F.size("x.found").cast("long").alias("found"), F.md5(F.array_join("x.found", "|")).alias("digest"))


@query("vector_increment", """
WITH h AS (SELECT vec_id, label, md5(array_to_string([CAST(CAST(round(x::DOUBLE * 1000) AS BIGINT) AS VARCHAR) FOR x IN embedding], ',')) AS h FROM embeddings), known AS (SELECT DISTINCT h FROM h WHERE vec_id % 3 <> 0)
SELECT vec_id, h AS content FROM h WHERE h NOT IN (SELECT h FROM known)""")
def vector_increment(spark, sf):
    """Vectors whose content hash an append-only store does not have yet: the only ones to compute."""
    from quarry.sources.trec import only_new

    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string"))
    rows = read(spark, sf, "embeddings").select("vec_id", F.md5(F.array_join(whole, ",")).alias("hash"))
    return only_new(rows, rows.filter("vec_id % 3 <> 0").select("hash").distinct()).withColumnRenamed("hash", "content")


@query("context_budget", BLOCKS + """,
item AS (SELECT page_id, heading_pos, pos, length(text) AS size, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC, pos) AS rn FROM h WHERE tag IN ('p', 'li')),
walk AS (WITH RECURSIVE w AS (SELECT page_id, rn, CASE WHEN size <= 1500 THEN size ELSE 0 END AS used, CASE WHEN size <= 1500 THEN [pos] ELSE CAST([] AS INTEGER[]) END AS kept FROM item WHERE rn = 1
  UNION ALL SELECT i.page_id, i.rn, w.used + CASE WHEN w.used + i.size <= 1500 THEN i.size ELSE 0 END, CASE WHEN w.used + i.size <= 1500 THEN list_append(w.kept, i.pos) ELSE w.kept END FROM w JOIN item i ON i.page_id = w.page_id AND i.rn = w.rn + 1) SELECT * FROM w),
l AS (SELECT page_id, max(rn) AS rn FROM item GROUP BY page_id)
SELECT page_id, len(kept) AS kept, rn - len(kept) AS omitted, array_to_string(list_sort(kept), ',') AS places FROM walk JOIN l USING (page_id, rn)""")
def context_budget(spark, sf):
    """Blocks of a page under a budget, the longest first, one that does not fit skipped; what is left out is counted, not hidden."""
    rows = headed(spark, sf).filter(F.col("tag").isin("p", "li"))
    item = F.struct(F.struct((-F.char_length("text")).alias("minus"), "pos").alias("rank"), F.char_length("text").cast("long").alias("size"), F.col("pos").alias("id"))
    pages = rows.groupBy("page_id").agg(F.collect_list(item).alias("items"))
    kept = pages.select("page_id", F.size("items").alias("n"), C.greedy_keep(F.col("items"), 1500).alias("ids"))
    return kept.select("page_id", F.size("ids").cast("long").alias("kept"), (F.col("n") - F.size("ids")).cast("long").alias("omitted"), F.array_join(F.array_sort("ids").cast("array<string>"), ",").alias("places"))
