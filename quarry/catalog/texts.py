"""Queries over text and number functions, on whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.catalog.retrieval import STEM_SQL, TOKENS_SQL, aliased
from quarry.functions import numbers as N
from quarry.functions import text as X
from quarry.operators.similar_words import closest

WS = "[ \\t\\n\\r\\f\\x0B]+"


def docs(spark, sf):
    return read(spark, sf, "documents")


@query("tokenise_alias", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {aliased('text')} AS k FROM documents)")
def tokenise_alias(spark, sf):
    return docs(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("norm_text", "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'), ' ')) AS digest FROM documents")
def norm_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.norm(F.col("text"))).alias("digest"))


@query("stem_words", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {STEM_SQL.format(t='text')} AS k FROM documents)")
def stem_words(spark, sf):
    return docs(spark, sf).select("doc_id", X.stem_words(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("clean_query", f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(please|kindly|thanks|thank you)\\b[.,!]?', '', 'g'), '(?i),?[ ]*as originally reported', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS cleaned
FROM conversations WHERE role = 'user'""")
def clean_query(spark, sf):
    """User turns without politeness and format instructions."""
    t = F.regexp_replace("text", X.ascii_words("(?i)\\b(please|kindly|thanks|thank you)\\b[.,!]?"), "")
    t = F.regexp_replace(t, "(?i),?[ ]*as originally reported", "")
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", X.squash(t).alias("cleaned"))


#: Words of the field that a repair may lead to, beside the words of the passages.
FIELD = ["commonwealth", "australia", "interest", "dividend", "deposits", "customer", "statutory", "earnings", "expenses", "impairment", "liquidity", "margin", "share", "earning", "deposit", "shares", "customers", "margins", "expense"]


SLIPS = ["intrest", "earnnings", "depositts", "custmers", "liquidty", "statutery", "commonwelth", "impairmants", "comonwealthh", "dividned"]

#: The closest entries by matching blocks: every pair of words within the edit distance, its blocks split again and again.
CLOSEST_SQL = f"""
v AS (SELECT DISTINCT y FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS y FROM benchmark UNION ALL SELECT unnest({FIELD})) WHERE length(y) >= 5),
w AS (SELECT DISTINCT x FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM conversations WHERE role = 'user' UNION ALL SELECT unnest({SLIPS})) WHERE length(x) >= 5 AND x NOT IN (SELECT y FROM v)),
m AS (SELECT x, y FROM w JOIN v ON abs(length(x) - length(y)) * 100 <= 14 * (length(x) + length(y)) WHERE levenshtein(x, y) * 100 <= 14 * (length(x) + length(y))),
blocks AS (SELECT x, y, 1 AS a, length(y) + 1 AS a2, 1 AS b, length(x) + 1 AS b2, CAST(0 AS BIGINT) AS k FROM m
  UNION ALL SELECT x, y, s.a, s.a2, s.b, s.b2, s.k FROM (SELECT x, y, unnest([{{'a': a, 'a2': -t.i, 'b': b, 'b2': -t.j, 'k': t.k}}, {{'a': t.k - t.i, 'a2': a2, 'b': t.k - t.j, 'b2': b2, 'k': CAST(0 AS BIGINT)}}]) AS s
    FROM (SELECT *, list_max(flatten([[{{'k': len(list_filter(range(1, least(a2 - i, b2 - j) + 1), lambda n: substr(y, i, n) = substr(x, j, n))), 'i': -i, 'j': -j}} FOR j IN range(b, b2)] FOR i IN range(a, a2)])) AS t
      FROM blocks WHERE a < a2 AND b < b2) WHERE t.k > 0)),
r AS (SELECT x, y, 2 * sum(k) / (length(x) + length(y))::DOUBLE AS ratio FROM blocks GROUP BY x, y),
fixes AS (SELECT x, y, ratio FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY ratio DESC, y DESC) AS n FROM r WHERE ratio >= 0.86) WHERE n = 1)"""


def fixes(spark, sf):
    """word, fixed, ratio of the users' words that need a repair and have one."""
    words = lambda rows: rows.select(F.explode(X.found(F.col("text"), "[a-z]+")).alias("word"))
    extra = lambda some: spark.createDataFrame([(w,) for w in some], "word string")
    known = words(read(spark, sf, "benchmark")).unionByName(extra(FIELD)).filter(F.length("word") >= 5).distinct()
    asked = words(read(spark, sf, "conversations").filter("role = 'user'")).unionByName(extra(SLIPS)).filter(F.length("word") >= 5).distinct()
    return closest(asked.join(known, "word", "left_anti"), known)


@query("spell_fix", f"WITH RECURSIVE {CLOSEST_SQL} SELECT x AS word, y AS fixed, round(ratio, 6) AS ratio FROM fixes")
def spell_fix(spark, sf):
    """Words of five letters or more that the vocabulary lacks, each with the closest entry by matching blocks, if similar enough.

    The vocabulary is of the passages and the field. Some slips of the field's words join the users' words.
    """
    return fixes(spark, sf).select("word", "fixed", F.round("ratio", 6).alias("ratio"))


@query("repaired_turns", f"""WITH RECURSIVE {CLOSEST_SQL},
u AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS parts FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, text, unnest(parts) AS part, unnest(range(len(parts))) AS nth FROM u),
f AS (SELECT p.*, y FROM p LEFT JOIN fixes ON lower(part) = x)
SELECT conv_id, turn, md5(regexp_replace(string_agg(coalesce(y, part), '' ORDER BY nth), '(?i)\\bFY[ ]*(24|25)\\b', 'FY20\\1', 'g')) AS repaired, coalesce(string_agg(DISTINCT part || '>' || y, ' ' ORDER BY part || '>' || y), '') AS changes FROM f GROUP BY conv_id, turn, text""")
def repaired_turns(spark, sf):
    """User turns with each misspelt word replaced and two-digit years written out, and every change. A turn meets only its own repairs."""
    turns = read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text").filter("text <> ''")
    key = ["conv_id", "turn", "digest"]
    turns = turns.withColumn("digest", F.md5("text")).withColumn("parts", F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)))
    met = turns.select(*key, F.explode(F.array_distinct("parts")).alias("part")).filter(F.length("part") >= 5).join(fixes(spark, sf).select(F.col("word"), "fixed"), F.lower("part") == F.col("word"))
    per = met.groupBy(*key).agg(F.collect_set(F.struct("part", "fixed")).alias("changes"))
    rows = turns.join(per, key, "left").withColumn("changes", F.array_sort(F.coalesce("changes", F.array().cast("array<struct<part: string, fixed: string>>"))))
    fix = F.map_from_entries("changes")
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(F.element_at(fix, p), p)), "")
    text = F.regexp_replace(text, X.ascii_words("(?i)\\bFY[ ]*(24|25)\\b"), "FY20$1")
    named = F.array_sort(F.transform("changes", lambda c: F.concat(c.part, F.lit(">"), c.fixed)))
    return rows.select("conv_id", "turn", F.md5(text).alias("repaired"), F.array_join(named, " ").alias("changes"))


@query("ngrams_overlap", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
qg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM q))
SELECT item_id, doc_id, count(*) AS shared FROM dg JOIN qg USING (g) GROUP BY ALL""")
def ngrams_overlap(spark, sf):
    """Five-word grams that passages and documents share."""
    grams = lambda df, key: df.select(key, X.plain_tokens(F.col("text")).alias("w")).select(key, F.explode(X.ngrams(F.col("w"), 5)).alias("g"))
    return grams(docs(spark, sf), "doc_id").join(grams(read(spark, sf, "benchmark"), "item_id"), "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("followup_resolve", """
WITH u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user')
SELECT conv_id, turn, length(text) < 60 AND previous IS NOT NULL AS inherits, CASE WHEN length(text) < 60 AND previous IS NOT NULL THEN previous || ' ' || text ELSE text END AS resolved FROM u""")
def followup_resolve(spark, sf):
    """A short user turn inherits the user turn before it; any other stands alone."""
    turns = read(spark, sf, "conversations").filter("role = 'user'")
    previous = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("previous", previous).withColumn("inherits", (F.length("text") < 60) & F.col("previous").isNotNull())
    return rows.select("conv_id", "turn", "inherits", F.when(F.col("inherits"), F.concat_ws(" ", "previous", "text")).otherwise(F.col("text")).alias("resolved"))


@query("byte_size", "SELECT doc_id, strlen(text) AS bytes, length(text) AS points FROM documents")
def byte_size(spark, sf):
    return docs(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("points"))


@query("squash_space", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM documents")
def squash_space(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.squash(F.col("text"))).alias("digest"))


@query("label_keys", "SELECT p_partkey, regexp_replace(regexp_replace(lower(translate(p_name || ' (' || p_brand || ')', '¹²³⁰⁴⁵⁶⁷⁸⁹', '')), '\\([^()]*\\)', '', 'g'), '[^a-z0-9]+', '', 'g') AS k FROM part")
def label_keys(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return read(spark, sf, "part").select("p_partkey", X.label_key(name).alias("k"))


RAW = "unnest(regexp_extract_all(text, '[-+(]?[0-9][0-9,.]*[%)]*'))"
CELLS = f"WITH c AS (SELECT doc_id, {RAW} AS cell FROM documents UNION ALL SELECT doc_id, unnest(['', '-', '(1,234)', '12%', '1 234', '908,812)', '1,234.5', '–']) FROM documents)"


def numeric_cells(spark, sf):
    found = F.regexp_extract_all("text", F.lit("[-+(]?[0-9][0-9,.]*[%)]*"), F.lit(0))
    odd = F.array(*map(F.lit, ["", "-", "(1,234)", "12%", "1 234", "908,812)", "1,234.5", "–"]))
    return docs(spark, sf).select("doc_id", F.explode(F.concat(found, odd)).alias("cell"))


STRICT = "^(-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?|[(]([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?[)])%?$"


@query("parse_number_strict", CELLS + f"""
SELECT doc_id, count(*) AS cells, count(v) AS parsed, CAST(sum(v) AS DOUBLE) AS total FROM (
  SELECT doc_id, CASE WHEN regexp_matches(trim(cell), '{STRICT}') THEN try_cast(CASE WHEN trim(cell) LIKE '(%' THEN '-' ELSE '' END || regexp_replace(trim(cell), '[%,()]', '', 'g') AS DECIMAL(20, 4)) END AS v FROM c) GROUP BY doc_id""")
def parse_number_strict(spark, sf):
    """Strict literals as decimals; blank and dash stay null and count as unparsed."""
    rows = numeric_cells(spark, sf).withColumn("v", N.parse_number(F.col("cell")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("cells"), F.count("v").alias("parsed"), F.sum("v").cast("double").alias("total"))


LOOSE = N.LOOSE.replace("\\t", "\t")


@query("classify_cells", CELLS + f"""
SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(trim(cell), '{LOOSE}') AND length(cell) - length(replace(cell, '%', '')) <= 1 THEN 'numeric_scalar' WHEN regexp_matches(cell, '[0-9]') THEN 'uncheckable_numeric_text'
  WHEN trim(cell) = '' THEN 'empty' WHEN trim(cell) IN ('-', '–', '—') THEN 'placeholder_not_zero' ELSE 'non_numeric_text' END AS kind FROM c) GROUP BY ALL""")
def classify_cells(spark, sf):
    return numeric_cells(spark, sf).groupBy("doc_id", N.classify(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


@query("loose_numbers", CELLS + f"""
SELECT doc_id, count(*) AS numbers, count(*) FILTER (contains(cell, '%')) AS percents, CAST(sum(CASE WHEN regexp_matches(trim(cell), '^[-(−]') THEN -v ELSE v END) AS DOUBLE) AS total FROM (
  SELECT doc_id, cell, try_cast(regexp_replace(cell, '[^0-9.]', '', 'g') AS DECIMAL(20, 4)) AS v FROM c WHERE regexp_matches(trim(cell), '{LOOSE}') AND length(cell) - length(replace(cell, '%', '')) <= 1) WHERE v IS NOT NULL GROUP BY doc_id""")
def loose_numbers(spark, sf):
    """Cells read by the looser grammar as a signed value and whether it is a percentage."""
    value, percent = N.loose_number(F.col("cell"))
    rows = numeric_cells(spark, sf).withColumn("v", value).withColumn("percent", percent).filter("v is not null")
    return rows.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.count_if("percent").alias("percents"), F.sum("v").cast("double").alias("total"))


@query("compact_keys")
def compact_keys(spark, sf):
    """Names in compatibility form, without white space and case folded, and whether they have the shape of a number; Arrow batches, as the engine has no such form."""
    rows = read(spark, sf, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" ﬁ ① Ｎｏ"), F.col("p_size").cast("string")).alias("name"))
    return rows.select("p_partkey", X.compact(F.col("name")).alias("k"), F.btrim("name").rlike("^[-(]?[0-9][0-9,.]*[)%]*$").alias("numeric"))


@query("number_sets", """
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[(][0-9][0-9,]*(?:[.][0-9]+)?[)]|[-+]?[0-9][0-9,]*(?:[.][0-9]+)?')) AS x FROM documents),
v AS (SELECT doc_id, try_cast(CASE WHEN x LIKE '(%' THEN '-' ELSE '' END || regexp_replace(x, '[,()+]', '', 'g') AS DECIMAL(38, 6)) AS v FROM r)
SELECT doc_id, count(DISTINCT v) AS numbers, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most FROM v WHERE v IS NOT NULL GROUP BY doc_id""")
def number_sets(spark, sf):
    rows = docs(spark, sf).select("doc_id", N.number_set(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("numbers"), F.col("s")[0].cast("double").alias("least"), F.element_at("s", -1).cast("double").alias("most"))


@query("column_dates", """
WITH h AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d %b %y') WHEN 1 THEN strftime(o_orderdate, '%b %Y') ELSE strftime(o_orderdate, '%b %y') || ' vs last' END AS header, o_orderdate AS d FROM orders)
SELECT o_orderkey, header, CASE o_orderkey % 3 WHEN 2 THEN NULL WHEN 1 THEN CASE WHEN year(d) >= 2000 THEN strftime(last_day(d), '%Y-%m-%d') END WHEN 0 THEN CASE WHEN year(d) < 2000 THEN strftime(d + INTERVAL 100 YEAR, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END END AS iso FROM h""")
def column_dates(spark, sf):
    """Headers written three ways from order dates and read back; years are of this century, comparisons and other years are no dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    header = F.when(k == 0, F.date_format(d, "dd MMM yy")).when(k == 1, F.date_format(d, "MMM yyyy")).otherwise(F.concat(F.date_format(d, "MMM yy"), F.lit(" vs last")))
    return read(spark, sf, "orders").select("o_orderkey", header.alias("header")).withColumn("iso", N.column_date(F.col("header")))


@query("unit_scale", """
WITH u AS (SELECT p_partkey, p_retailprice, ['AUD million', 'AUD billion', 'AUD', 'cents/share', 'AUD/share', 'percent', 'unknown'][1 + p_partkey % 7] AS unit FROM part)
SELECT p_partkey, unit, CASE WHEN unit IN ('AUD million', 'AUD billion', 'AUD') THEN 'AUD' WHEN unit IN ('cents/share', 'AUD/share') THEN 'AUD/share' WHEN unit = 'percent' THEN 'percent' END AS dimension,
  CAST(round(CAST(p_retailprice AS DECIMAL(20, 4)) * CASE unit WHEN 'AUD million' THEN 1000000 WHEN 'AUD billion' THEN 1000000000 WHEN 'cents/share' THEN 0.01 WHEN 'unknown' THEN NULL ELSE 1 END, 6) AS DOUBLE) AS value FROM u""")
def unit_scale(spark, sf):
    names = F.array(*map(F.lit, ["AUD million", "AUD billion", "AUD", "cents/share", "AUD/share", "percent", "unknown"]))
    rows = read(spark, sf, "part").withColumn("unit", F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")))
    dimension, scale = N.unit_scale(F.col("unit"))
    return rows.select("p_partkey", "unit", dimension.alias("dimension"), (F.col("p_retailprice").cast("decimal(20,4)") * scale).cast("double").alias("value"))


@query("thousands_format", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || regexp_replace(format('{:,}', CAST(floor(abs(CAST(c_acctbal AS DECIMAL(20, 4)))) AS BIGINT)), '^$', '') ||
  regexp_replace(regexp_replace('.' || lpad(CAST(CAST((abs(CAST(c_acctbal AS DECIMAL(20, 4))) - floor(abs(CAST(c_acctbal AS DECIMAL(20, 4))))) * 10000 AS BIGINT) AS VARCHAR), 4, '0'), '0+$', ''), '^[.]$', '') AS shown FROM customer""")
def thousands_format(spark, sf):
    """Separators without rounding."""
    return read(spark, sf, "customer").select("c_custkey", N.thousands(F.col("c_acctbal").cast("decimal(20,4)")).alias("shown"))
