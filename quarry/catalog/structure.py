"""Queries over page blocks, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.functions.text import ascii_words
from quarry.operators import structure as S

BLOCKS = r"""
WITH raw AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>', 1) AS tags, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>', 2) AS texts FROM pages),
b AS (SELECT page_id, CAST(unnest(range(len(tags))) AS INTEGER) AS pos, lower(unnest(tags)) AS tag, trim(regexp_replace(regexp_replace(unnest(texts), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM raw),
h AS (SELECT *, max(CASE WHEN tag LIKE 'h%' THEN pos END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading_pos FROM b)"""


def blocks(spark, sf):
    return S.blocks(read(spark, sf, "pages"))


def headed(spark, sf):
    return S.with_heading(blocks(spark, sf))


@query("html_blocks", BLOCKS + "\nSELECT page_id, pos, tag, text FROM b")
def html_blocks(spark, sf):
    return blocks(spark, sf)


@query("heading_asof", BLOCKS + "\nSELECT h.page_id, h.pos, b.text AS heading FROM h LEFT JOIN b ON b.page_id = h.page_id AND b.pos = h.heading_pos")
def heading_asof(spark, sf):
    return headed(spark, sf).select("page_id", "pos", "heading")


@query("notes_until_heading", BLOCKS + "\nSELECT page_id, heading_pos, count(*) AS notes, sum(length(text)) AS chars FROM h WHERE tag NOT LIKE 'h%' AND heading_pos IS NOT NULL GROUP BY ALL")
def notes_until_heading(spark, sf):
    """What follows each heading until the next one."""
    rows = headed(spark, sf).filter(~S.is_heading(F.col("tag")) & F.col("heading_pos").isNotNull())
    return rows.groupBy("page_id", "heading_pos").agg(F.count("*").alias("notes"), F.sum(F.char_length("text")).alias("chars"))


@query("adjacent_band_join", BLOCKS + "\nSELECT a.page_id, a.pos, b.pos AS near FROM h a JOIN h b ON a.page_id = b.page_id AND a.heading_pos = b.heading_pos AND abs(a.pos - b.pos) BETWEEN 1 AND 2 WHERE a.tag NOT LIKE 'h%' AND b.tag NOT LIKE 'h%' AND length(b.text) < 1800")
def adjacent_band_join(spark, sf):
    """Neighbours within two places under one heading: equal keys, then a band, expanded by offset so that it is an equi-join."""
    rows = headed(spark, sf).filter(~S.is_heading(F.col("tag")) & F.col("heading_pos").isNotNull()).select("page_id", "heading_pos", "pos", "text")
    a = rows.select("page_id", "heading_pos", "pos", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("step")).withColumn("near", F.col("pos") + F.col("step"))
    b = rows.filter(F.char_length("text") < 1800).select("page_id", "heading_pos", F.col("pos").alias("near"))
    return a.join(b, ["page_id", "heading_pos", "near"]).select("page_id", "pos", "near")


@query("bridge_range_join", BLOCKS + """,
p AS (SELECT x.page_id, x.pos AS start, y.pos AS stop FROM b x JOIN b y ON x.page_id = y.page_id AND y.pos > x.pos AND y.pos - x.pos <= 12 WHERE x.tag = 'li' AND y.tag = 'p')
SELECT p.page_id, start, stop, count(b.pos) AS rows_between, sum(length(b.text)) AS chars FROM p JOIN b ON b.page_id = p.page_id AND b.pos > start AND b.pos < stop GROUP BY ALL""")
def bridge_range_join(spark, sf):
    """A list item and a paragraph at most twelve places below it with the rows between them; prefix sums replace the range join."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks(spark, sf).withColumn("upto", F.sum(F.char_length("text")).over(w)).withColumn("size", F.char_length("text"))
    a = rows.filter("tag = 'li'").select("page_id", F.col("pos").alias("start"), F.col("upto").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d")).withColumn("stop", F.col("start") + F.col("d"))
    b = rows.filter("tag = 'p'").select("page_id", F.col("pos").alias("stop"), (F.col("upto") - F.col("size")).alias("b"))
    return a.join(b, ["page_id", "stop"]).filter("stop - start > 1").select("page_id", "start", "stop", (F.col("stop") - F.col("start") - 1).cast("long").alias("rows_between"), (F.col("b") - F.col("a")).alias("chars"))


@query("section_expand", BLOCKS + """,
s AS (SELECT *, count(*) OVER (PARTITION BY page_id, heading_pos) AS passages, sum(length(text)) OVER (PARTITION BY page_id, heading_pos) AS chars FROM h WHERE tag = 'p' AND heading_pos IS NOT NULL)
SELECT page_id, pos, CASE WHEN passages <= 16 AND chars <= 6500 THEN 'whole_section' ELSE 'passage_only' END AS context, passages FROM s""")
def section_expand(spark, sf):
    """A hit brings its whole section if that has 16 passages and 6,500 characters at most."""
    rows = headed(spark, sf).filter("tag = 'p' and heading_pos is not null")
    w = Window.partitionBy("page_id", "heading_pos")
    rows = rows.withColumn("passages", F.count("*").over(w)).withColumn("chars", F.sum(F.char_length("text")).over(w))
    return rows.select("page_id", "pos", F.when((F.col("passages") <= 16) & (F.col("chars") <= 6500), "whole_section").otherwise("passage_only").alias("context"), "passages")


@query("driver_list_islands", BLOCKS + """,
f AS (SELECT *, tag = 'li' AS flag, coalesce(lag(tag = 'li') OVER (PARTITION BY page_id ORDER BY pos), FALSE) AS was FROM b),
i AS (SELECT *, sum(CASE WHEN flag AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM f)
SELECT page_id, island, min(pos) AS start, max(pos) AS stop, count(*) AS items FROM i WHERE flag GROUP BY page_id, island""")
def driver_list_islands(spark, sf):
    """Runs of list items: gaps and islands."""
    rows = S.islands(blocks(spark, sf), ["page_id"], "pos", F.col("tag") == "li")
    return rows.groupBy("page_id", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count("*").alias("items"))


@query("fixed_window_chunks", """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1050)) AS start FROM documents)
SELECT doc_id, start, length(substr(text, start + 1, 1200)) AS chars, md5(substr(text, start + 1, 1200)) AS digest FROM s WHERE start = 0 OR start + 150 < length(text)""")
def fixed_window_chunks(spark, sf):
    """Windows of 1,200 characters that overlap by 150."""
    rows = read(spark, sf, "documents").select("doc_id", F.explode(S.fixed_windows(F.col("text"), 1200, 150)).alias("w"))
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.char_length("w.text").cast("long").alias("chars"), F.md5("w.text").alias("digest"))


@query("sentence_chunks")
def sentence_chunks(spark, sf):
    """Chunks of at most 2,400 bytes that end at sentences where they can; sequential within a text, so Arrow batches."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return S.sentence_chunks(texts, 2400).withColumnRenamed("id", "doc_id")


@query("row_groups", BLOCKS + """,
n AS (SELECT page_id, heading_pos, pos, length(text) AS size, row_number() OVER (PARTITION BY page_id, heading_pos ORDER BY pos) AS rn FROM h WHERE tag NOT LIKE 'h%')
SELECT page_id, heading_pos, CAST((rn - 1) // 3 AS BIGINT) AS grp, min(pos) AS start, count(*) AS members, sum(size) AS chars FROM n GROUP BY ALL""")
def row_groups(spark, sf):
    """Groups of three consecutive rows under one heading."""
    w = Window.partitionBy("page_id", "heading_pos").orderBy("pos")
    rows = headed(spark, sf).filter(~S.is_heading(F.col("tag"))).withColumn("grp", F.floor((F.row_number().over(w) - 1) / 3))
    return rows.groupBy("page_id", "heading_pos", "grp").agg(F.min("pos").alias("start"), F.count("*").alias("members"), F.sum(F.char_length("text")).alias("chars"))


@query("chunk_ids", BLOCKS + """
SELECT page_id, pos, substr(sha256(page_id || '|' || pos || '|' || tag || '|' || text), 1, 24) AS chunk_id, strlen(text) AS utf8_bytes FROM b""")
def chunk_ids(spark, sf):
    """Ids from content: the same block has the same id in every build."""
    body = F.concat_ws("|", F.col("page_id").cast("string"), F.col("pos").cast("string"), "tag", "text")
    return blocks(spark, sf).select("page_id", "pos", F.substring(F.sha2(body, 256), 1, 24).alias("chunk_id"), F.octet_length("text").cast("long").alias("utf8_bytes"))


@query("header_columns", BLOCKS + """,
c AS (SELECT page_id, count(*) AS blocks, count(*) FILTER (tag LIKE 'h%') AS headings, count(*) FILTER (tag = 'p' AND length(text) > 80) AS long_cells FROM b GROUP BY page_id)
SELECT page_id, blocks, headings, long_cells, 2 * long_cells >= blocks AS glossary_like FROM c""")
def header_columns(spark, sf):
    """Shape of a page: at least half of its blocks long reads like a glossary."""
    tag = F.col("tag")
    rows = blocks(spark, sf).groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(S.is_heading(tag)).alias("headings"), F.count_if((tag == "p") & (F.char_length("text") > 80)).alias("long_cells"))
    return rows.withColumn("glossary_like", 2 * F.col("long_cells") >= F.col("blocks"))


@query("page_grid", BLOCKS + """,
g AS (SELECT page_id, pos // 4 AS r, pos % 4 AS c, text FROM b)
SELECT page_id, r AS grid_row, coalesce(max(text) FILTER (c = 0), '') AS c0, coalesce(max(text) FILTER (c = 1), '') AS c1, coalesce(max(text) FILTER (c = 2), '') AS c2, coalesce(max(text) FILTER (c = 3), '') AS c3 FROM g GROUP BY page_id, r""")
def page_grid(spark, sf):
    """Cells scattered into a dense grid of four columns, blanks empty."""
    rows = blocks(spark, sf).select("page_id", F.floor(F.col("pos") / 4).cast("int").alias("grid_row"), (F.col("pos") % 4).alias("c"), "text")
    return rows.groupBy("page_id", "grid_row").agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("text"))), F.lit("")).alias(f"c{i}") for i in range(4)])


@query("page_markdown", BLOCKS + """
SELECT page_id, md5(string_agg(CASE WHEN tag LIKE 'h%' THEN repeat('#', CAST(substr(tag, 2, 1) AS INTEGER)) || ' ' || text WHEN tag = 'li' THEN '- ' || text ELSE text END, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY page_id""")
def page_markdown(spark, sf):
    line = F.when(S.is_heading(F.col("tag")), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), F.col("text"))).when(F.col("tag") == "li", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    rows = blocks(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("page_id", F.md5(F.array_join("l.line", "\n")).alias("digest"))


@query("page_flags", "SELECT page_id, length(trim(html)) < 80 AS sparse, contains(html, chr(65533)) AS replacement FROM pages")
def page_flags(spark, sf):
    return read(spark, sf, "pages").select("page_id", (F.char_length(F.btrim("html")) < 80).alias("sparse"), F.contains("html", F.lit("�")).alias("replacement"))


@query("boundary_windows")
def boundary_windows(spark, sf):
    """Windows of 1,200 characters that end at a blank line, a line, a sentence or a space, and overlap by 150."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return S.boundary_windows(texts).withColumnRenamed("id", "doc_id")


@query("header_rows", BLOCKS + """,
m AS (SELECT page_id, pos, min(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS at_head FROM b)
SELECT page_id, count(*) FILTER (at_head = 1) AS header_rows, count(*) FILTER (at_head = 0) AS body_rows FROM m GROUP BY page_id""")
def header_rows(spark, sf):
    """Header rows are the leading marked ones only; a marked row below the first unmarked one is body."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks(spark, sf).withColumn("leading", F.min((F.char_length("text") < 40).cast("int")).over(w))
    return rows.groupBy("page_id").agg(F.count_if(F.col("leading") == 1).alias("header_rows"), F.count_if(F.col("leading") == 0).alias("body_rows"))


@query("best_bridge", BLOCKS + """,
c AS (SELECT page_id, pos, tag, CASE WHEN regexp_matches(text, 'ing\\b') THEN 1 ELSE 0 END AS candidate, CASE WHEN regexp_matches(text, 'ing\\b') THEN length(text) % 7 ELSE 0 END AS score FROM b),
p AS (SELECT x.page_id, x.pos AS start, y.pos AS stop FROM c x JOIN c y ON x.page_id = y.page_id AND y.pos > x.pos AND y.pos - x.pos <= 12 WHERE x.tag = 'li' AND y.tag = 'p'),
u AS (SELECT p.page_id, start, stop, sum(c.score) AS score, sum(c.candidate) AS touched FROM p JOIN c ON c.page_id = p.page_id AND c.pos BETWEEN start AND stop GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, start, stop) AS nth FROM u WHERE touched > 0)
SELECT page_id, start, stop, CAST(score AS BIGINT) AS score FROM r WHERE nth = 1""")
def best_bridge(spark, sf):
    """Of the bundles from a list item to a paragraph at most twelve places on that touch a candidate, the best of each page; prefix sums, then one aggregation."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("text").rlike(ascii_words("ing\\b"))
    rows = blocks(spark, sf).withColumn("candidate", hit.cast("int")).withColumn("own", F.when(hit, F.char_length("text") % 7).otherwise(0))
    rows = rows.withColumn("n", F.sum("candidate").over(w)).withColumn("total", F.sum("own").over(w))
    a = rows.filter("tag = 'li'").select("page_id", F.col("pos").alias("start"), (F.col("n") - F.col("candidate")).alias("n0"), (F.col("total") - F.col("own")).alias("t0"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d")).withColumn("stop", F.col("start") + F.col("d"))
    b = rows.filter("tag = 'p'").select("page_id", F.col("pos").alias("stop"), "n", "total")
    bundles = a.join(b, ["page_id", "stop"]).filter("n > n0").withColumn("score", F.col("total") - F.col("t0"))
    best = bundles.groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "start", "stop")).alias("m"))
    return best.select("page_id", "m.start", "m.stop", (-F.col("m.minus")).alias("score"))
