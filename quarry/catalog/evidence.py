"""Evidence queries: contexts, links, agreement, segments, presentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.figures import CELLS, yearly
from quarry.catalog.registry import query, read
from quarry.catalog.structure import BLOCKS, blocks, headed
from quarry.operators import structure as S


@query("two_readers_agree", """
WITH a AS (SELECT page_id, list_distinct(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)<', 1)) AS x, list_distinct(regexp_extract_all(html, '<title[^>]*>([^<]*)<', 1)) AS y FROM pages)
SELECT page_id, len(x) AS candidates, CASE WHEN len(x) = 1 AND len(y) = 1 AND trim(x[1]) = trim(y[1]) THEN trim(x[1]) END AS label, CASE WHEN len(x) <> 1 OR len(y) <> 1 THEN 'not_unique' WHEN trim(x[1]) <> trim(y[1]) THEN 'readers_disagree' ELSE 'agreed' END AS outcome FROM a""")
def two_readers_agree(spark, sf):
    """A label is taken only if two readers, of headings and of the title, have exactly one distinct candidate each and the same."""
    found = lambda p: F.array_distinct(F.regexp_extract_all("html", F.lit(p), F.lit(1)))
    rows = read(spark, sf, "pages").select("page_id", found("<h[1-6][^>]*>([^<]*)<").alias("x"), found("<title[^>]*>([^<]*)<").alias("y"))
    one, same = (F.size("x") == 1) & (F.size("y") == 1), F.btrim(F.get("x", F.lit(0))) == F.btrim(F.get("y", F.lit(0)))
    outcome = F.when(~one, "not_unique").when(~same, "readers_disagree").otherwise("agreed")
    return rows.select("page_id", F.size("x").cast("long").alias("candidates"), F.when(one & same, F.btrim(F.get("x", F.lit(0)))).alias("label"), outcome.alias("outcome"))


@query("parent_context", BLOCKS + """,
p AS (SELECT page_id, heading_pos, string_agg(text, ' ' ORDER BY pos) AS parent, count(*) AS members FROM h WHERE heading_pos IS NOT NULL GROUP BY ALL)
SELECT h.page_id, h.pos, members, CASE WHEN strlen(parent) <= 12000 THEN md5(parent) ELSE md5(h.text) END AS context, strlen(parent) <= 12000 AS expanded FROM h JOIN p ON p.page_id = h.page_id AND p.heading_pos = h.heading_pos WHERE h.tag = 'p'""")
def parent_context(spark, sf):
    """A hit brings its parent if that fits 12,000 bytes, else itself; what is not expanded says so."""
    rows = headed(spark, sf).filter("heading_pos is not null")
    parents = rows.groupBy("page_id", "heading_pos").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("parent"), F.count("*").alias("members"))
    hits = rows.filter("tag = 'p'").join(parents, ["page_id", "heading_pos"])
    fits = F.octet_length("parent") <= 12000
    return hits.select("page_id", "pos", "members", F.when(fits, F.md5("parent")).otherwise(F.md5("text")).alias("context"), fits.alias("expanded"))


@query("linked_two_hop", """
SELECT l_orderkey, l_linenumber, o_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def linked_two_hop(spark, sf):
    """Citation to row to header: foreign keys followed over several hops, for every line."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    rows = lines.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name")


@query("binding_audit", """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN abs(o_totalprice - t.total) > 0.01 THEN 'value' END, CASE WHEN t.lines IS NULL THEN 'no_lines' END, CASE WHEN t.first < o_orderdate THEN 'period' END], lambda x: x IS NOT NULL), ',') AS issues
FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS lines, min(l_shipdate) AS first FROM lineitem GROUP BY l_orderkey) t ON l_orderkey = o_orderkey""")
def binding_audit(spark, sf):
    """Each bound row against its request; every mismatch is named."""
    parts = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("lines"), F.min("l_shipdate").alias("first"))
    rows = read(spark, sf, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    issues = F.array_compact(F.array(F.when(F.abs(F.col("o_totalprice") - F.col("total")) > 0.01, "value"), F.when(F.col("lines").isNull(), "no_lines"), F.when(F.col("first") < F.col("o_orderdate"), "period")))
    return rows.select("o_orderkey", F.array_join(issues, ",").alias("issues"))


@query("running_context", BLOCKS + """
SELECT page_id, pos, last_value(CASE WHEN tag = 'p' AND length(text) < 120 THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id, heading_pos ORDER BY pos ROWS UNBOUNDED PRECEDING) AS local_context FROM h""")
def running_context(spark, sf):
    """The last short paragraph since the last heading: a running state that a heading resets."""
    w = Window.partitionBy("page_id", "heading_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    short = F.when((F.col("tag") == "p") & (F.char_length("text") < 120), F.col("pos"))
    return headed(spark, sf).select("page_id", "pos", F.last(short, ignorenulls=True).over(w).alias("local_context"))


@query("page_ranges", "SELECT DISTINCT n_regionkey, unnest(range(n_nationkey, n_nationkey + 4)) AS page FROM nation")
def page_ranges(spark, sf):
    """Inclusive ranges as distinct pages."""
    return read(spark, sf, "nation").select("n_regionkey", F.explode(F.sequence(F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") + 3)).alias("page")).distinct()


@query("ordered_union", """
WITH u AS (SELECT user_id, event_type, 0 AS src, min(event_id) AS first_id FROM events WHERE value >= 50 GROUP BY ALL UNION ALL SELECT user_id, event_type, 1, min(event_id) FROM events WHERE value < 50 GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY src, first_id) AS nth FROM u)
SELECT user_id, event_type, src, first_id FROM f WHERE nth = 1""")
def ordered_union(spark, sf):
    """Union of two lists without repeats; the first list wins."""
    rows = read(spark, sf, "events").withColumn("src", F.when(F.col("value") >= 50, 0).otherwise(1)).filter("value is not null")
    return rows.groupBy("user_id", "event_type").agg(F.min(F.struct("src", F.col("event_id").alias("first_id"))).alias("m")).select("user_id", "event_type", "m.src", "m.first_id")


@query("comparability", CELLS + """
SELECT a.metric, a.segment, a.value_year AS first_year, b.value_year AS later_year, CAST(b.value - a.value AS DOUBLE) AS difference FROM yearly a JOIN yearly b ON a.metric = b.metric AND a.segment = b.segment AND a.value_year < b.value_year""")
def comparability(spark, sf):
    """Cells that agree in everything but the period may be compared."""
    rows = yearly(spark, sf)
    a, b = rows.withColumnsRenamed({"value_year": "first_year", "value": "x"}), rows.withColumnsRenamed({"value_year": "later_year", "value": "y"})
    return a.join(b, ["metric", "segment"]).filter("first_year < later_year").select("metric", "segment", "first_year", "later_year", (F.col("y") - F.col("x")).cast("double").alias("difference"))


@query("claim_template", CELLS + """
SELECT metric || ' of ' || segment || ' in ' || value_year || ' was ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS claim, sha256(metric || '|' || segment || '|' || value_year) AS evidence FROM yearly""")
def claim_template(spark, sf):
    rows = yearly(spark, sf)
    year, value = F.col("value_year").cast("string"), F.round("value", 0).cast("bigint").cast("string")
    return rows.select(F.concat(F.col("metric"), F.lit(" of "), F.col("segment"), F.lit(" in "), year, F.lit(" was "), value).alias("claim"), F.sha2(F.concat_ws("|", "metric", "segment", year), 256).alias("evidence"))


@query("mixed_question_split", """
WITH t AS (SELECT conv_id, turn, text, strpos(text, '. ') AS cut FROM conversations WHERE role = 'user')
SELECT conv_id, turn, trim(CASE WHEN cut > 0 THEN left(text, cut) ELSE text END) AS first_part, trim(CASE WHEN cut > 0 THEN substr(text, cut + 2) ELSE '' END) AS second_part FROM t""")
def mixed_question_split(spark, sf):
    """A turn as its first sentence and what follows."""
    cut = F.instr("text", ". ")
    rows = read(spark, sf, "conversations").filter("role = 'user'").withColumn("cut", cut)
    first = F.when(F.col("cut") > 0, F.substring("text", F.lit(1), F.col("cut"))).otherwise(F.col("text"))
    rest = F.when(F.col("cut") > 0, F.substring("text", F.col("cut") + 2, F.char_length("text"))).otherwise(F.lit(""))
    return rows.select("conv_id", "turn", F.btrim(first).alias("first_part"), F.btrim(rest).alias("second_part"))


@query("entity_segments", """
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment, unnest(range(len(string_split(text, chr(10))))) AS nth FROM documents)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, array_to_string(list_sort(list_distinct(regexp_extract_all(segment, '[0-9]{4}'))), ',') AS years FROM t WHERE regexp_matches(segment, '[0-9]{4}')""")
def entity_segments(spark, sf):
    """Years bound to the segment in which they stand."""
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("nth", "segment")).filter(F.col("segment").rlike("[0-9]{4}"))
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("segment", F.lit("[0-9]{4}"), F.lit(0))))
    return rows.select("doc_id", "nth", F.array_join(years, ",").alias("years"))


@query("fill_missing_scope", """
SELECT r_name, y AS value_year, count(c_custkey) AS customers FROM region CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders) LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def fill_missing_scope(spark, sf):
    """A question without entity or year is asked of all of them: a grid of dimensions, joined to facts."""
    years = read(spark, sf, "orders").select(F.year("o_orderdate").alias("value_year")).distinct()
    people = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    rows = read(spark, sf, "region").join(people, F.col("r_regionkey") == F.col("n_regionkey"), "left").crossJoin(F.broadcast(years))
    return rows.select("r_name", "value_year", F.coalesce("n", F.lit(0)).alias("customers"))


@query("glyph_in_box", """
WITH c AS (SELECT s_suppkey, s_suppkey % 100 + 0.5 AS x, s_suppkey % 37 + 0.5 AS y FROM supplier), r AS (SELECT n_nationkey AS box, 4.0 * n_nationkey AS left_x, 4.0 * n_nationkey + 8 AS right_x, 0.0 AS low, 10.0 + n_nationkey AS high FROM nation),
m AS (SELECT s_suppkey, box, row_number() OVER (PARTITION BY s_suppkey ORDER BY (right_x - left_x) * (high - low), box) AS nth FROM c JOIN r ON x >= left_x AND x < right_x AND y >= low AND y < high)
SELECT s_suppkey, box FROM m WHERE nth = 1""")
def glyph_in_box(spark, sf):
    """The smallest rectangle that holds a point; boxes are hashed to strips of their own width, so the join has a key."""
    strip = 8.0
    points = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100 + 0.5).alias("x"), (F.col("s_suppkey") % 37 + 0.5).alias("y")).withColumn("strip", F.floor(F.col("x") / strip))
    boxes = read(spark, sf, "nation").select(F.col("n_nationkey").alias("box"), (4.0 * F.col("n_nationkey")).alias("left_x"), (4.0 * F.col("n_nationkey") + 8).alias("right_x"), (10.0 + F.col("n_nationkey")).alias("high"))
    boxes = boxes.withColumn("strip", F.explode(F.sequence(F.floor(F.col("left_x") / strip), F.floor(F.col("right_x") / strip))))
    met = points.join(boxes, "strip").filter("x >= left_x and x < right_x and y >= 0 and y < high")
    area = (F.col("right_x") - F.col("left_x")) * F.col("high")
    return met.groupBy("s_suppkey").agg(F.min(F.struct(area.alias("area"), "box")).alias("m")).select("s_suppkey", "m.box")


@query("evidence_pages", BLOCKS + """
SELECT p.page_id, count(b.pos) AS blocks, count(*) FILTER (b.tag LIKE 'h%') AS headings, CASE WHEN count(b.pos) = 0 THEN 'failed' WHEN length(max(p.html)) < 80 THEN 'sparse' ELSE 'structured' END AS status FROM pages p LEFT JOIN b ON b.page_id = p.page_id GROUP BY p.page_id""")
def evidence_pages(spark, sf):
    """Pages with what was extracted from each; a page without blocks is kept and says so."""
    per = blocks(spark, sf).groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(S.is_heading(F.col("tag"))).alias("headings"))
    rows = read(spark, sf, "pages").select("page_id", F.char_length("html").alias("n")).join(per, "page_id", "left").fillna(0, ["blocks", "headings"])
    return rows.select("page_id", "blocks", "headings", F.when(F.col("blocks") == 0, "failed").when(F.col("n") < 80, "sparse").otherwise("structured").alias("status"))


@query("canonical_rows", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS digest FROM nation")
def canonical_rows(spark, sf):
    """Canonical JSON with sorted keys, digested."""
    from quarry.sources.trec import canonical_json

    rows = canonical_json(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return rows.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), F.sha2("value", 256).alias("digest"))
