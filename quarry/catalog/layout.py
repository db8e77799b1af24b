"""Queries over trees of elements, boxes on a plane, and contexts that are folded under a budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.catalog.registry import query, read
from quarry.catalog.retrieval import plain_sql
from quarry.functions.text import plain_tokens
from quarry.operators import boxes as B
from quarry.operators import context as C
from quarry.operators import elements as E
from quarry.scratch import cut

# elements --------------------------------------------------------------------------------------------------------------

_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_rules = ", ".join(f"('{tag}', {_names(ends)}, {_names(barrier)})" for tag, (ends, barrier) in E.CLOSES.items())
_TOKEN = E.TOKEN.replace("{end}", r"\z").replace("'", "''")
#: The stack of open elements goes through the tags one by one; up: the ancestors of an element, itself last.
TREE = f"""
WITH RECURSIVE rule(tag, ends, barrier) AS (VALUES {_rules}),
tokens AS (SELECT page_id, list_filter(regexp_extract_all(html, '{_TOKEN}'), lambda t: t[2] <> '!') AS ts FROM pages),
token AS (SELECT page_id, unnest(range(1, len(ts) + 1)) AS k, unnest(ts) AS t FROM tokens),
named AS (SELECT page_id, k, t LIKE '</%' AS closes, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM token),
step AS (SELECT n.*, coalesce(ends, []::VARCHAR[]) AS ends, coalesce(barrier, []::VARCHAR[]) AS barrier FROM named n LEFT JOIN rule USING (tag)),
w AS (
  SELECT page_id, 0::BIGINT AS k, []::STRUCT(tag VARCHAR, node INTEGER)[] AS up, []::STRUCT(tag VARCHAR, node INTEGER)[] AS stack, 0 AS seen, FALSE AS made FROM tokens WHERE len(ts) > 0
  UNION ALL
  SELECT page_id, k, CASE WHEN closes THEN base ELSE list_append(base, me) END, CASE WHEN closes OR tag IN ({", ".join(f"'{t}'" for t in (*E.VOID, *E.RAW))}) THEN base ELSE list_append(base, me) END,
    seen + CASE WHEN closes THEN 0 ELSE 1 END, NOT closes
  FROM (SELECT page_id, k, tag, closes, seen, struct_pack(tag := tag, node := seen) AS me, stack[1:keep] AS base
    FROM (SELECT *, coalesce(CASE WHEN closes THEN list_max(list_filter(range(1, len(stack) + 1), lambda i: stack[i].tag = tag)) - 1
        ELSE list_min(list_filter(range(1, len(stack) + 1), lambda i: list_contains(ends, stack[i].tag) AND i > above)) - 1 END, len(stack)) AS keep
      FROM (SELECT s.page_id, s.k, s.tag, s.closes, s.ends, w.stack, w.seen, coalesce(list_max(list_filter(range(1, len(w.stack) + 1), lambda i: list_contains(s.barrier, w.stack[i].tag))), 0) AS above
        FROM w JOIN step s ON s.page_id = w.page_id AND s.k = w.k + 1)))),
made AS (SELECT page_id, up, up[-1].node AS node, up[-1].tag AS tag FROM w WHERE made),
inside AS (SELECT page_id, unnest(list_transform(up, lambda u: u.node)) AS node, node AS n FROM made),
tree AS (SELECT m.page_id, m.node, l.last, m.up[-2].node AS parent, m.tag, array_to_string(list_transform(m.up, lambda u: u.tag), '/') AS path, m.up
  FROM made m JOIN (SELECT page_id, node, max(n) AS last FROM inside GROUP BY ALL) l ON l.page_id = m.page_id AND l.node = m.node)"""


def elements(spark, sf):
    return E.elements(read(spark, sf, "pages"))


@query("page_elements", TREE + "\nSELECT page_id, node, last, parent, tag, path FROM tree")
def page_elements(spark, sf):
    """Every element of every page in reading order, with the range of what lies in it."""
    return elements(spark, sf)


PLACED, AROUND = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li"], ["nav", "article", "ul", "ol", "table"]


@query("block_places", TREE + f"""
SELECT page_id, node, tag, path, list_contains(around, 'nav') AS in_nav, list_contains(around, 'article') AS in_article, array_to_string(list_filter(around, lambda a: a IN ('ul', 'ol')), '/') AS lists
FROM (SELECT *, list_filter(list_transform(up[:-2], lambda u: u.tag), lambda a: list_contains({_names(AROUND)}, a)) AS around FROM tree WHERE list_contains({_names(PLACED)}, tag))""")
def block_places(spark, sf):
    """For each heading, paragraph and list item: whether it is navigation or article, and the lists it lies in, by intervals of the tree."""
    rows = E.within(cut(elements(spark, sf), "elements"), PLACED, AROUND)
    has = lambda tag: F.array_contains("around", tag)
    return rows.select("page_id", "node", "tag", "path", has("nav").alias("in_nav"), has("article").alias("in_article"), F.array_join(F.filter("around", lambda a: a.isin("ul", "ol")), "/").alias("lists"))


# boxes -----------------------------------------------------------------------------------------------------------------

#: A line stands for a printed ')' at price and quantity, an order for a filled box; shades from 0 (black) to 1 (paper).
GLYPHS = """
WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity * 2000 AS y, 1 - l_discount AS shade FROM lineitem),
b AS (SELECT o_orderkey AS id, o_totalprice / 5 AS x0, (o_orderkey * 7919 % 100000)::DOUBLE AS y0, o_totalprice / 5 + s AS x1, o_orderkey * 7919 % 100000 + s / 2 AS y1, 1 - (o_custkey % 11) / 100.0::DOUBLE AS shade
  FROM (SELECT *, CASE WHEN o_orderkey % 500 = 0 THEN 30000.0 ELSE 200.0 + o_custkey % 1000 END::DOUBLE AS s FROM orders)),
place AS (SELECT DISTINCT x, y FROM g WHERE x IS NOT NULL AND y IS NOT NULL),
held AS (SELECT p.x, p.y, arg_min({'id': b.id, 'shade': b.shade}, {'a': (x1 - x0) * (y1 - y0), 'id': b.id}) AS box FROM place p JOIN b ON p.x >= b.x0 AND p.x <= b.x1 AND p.y >= b.y0 AND p.y <= b.y1 GROUP BY ALL)"""
HIDDEN = "coalesce(shade >= 0.9 AND abs(shade - coalesce(ground, 1.0)) < 0.01, FALSE)"


def glyphs(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 2000).alias("y"), (1 - F.col("l_discount")).alias("shade"))


def fills(spark, sf):
    size = F.when(F.col("o_orderkey") % 500 == 0, F.lit(30000.0)).otherwise(200.0 + F.col("o_custkey") % 1000)
    x, y = F.col("o_totalprice") / 5, (F.col("o_orderkey") * 7919 % 100000).cast("double")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size / 2).alias("y1"), (1 - (F.col("o_custkey") % 11) / F.lit(100.0)).alias("shade"))


@query("glyph_corrections", GLYPHS + f"""
SELECT l_orderkey, l_linenumber, box.id AS box, CASE WHEN {HIDDEN} THEN 'corrected' ELSE 'unresolved' END AS state
FROM (SELECT g.*, held.box, held.box.shade AS ground FROM g LEFT JOIN held ON held.x = g.x AND held.y = g.y)""")
def glyph_corrections(spark, sf):
    """A light bracket of the shade of the smallest box around it (paper, where there is none) cannot be seen and goes; what stays open is listed too."""
    found = B.smallest_box(glyphs(spark, sf), fills(spark, sf))
    rows = glyphs(spark, sf).join(found, ["x", "y"], "left").withColumn("ground", F.col("box.shade"))
    return rows.select("l_orderkey", "l_linenumber", F.col("box.id").alias("box"), F.when(F.expr(HIDDEN), "corrected").otherwise("unresolved").alias("state"))


# contexts --------------------------------------------------------------------------------------------------------------

#: Words that a context may have, hits of each role, and turns that make a passage.
BUDGET, DEPTH, PASSAGE = 200, 4, 3
CHATS = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, len(string_split_regex(coalesce(text, ''), '[ \\n]+'))::BIGINT AS size, list_distinct({plain_sql("coalesce(text, '')")}) AS words FROM conversations),
last AS (SELECT conv_id, max(turn) AS turn FROM t WHERE role = 'user' GROUP BY conv_id),
q AS (SELECT t.conv_id, t.turn AS asked, t.words AS wanted FROM t JOIN last ON last.conv_id = t.conv_id AND last.turn = t.turn),
s AS (SELECT t.*, len(list_intersect(words, wanted)) AS score FROM t JOIN q USING (conv_id) WHERE turn <> asked),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY score DESC, turn) AS depth FROM s WHERE score > 0),
hit AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth, role) AS place FROM r WHERE depth <= {DEPTH}),
p AS (SELECT conv_id, turn // {PASSAGE} AS passage, list(turn ORDER BY turn) AS units, sum(size)::BIGINT AS size, bool_or(role = 'system') AS barred FROM s GROUP BY ALL),
e AS (SELECT conv_id, 1 AS stage, place, 't' || turn AS id, [turn] AS units, size, role = 'system' AS barred FROM hit
  UNION ALL SELECT h.conv_id, 2, place, 't' || s.turn, [s.turn], s.size, s.role = 'system' FROM hit h JOIN s ON s.conv_id = h.conv_id AND s.turn = h.turn + 1
  UNION ALL SELECT h.conv_id, 3, place, 'p' || passage, p.units, p.size, p.barred FROM hit h JOIN p ON p.conv_id = h.conv_id AND p.passage = h.turn // {PASSAGE}),
ev AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY stage, place, id) AS k FROM e),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, []::STRUCT(id VARCHAR, units BIGINT[], size BIGINT)[] AS kept, []::VARCHAR[] AS left_out FROM ev
  UNION ALL
  SELECT conv_id, k, CASE WHEN there OR reason IS NOT NULL THEN kept WHEN stage = 3 AND spot > 0 THEN list_concat(list_append(kept[1:spot - 1], me), list_filter(kept[spot:], lambda r: NOT list_has_all(units, r.units))) ELSE list_append(kept, me) END,
    CASE WHEN there OR reason IS NULL THEN left_out ELSE list_append(left_out, id || ':' || reason) END
  FROM (SELECT *, CASE WHEN barred THEN 'quarantine' WHEN coalesce(list_sum(list_transform(rest, lambda r: r.size)), 0) + size > {BUDGET} THEN 'budget' END AS reason
    FROM (SELECT ev.conv_id, ev.k, ev.stage, ev.id, ev.units, ev.size, ev.barred, w.kept, w.left_out, struct_pack(id := ev.id, units := ev.units::BIGINT[], size := ev.size) AS me,
      CASE WHEN ev.stage = 3 THEN list_has_all(flatten(list_transform(w.kept, lambda r: r.units)), ev.units) ELSE list_contains(list_transform(w.kept, lambda r: r.id), ev.id) END AS there,
      CASE WHEN ev.stage = 3 THEN list_filter(w.kept, lambda r: NOT list_has_all(ev.units, r.units)) ELSE w.kept END AS rest,
      coalesce(list_position(list_transform(w.kept, lambda r: list_has_all(ev.units, r.units)), TRUE), 0) AS spot
      FROM w JOIN ev ON ev.conv_id = w.conv_id AND ev.k = w.k + 1))),
z AS (SELECT conv_id, arg_max({{'kept': kept, 'left_out': left_out}}, k) AS c FROM w GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(c.kept, lambda r: r.id), ' ') AS kept, array_to_string(c.left_out, ' ') AS left_out, coalesce(list_sum(list_transform(c.kept, lambda r: r.size)), 0)::BIGINT AS used FROM z"""


@query("folded_context", CHATS)
def folded_context(spark, sf):
    """What to show for the last question of a conversation: turns that share words with it, roles taking turns, then the turns after them, then whole passages.

    A system turn is never shown. Everything lies under one budget of words, and what was refused is listed with the reason.
    """
    text = F.coalesce("text", F.lit(""))
    turns = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.size(F.split(text, "[ \\n]+")).cast("long").alias("size"), F.array_distinct(plain_tokens(text)).alias("words"))
    last = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by(F.struct(F.col("turn").alias("asked"), F.col("words").alias("wanted")), "turn").alias("q"))
    scored = turns.join(last, "conv_id").filter("turn <> q.asked").select("conv_id", "turn", "role", "size", F.size(F.array_intersect("words", "q.wanted")).alias("score"))
    rest = cut(scored, "scored-turns")
    depth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("score"), "turn"))
    hits = C.zipped(rest.filter("score > 0").withColumn("depth", depth).filter(F.col("depth") <= DEPTH), ["conv_id"], "role", "depth").select("conv_id", F.col("turn").alias("hit"), "place")
    turn = [F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.array("turn").alias("units"), "size", (F.col("role") == "system").alias("barred")]
    event = lambda rows, stage, *cols: rows.select("conv_id", F.lit(stage).alias("stage"), "place", *cols)
    passage = F.floor(F.col("turn") / PASSAGE)
    passages = rest.groupBy("conv_id", passage.alias("passage")).agg(F.array_sort(F.collect_list("turn")).alias("units"), F.sum("size").alias("size"), F.bool_or(F.col("role") == "system").alias("barred"))
    own = event(hits.join(rest.withColumn("hit", F.col("turn")), ["conv_id", "hit"]), 1, *turn)
    notes = event(hits.join(rest.withColumn("hit", F.col("turn") - 1), ["conv_id", "hit"]), 2, *turn)
    parents = event(hits.withColumn("passage", F.floor(F.col("hit") / PASSAGE)).join(passages, ["conv_id", "passage"]), 3, F.concat(F.lit("p"), F.col("passage").cast("string")).alias("id"), "units", "size", "barred")
    done = C.fold(own.unionByName(notes).unionByName(parents), ["conv_id"], BUDGET)
    left = F.transform("left", lambda r: F.concat_ws(":", r["id"], r["reason"]))
    return done.select("conv_id", F.array_join("kept.id", " ").alias("kept"), F.array_join(left, " ").alias("left_out"), "used")
