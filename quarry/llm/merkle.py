"""A Merkle manifest of a dataset: digests of rows, of runs of eight nodes in a group, of the groups, and a proof for each row.

Leaves are placed in their group by ranges of (group, doc_id), so that no task holds a group. Each level is a window: nodes are
partitioned by group and parent index, and an ordered full-frame collect_list gives the run, which is the parent's preimage and
holds the siblings of each member. The first member of each run stands for the parent at the next level. Levels are written as
they are made, and each has an eighth of the rows of the one below. Proofs come back from the top: a node's path is its siblings,
then the path of its parent, so each join has one parent and eight children at most. All of it stays in SQL functions.

Defined cases: a null value is a dash; a null lang is a group of its own, before all others; a null doc_id comes first in its
group and is never tampered with; rows that share a doc_id are ordered by their digests, and equal rows are leaves of their own;
a group of one row has its leaf as subroot, and one group alone has its subroot as root; whole texts of any length are hashed;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut, fold_ascii, spend, table
from quarry.llm.sql import CRC_TABLE, crc32, latin_octets

WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its octets counted and spelled out, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, **other: Column) -> Column:
    """The digest of a row; other: columns that take the place of its own."""
    return F.sha2(F.concat(*[field(other.get(c, docs[c])) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf and start (the leaf after tampering) of every row. group: lang behind a mark, empty for null."""
    touched = F.coalesce(F.crc32(docs.doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False)) & docs.text.rlike("[A-Z]")
    start = F.when(touched, leaf(docs, text=fold_ascii(docs.text))).otherwise(leaf(docs))
    return docs.select(F.coalesce(F.concat(F.lit("="), docs.lang), F.lit("")).alias("group"), docs.doc_id.alias("doc_id"), leaf(docs).alias("leaf"), start.alias("start"))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with at (their place in the group, from 0) and size (rows of the group), a written table.

    Rows are dealt to ranges of (group, order); a place is the rows of the group in the ranges before plus the rank in its own range.
    """
    dealt = cut(rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()), name + "-ranges")
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("n"))
    of = Window.partitionBy(group)
    shifts = counts.select(group, "range", (F.sum("n").over(of.orderBy("range")) - F.col("n")).alias("shift"), F.sum("n").over(of).alias("size"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)))
    out = cut(ranked.join(shifts, [group, "range"]).withColumn("at", F.col("shift") + F.col("rank") - 1).drop("range", "shift", "rank"), name)
    spend(dealt)
    return out


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Levels (written tables of nodes with parent and run, groups of one node left out), the groups that end below each level, and the most rows of a group.

    nodes: group, at, size, node and what else the lowest level carries.
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    run = Window.partitionBy("group", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels, ended, left = [], [nodes.filter("size = 1")], most
    while left > 1:
        runs = nodes.filter("size > 1").withColumn("parent", F.floor(F.col("at") / WIDTH)).withColumn("run", F.collect_list("node").over(run))
        levels.append(cut(runs, f"{name}-{len(levels)}"))
        first = levels[-1].filter(F.col("at") % WIDTH == 0)
        nodes = first.select("group", F.col("parent").alias("at"), F.ceil(F.col("size") / WIDTH).alias("size"), F.sha2(F.array_join("run", ""), 256).alias("node"))
        ended.append(nodes.filter("size = 1"))
        left = -(-left // WIDTH)
    return levels, ended, most


def descend(levels: list[DataFrame], ended: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The lowest nodes with path: siblings level by level, left and right of the node, and then what above (group, path, ...) has for the group."""
    extra = [c for c in above.columns if c != "group"]
    own = lambda rows: rows.join(above, "group")
    paths = own(ended[-1])
    spent = None
    for k in range(len(levels) - 1, -1, -1):
        place = (F.col("at") % WIDTH).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(WIDTH)), "").alias("after"))
        upper = paths.select("group", F.col("at").alias("parent"), *extra)
        joined = levels[k].join(upper, ["group", "parent"]).withColumn("path", F.concat(F.array(step), "path")).drop("parent", "run")
        paths = joined.unionByName(own(ended[k]).select(*joined.columns))
        if k:
            paths = cut(paths, f"{name}-path-{k}")
            spend(spent)
            spent = paths
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; see the module's docstring."""
    found = cut(leaves(docs), "leaves")
    rows = placed(found, "group", ["doc_id", "leaf"], "leaves-placed")
    spend(found)
    levels, ended, _ = climb(rows.withColumn("node", F.col("leaf")), "merkle")
    subroots = ended[0].select("group", "node")
    for nodes in ended[1:]:
        subroots = subroots.unionByName(nodes.select("group", "node"))
    tops = placed(cut(subroots, "subroots").select(F.lit("").alias("all"), "group", "node"), "all", ["group"], "subroots-placed")
    tops = tops.select(F.col("all").alias("group"), F.col("group").alias("lang"), "at", "size", "node", F.col("node").alias("subroot"))
    top_levels, top_ended, _ = climb(tops, "merkle-top")
    root = top_ended[-1].select("group", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    above = descend(top_levels, top_ended, root, "merkle-top").select(F.col("lang").alias("group"), "path", "subroot", "root")
    whole = descend(levels, ended, cut(above, "group-paths"), "merkle")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("path", F.col("start"), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
    out = whole.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


def _sql(levels: int = 9, top_levels: int = 3) -> str:
    """DuckDB SQL of the same, for groups of at most WIDTH ** levels rows."""
    spelled = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    text_of = lambda text: "sha256(" + " || ".join(spelled(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        CRC_TABLE,
        f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {text_of('text')} AS leaf, CASE WHEN {crc32(latin_octets('CAST(doc_id AS VARCHAR)'))} % 3 = 0 THEN {text_of(lower)} ELSE {text_of('text')} END AS start FROM documents, crc_table)",
        "a0 AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY g) AS size FROM l)",
    ]

    def climb_sql(a: str, n: int):
        for k in range(n):
            ctes.append(f"{a}r{k} AS (SELECT g, nth // {WIDTH} AS nth, list(node ORDER BY nth) AS run, any_value(size) AS size FROM {a}{k} WHERE size > 1 GROUP BY g, nth // {WIDTH})")
            ctes.append(f"{a}{k + 1} AS (SELECT g, nth, sha256(array_to_string(run, '')) AS node, (size + {WIDTH - 1}) // {WIDTH} AS size FROM {a}r{k})")
        ctes.append(f"{a}roots AS (" + " UNION ALL ".join(f"SELECT g, node FROM {a}{k} WHERE size = 1" for k in range(n + 1)) + ")")

    def fold_sql(a: str, n: int, rows: str):
        """Path and folded node of every row, level by level from below."""
        last = rows
        for k in range(n):
            own = f"CAST(x.nth % {WIDTH} AS INTEGER)"
            ctes.append(
                f"{a}f{k} AS (SELECT x.* EXCLUDE (nth, proof, folded), x.nth // {WIDTH} AS nth, CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(r.run[:{own}], '') || array_to_string(r.run[{own} + 2:], '') END AS proof,"
                f" CASE WHEN r.run IS NULL THEN folded ELSE sha256(array_to_string(r.run[:{own}], '') || folded || array_to_string(r.run[{own} + 2:], '')) END AS folded FROM {last} x LEFT JOIN {a}r{k} r ON r.g = x.g AND r.nth = x.nth // {WIDTH})"
            )
            last = f"{a}f{k}"
        return last

    climb_sql("a", levels)
    ctes.append("t0 AS (SELECT '' AS g, g AS lang, node, row_number() OVER (ORDER BY g) - 1 AS nth, count(*) OVER () AS size FROM aroots)")
    climb_sql("t", top_levels)
    ctes.append("s0 AS (SELECT doc_id, leaf, g, nth, '' AS proof, start AS folded FROM a0)")
    low = fold_sql("a", levels, "s0")
    ctes.append(f"s1 AS (SELECT x.doc_id, x.leaf, t0.node AS subroot, t0.g, t0.nth, x.proof, x.folded FROM {low} x JOIN t0 ON t0.lang = x.g)")
    high = fold_sql("t", top_levels, "s1")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {high}, (SELECT node AS root FROM troots)"


SQL = _sql()
