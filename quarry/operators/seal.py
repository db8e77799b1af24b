"""A seal of a table: SHA-256 over key ranges, level by level, so that any order of rows gives one root and a changed row is found by descent.

A key's digest is over its rows' digests in order, each with its number of copies. Above it, a node of level n covers the keys that agree
but for their last 12n bits, and its digest is over its children's places and digests; the root is over what level 5 holds (16
nodes and the null key's at most). A task holds the children of a node (4,096 at most, by key) or the different rows of one key.
Copies are counted before they meet, so a row that a third of the table repeats is one row.

Seals lie under a path, a folder for each level, sorted by part and place. Comparing two reads a level's children of differing
nodes only: up to 1,000 of them are named to the scan, more are joined.

Defined cases: a null part and a null key are a part and a key like others; null fields differ from empty ones; an empty table has
no parts; extra columns are left out unless they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scratch import cut

BITS, LEVELS, NAMED = 12, 6, 1000


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as text, each by its size in bytes, a colon and the value, or a dash for null."""
    cells = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in cells)), 256)


def _digest(*of: Column) -> Column:
    """Over a group's rows in the order of their values."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*of))), lambda s: F.concat_ws(":", *(s[f"c{i}"].cast("string") for i in range(len(of))))), ","), 256)


def seal(rows: DataFrame, part: str, key: str, columns: list[str], path: str) -> DataFrame:
    """Write the seal of rows under path, a tree for each part; return part, members, root. key is an integer column."""
    spark = rows.sparkSession
    row = rows.select(F.col(part).alias("part"), F.col(key).cast("long").alias("node"), row_digest(*columns).alias("row"))
    copies = row.groupBy("part", "node", "row").agg(F.count("*").alias("copies"))
    level = copies.groupBy("part", "node").agg(_digest(F.col("row").alias("c0"), F.col("copies").alias("c1")).alias("digest"), F.sum("copies").alias("members"))
    for n in range(LEVELS):
        up = F.shiftright("node", BITS) if n < LEVELS - 1 else F.lit(0).cast("long")
        level.withColumn("up", up).sortWithinPartitions("part", "up", "node").write.parquet(f"{path}/level={n}")
        below = spark.read.parquet(f"{path}/level={n}")
        level = below.groupBy("part", F.col("up").alias("node")).agg(_digest(F.coalesce("node", F.lit(-1 << 63)).alias("c0"), F.col("digest").alias("c1")).alias("digest"), F.sum("members").alias("members"))
    level.write.parquet(f"{path}/root")
    return spark.read.parquet(f"{path}/root").select("part", "members", F.col("digest").alias("root"))


def _unlike(old: DataFrame, new: DataFrame) -> DataFrame:
    """part, node and status of the nodes that differ: lost, added or changed."""
    a, b = (df.select("part", "node", F.col("digest").alias(name)) for df, name in ((old, "old"), (new, "new")))
    # a null place or part joins like any other
    on = [a.part.eqNullSafe(b.part), a.node.eqNullSafe(b.node)]
    met = a.join(b, on, "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("new").isNull(), "lost").when(F.col("old").isNull(), "added").otherwise("changed")
    return met.select(F.when(F.col("old").isNull(), b.part).otherwise(a.part).alias("part"), F.when(F.col("old").isNull(), b.node).otherwise(a.node).alias("node"), status.alias("status"))


def _children(level: DataFrame, nodes: DataFrame, named: list | None) -> DataFrame:
    """The rows of a level under the given nodes."""
    if named is not None:
        places = sorted({r.node for r in named if r.node is not None})
        test = F.col("up").isin(places) if places else F.lit(False)
        level = level.filter(test | F.col("up").isNull() if any(r.node is None for r in named) else test)
    n = nodes.select(F.col("part").alias("np"), F.col("node").alias("nn"))
    return level.join(n, level.part.eqNullSafe(n.np) & level.up.eqNullSafe(n.nn), "left_semi")


def differences(spark, sealed: str, present: str) -> DataFrame:
    """part, node (the key) and status of every key whose rows differ between two seals, from the roots down."""
    bad = _unlike(spark.read.parquet(f"{sealed}/root"), spark.read.parquet(f"{present}/root"))
    for n in reversed(range(LEVELS)):
        some = bad.select("part", "node").limit(NAMED + 1).collect()
        few = bad.select("part", "node")
        bad = spark.createDataFrame(some, few.schema) if len(some) <= NAMED else cut(few, "unlike")
        old, new = (_children(spark.read.parquet(f"{p}/level={n}"), bad, some if len(some) <= NAMED else None) for p in (sealed, present))
        bad = _unlike(old, new)
    return bad
