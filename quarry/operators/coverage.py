"""Coverage and budgets: interval unions, exact partitions, greedy packing, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_cover(spans: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """key, covered, complete: whether the union of [start, stop) spans covers [0, length). Touching spans join, gaps break."""
    before = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(before), F.lit(0))
    rows = spans.withColumn("reach", reach)
    add = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))
    per = rows.groupBy(key).agg(F.sum(add).alias("covered"), F.max((F.col("start") > F.col("reach")).cast("int")).alias("gap"), F.max("stop").alias("end"))
    joined = units.join(per, key, "left")
    complete = (F.coalesce("gap", F.lit(1)) == 0) & (F.coalesce("end", F.lit(0)) >= F.col("length"))
    return joined.select(key, F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), (complete | (F.col("length") == 0)).alias("complete"))


def greedy_keep(items: Column, budget: int, most: int | None = None) -> Column:
    """Ids kept when items (rank, size, id), in rank order, are taken while they fit, `most` at most; one that does not fit is skipped, not the end."""
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(s, x):
        fits = s.used + x["size"] <= budget
        if most is not None:
            fits = fits & (F.size(s.ids) < most)
        return F.struct(F.when(fits, s.used + x["size"]).otherwise(s.used).alias("used"), F.when(fits, F.concat(s.ids, F.array(x["id"].cast("long")))).otherwise(s.ids).alias("ids"))

    return F.aggregate(F.array_sort(items), begin, take, lambda s: s.ids)


def issue(rows: DataFrame, entity: str, check: str, bad: Column) -> DataFrame:
    """entity, check of the rows that break a constraint."""
    return rows.filter(bad).select(F.col(entity).cast("string").alias("entity"), F.lit(check).alias("check"))
