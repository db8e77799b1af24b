"""A context under one budget, folded in the order of the hits: hits, then their notes, then parents in the place of their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the fold takes, in this order of fields. stage: 1 hit, 2 note, 3 parent; place: the hit's place; units: what the text is made of.
EVENT = "struct<stage:int,place:int,id:string,units:array<int>,size:bigint,barred:boolean>"
_KEPT = "array<struct<id:string,units:array<int>,size:bigint>>"
_LEFT = "array<struct<id:string,reason:string>>"


def zipped(hits: DataFrame, request: list[str], scope: str, depth: str) -> DataFrame:
    """hits with place: the first of every scope, then the second of those that have one, and so on."""
    from pyspark.sql import Window

    return hits.withColumn("place", F.row_number().over(Window.partitionBy(*request).orderBy(depth, scope)))


def _total(records: Column) -> Column:
    return F.aggregate(records, F.lit(0).cast("long"), lambda n, r: n + r["size"])


def _step(budget: int):
    def step(acc: Column, e: Column) -> Column:
        kept, left = acc["kept"], acc["left"]
        record = F.array(F.struct(e["id"].alias("id"), e["units"].alias("units"), e["size"].alias("size")))
        inside = lambda r: (F.size(r["units"]) > 0) & (F.size(F.array_except(r["units"], e["units"])) == 0)
        outside = lambda r: ~inside(r)
        parent = e["stage"] == 3
        # a parent all of whose units are there, and any text that is there, change nothing
        there = F.when(parent, F.size(F.array_except(e["units"], F.flatten(F.transform(kept, lambda r: r["units"])))) == 0).otherwise(F.exists(kept, lambda r: r["id"] == e["id"]))
        rest = F.when(parent, F.filter(kept, outside)).otherwise(kept)
        reason = F.when(e["barred"], "quarantine").when(_total(rest) + e["size"] > budget, "budget")
        at = F.array_position(F.transform(kept, inside), F.lit(True)).cast("int")  # the parent stands where the first of its children stood
        swapped = F.concat(F.slice(kept, F.lit(1), F.greatest(at - 1, F.lit(0))), record, F.filter(F.slice(kept, F.greatest(at, F.lit(1)), F.size(kept)), outside))
        taken = F.when(parent & (at > 0), swapped).otherwise(F.concat(kept, record))
        changed = F.struct(F.when(reason.isNull(), taken).otherwise(kept).alias("kept"), F.when(reason.isNull(), left).otherwise(F.concat(left, F.array(F.struct(e["id"].alias("id"), reason.alias("reason"))))).alias("left"))
        return F.when(there, acc).otherwise(changed)

    return step


def fold(events: DataFrame, request: list[str], budget: int) -> DataFrame:
    """request, kept (id, units, size in order), left (id, reason) and used, from events (request and the fields of EVENT).

    A hit or a note is added if it is not there, not barred and fits into what is left of the budget; one that does not fit is skipped
    and the next is tried. A parent takes the place of all records whose units it has, if the budget then holds. Every refusal is
    listed with its reason, as often as it happens. The events of a request are its hits, their notes and one parent for each hit, so a request of k
    hits folds a few k of them, whatever the corpus; requests are independent of each other.
    """
    ordered = F.array_sort(F.collect_list(F.struct("stage", "place", "id", F.coalesce("units", F.array().cast("array<int>")).alias("units"), F.col("size").cast("long").alias("size"), F.coalesce("barred", F.lit(False)).alias("barred")).cast(EVENT)))
    start = F.struct(F.array().cast(_KEPT).alias("kept"), F.array().cast(_LEFT).alias("left"))
    done = events.groupBy(*request).agg(ordered.alias("events")).select(*request, F.aggregate("events", start, _step(budget)).alias("c"))
    return done.select(*request, "c.kept", "c.left", _total(F.col("c.kept")).alias("used"))
