"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form a group, groups are ordered by a 64-bit hash, and the smallest shard capacity for which a greedy pass needs
no more shards than asked is found by binary search. The driver never holds the groups: it searches over segments of the
hash order (at most `resolution` of them, each with its byte sum), which brackets the capacity between treating a segment as
one piece and treating it as a fluid; only the segments that a cut can fall into are then split further, round by round,
until both bounds meet. Sums come from partial aggregation, so a hot group costs nothing; places within a shard come from
counts of small salted cells, so no task holds a shard.

Defined cases: null text has no bytes and is a group of its own; equal rows each take a slot; with fewer groups than shards
some shards stay empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, table, tasks_for

BASE_BITS = 16


def greedy(segments, capacity: int, fluid: bool):
    """Ends of shards as indexes into segments (start, bits, sum, single) when each holds at most capacity; None if one segment alone is too large.

    fluid: a segment that is no single group may be cut anywhere. The end of a shard then is the segment in which it falls.
    """
    ends, held = [], 0
    for i, (_, _, size, single) in enumerate(segments):
        if fluid and not single:
            left = size
            while held + left > capacity:
                left -= capacity - held
                held = 0
                ends.append(i)
            held += left
            continue
        if size > capacity:
            return None
        if held + size > capacity:
            ends.append(i)
            held = 0
        held += size
    return ends


def smallest_capacity(segments, shards: int, fluid: bool) -> int:
    total = sum(s[2] for s in segments)
    lo, hi = max(1, -(-total // shards)), max(total, 1)
    while lo < hi:
        mid = (lo + hi) // 2
        ends = greedy(segments, mid, fluid)
        lo, hi = (lo, mid) if ends is not None and len(ends) < shards else (mid + 1, hi)
    return lo


def doubtful(segments, low: int, high: int, shards: int) -> set[int]:
    """Segments in which a cut can fall for some capacity from low to high: between the cut of a pessimist and that of an optimist."""
    late = greedy(segments, high, True)
    early, held = [], 0
    for i, (_, _, size, _) in enumerate(segments):
        if held and held + size > low:
            early.append(i)
            held = 0
        held += size
    early += [len(segments) - 1] * shards
    late += [len(segments) - 1] * shards
    return {i for a, b in zip(early[: shards - 1], late[: shards - 1], strict=True) for i in range(min(a, b) - 1, max(a, b) + 1) if 0 <= i < len(segments) and not segments[i][3]}


def segment_sums(keyed: DataFrame, bits: int, inside: DataFrame | None = None, parent_bits: int = 0) -> list:
    if inside is not None:
        keyed = keyed.join(F.broadcast(inside), F.shiftright("key", 64 - parent_bits) == F.col("parent")).drop("parent")
    rows = keyed.groupBy(F.shiftright("key", 64 - bits).alias("seg")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single")).collect()
    return [(r.seg, bits, r["size"], r.single or bits == 64) for r in rows]


def cut_keys(keyed: DataFrame, shards: int, resolution: int = 1 << BASE_BITS) -> list[int]:
    """First keys of the shards after the first, in order. keyed: key long, size long."""
    spark = keyed.sparkSession
    first = lambda s: s[0] << (64 - s[1])
    segments = sorted(segment_sums(keyed, BASE_BITS), key=first)
    while segments:
        high = smallest_capacity(segments, shards, False)
        low = smallest_capacity(segments, shards, True)
        split = doubtful(segments, low, high, shards) if low < high else set()
        if not split:
            return [first(segments[i]) for i in greedy(segments, high, False)]
        fresh = []
        for bits in sorted({segments[i][1] for i in split}):
            parents = [segments[i][0] for i in split if segments[i][1] == bits]
            more = max(1, min(64 - bits, (resolution // len(split)).bit_length() - 1))
            fresh += segment_sums(keyed, bits + more, spark.createDataFrame([(p,) for p in parents], "parent long"), bits)
        segments = sorted([s for i, s in enumerate(segments) if i not in split] + fresh, key=first)
    return []


def places(df: DataFrame, group: str, salt: Column, order: list, rows: int, per_cell: int = 50_000) -> DataFrame:
    """df with __place: gapless from 0 within group. Cells of a group are numbered apart and shifted by the counts before them."""
    n = tasks_for(rows, per_cell)
    df = df.withColumn("__cell", F.pmod(salt, F.lit(n)).cast("int"))
    counts = df.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(group).alias("__group"), F.col("__cell").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order)) - 1)
    joined = ranked.join(shifts, (F.col(group) == F.col("__group")) & (F.col("__cell") == F.col("__at")))
    return joined.withColumn("__place", (F.col("__shift") + F.col("__rank")).cast("long")).drop("__cell", "__group", "__at", "__shift", "__rank")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every document; equal texts share a shard, shard sizes have the least possible maximum."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long")
    key = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    keyed = cut(docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key")), "shard-keys")
    cuts = cut_keys(keyed.select("key", "size"), shards)
    shard = sum(((F.col("key") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = places(keyed.withColumn("shard", shard), "shard", F.xxhash64("doc_id", "text_crc32"), ["doc_id", "key", "size"], keyed.count())
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("__place").alias("slot"))


def op3_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
