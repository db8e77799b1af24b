"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a place where a chunk may start (a word start, or any character start where no
word starts nearby) becomes a cut if its hash is the least within `radius` bytes on either side. Whether a place is a cut
depends on the bytes around it and on nothing else, so an insertion moves no cut but those beside it, and two copies of a
passage are cut alike wherever they stand. Chunks are deduplicated by digest: the document with the smallest id keeps a
chunk, and a run of adjacent chunks that others also have counts once it is `min_bytes` long. Digests move, texts do not,
until the spans to drop are known.

Counting digests is partially aggregated and the join that brings the verdict back has no raw aggregate above it that needs a
digest's rows together, so a passage that a third of the documents share does not gather in one task. Texts are cut once to count
digests and once to join the verdict: writing all chunks down would take as much room as the texts.

Defined cases: null and empty texts have no chunks; a very long text is cut in windows, with the same cuts as in one piece; repeats
within one document are left alone; rows that share a doc_id count as one document when it is settled who keeps a chunk, but each
text has spans of its own, and repeated rows have them once; a row with a null doc_id takes no part; of equal documents the one
with the smallest id keeps all; a document all of whose text is a copy ends up empty; an empty table gives an empty result; other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, free_names, own_columns, spend, table
from quarry.llm.shingles import mix, powers_of

RADIUS, MIN_BYTES, WINDOW = 16, 128, 16
PAD, STEP, LONG = 48, 1 << 20, 1 << 16


def _gear() -> np.ndarray:
    """256 random words by splitmix64 from a fixed start."""
    x = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 257, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()
FREE = np.uint32(0xFFFFFFFF)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[byte] at each byte, over the last WINDOW bytes, by doubling."""
    h, step = GEAR[data], 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], for every i at which the window fits."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def cut_places(data: np.ndarray, radius: int, step: int = STEP) -> np.ndarray:
    """Cuts in texts that stand PAD zero bytes apart in data, ascending. A cut depends on radius + WINDOW bytes around it, so data may be read in windows."""
    if len(data) <= 2 * step:
        return _cut_places(data, radius)
    margin, found = radius + WINDOW + 1, []
    for at in range(0, len(data), step):
        low = max(0, at - margin)
        here = _cut_places(data[low : at + step + margin], radius) + low
        found.append(here[(here >= at) & (here < at + step)])
    return np.concatenate(found)


def _cut_places(data: np.ndarray, radius: int) -> np.ndarray:
    h = gear_hashes(data)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.zeros(len(data), bool)
    starts[1:] = space[:-1] & ~space[1:]
    score = np.empty_like(h)
    # the hash of the bytes before a place decides over it
    score[0], score[1:] = FREE, h[:-1] >> np.uint32(1)
    score[~starts] |= np.uint32(0x80000000)
    score[(data == 0) | ((data & 0xC0) == 0x80)] = FREE
    before = window_min(score[:-1], radius)
    after = window_min(score[1:], radius)
    at = np.arange(radius, len(data) - radius)
    mid = score[at]
    return at[(mid != FREE) & (mid < before[at - radius]) & (mid <= after[at])]


def digests(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit digest of data[a[i] : b[i]] for each i; a and b ascend. Sums of one polynomial serve all chunks of a window; a long chunk is hashed alone.

    One digest decides nothing: only runs of MIN_BYTES count, which are several chunks.
    """
    import xxhash

    out = np.empty(len(a), np.uint64)
    short = np.flatnonzero(b - a <= LONG)
    at = 0
    while at < len(short):
        first = a[short[at]]
        stop = max(at + 1, int(np.searchsorted(b[short], first + STEP, "right")))
        own = short[at:stop]
        part = data[first : b[own[-1]]]
        up, down = powers_of(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        begin, end = a[own] - first, b[own] - first
        out[own] = mix((sums[end] - sums[begin]) * down[begin] ^ mix((end - begin).astype(np.uint64)))
        at = stop
    for i in np.flatnonzero(b - a > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[a[i] : b[i]].tobytes())
    return out


def _chunks(radius: int, limit: int = 4 << 20):
    def block(ids, versions, texts):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + PAD) - sizes
        whole = bytearray(int(begins[-1] + sizes[-1] + PAD))
        for b, t in zip(begins.tolist(), texts, strict=True):
            whole[b : b + len(t)] = t
        data = np.frombuffer(whole, np.uint8)
        cuts = cut_places(data, radius)
        edges = np.unique(np.concatenate([cuts, begins, begins + sizes]))
        doc = np.searchsorted(begins, edges, "right") - 1
        real = np.flatnonzero(doc[:-1] == doc[1:])
        a, b, doc = edges[real], edges[real + 1], doc[real]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array(np.array(versions, np.int64)[doc]), pa.array((a - begins[doc]).astype(np.int32)), pa.array((b - begins[doc]).astype(np.int32)), pa.array(digests(data, a, b).view(np.int64))], names=["doc_id", "version", "start", "stop", "digest"])

    def run(batches):
        for batch in batches:
            ids, versions, texts, held = [], [], [], 0
            for doc, text, version in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").replace("\0", " ").encode() if doc.is_valid else b""
                if not data:
                    continue
                ids.append(doc.as_py())
                versions.append(version.as_py())
                texts.append(data)
                held += len(data)
                if held > limit:
                    yield block(ids, versions, texts)
                    ids, versions, texts, held = [], [], [], 0
            if ids:
                yield block(ids, versions, texts)

    return run


def chunks(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, version (xxhash64 of the text), start, stop (bytes of the UTF-8 text) and digest of every chunk."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    return rows.mapInArrow(_chunks(radius), "doc_id long, version long, start int, stop int, digest long")


def repeated_spans(docs: DataFrame, radius: int = RADIUS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, start, stop, keeper and kept of every span that other documents also have.

    A span is a run of adjacent chunks that are each found in two documents or more, min_bytes long together; it is reported in
    parts of one keeper kind: kept is true where this document is the first to have the chunks. keeper: the smallest id that has
    the first of the chunks. Of rows that share a doc_id but not their text, each text has its spans.
    """
    return text_spans(docs, radius, min_bytes).drop("version")


def text_spans(docs: DataFrame, radius: int = RADIUS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """repeated_spans with version, the xxhash64 of the text that the offsets are of; rows with equal doc_id and text have their spans once."""
    shared = chunks(docs, radius).groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper < last").select("digest", "keeper")
    shared = cut(shared, "shared-chunks")
    hits = chunks(docs, radius).join(shared, "digest").select("doc_id", "version", "start", "stop", "keeper")
    order = Window.partitionBy("doc_id", "version").orderBy("start", "stop")
    first = F.col("keeper") == F.col("doc_id")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce((reach < F.col("start")).cast("int"), F.lit(1))
    turn = F.when((gap == 1) | F.coalesce(F.lag(first).over(order) != first, F.lit(True)), 1).otherwise(0)
    marked = hits.withColumn("gap", gap).withColumn("turn", turn).withColumn("run", F.sum("gap").over(order)).withColumn("part", F.sum("turn").over(order))
    parts = marked.groupBy("doc_id", "version", "run", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("keeper", "start").alias("keeper"))
    whole = Window.partitionBy("doc_id", "version", "run")
    spans = (
        parts.withColumn("whole", F.max("stop").over(whole) - F.min("start").over(whole))
        .filter(F.col("whole") >= min_bytes)
        .select("doc_id", "version", "start", "stop", "keeper", (F.col("keeper") == F.col("doc_id")).alias("kept"))
    )
    spans = cut(spans, "repeat-spans")
    spend(shared)
    return spans


def drop_repeats(docs: DataFrame, radius: int = RADIUS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs whose text has lost the spans that a document with a smaller id keeps. Texts are shuffled once, to meet their spans."""
    spans = text_spans(docs, radius, min_bytes)
    doc, version, gone = free_names(docs, "__doc", "__version", "__gone")
    lost = spans.filter("not kept").groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(gone))
    joined = docs.join(lost, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(version)), "left")
    data = F.encode("text", "UTF-8")
    begin = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("kept"))
    folded = F.aggregate(gone, begin, lambda s, x: F.struct(x.stop.alias("at"), F.concat(s.kept, F.substring(data, s.at + 1, F.greatest(x.start - s.at, F.lit(0)))).alias("kept")), lambda s: F.concat(s.kept, F.substring(data, s.at + 1, F.octet_length("text"))))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.decode(folded, "UTF-8"))
    return joined.withColumn("text", text).select(*own_columns(docs))


def op7_substring_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))
