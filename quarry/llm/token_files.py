"""Token ids as flat files of unsigned integers with 64-bit document offsets, to be mapped into memory.

A folder holds, for each block of documents, a file of ids (16 bits each where the vocabulary has at most 65,536 ids, else 32,
little-endian, one document after the other) and a file of offsets (64 bits: where each document of the block starts among the
ids of all blocks, and where the last one ends), and a manifest, a Parquet table with base (the ids before the block) and the
block's doc_ids. Blocks hold documents in ascending order of doc_id and follow each other in that order.

Texts are dealt to ranges of doc_id and sorted within them; a task encodes its range and packs it into blocks of FILE_BYTES,
which bound its memory (a document longer than that is a block of its own). Bases are prefix sums: over the ranges, then over
the blocks of a range. Files are written by Spark's text writer, one row for each, so that commits, retries and stores other than
a local disk are Spark's: the end mark of the last document, or the highest octet of the last offset, is the line separator that
the writer puts behind a row. Files are read where they lie: mapped into memory on a file system that all executors see, else as
Spark's binary files.

Ids are those of the tokenizer's JSON file, without special tokens of its own; they come from the rank file of the same
vocabulary, which is several times as fast (tests hold the two against each other). Added tokens inside a text are one id each.

Defined cases: null or empty text is the end mark alone; a text of any length is encoded as a whole; rows that share a doc_id
follow each other, ordered by a hash of their texts; a null doc_id comes before all others and is carried along; extra columns
are ignored; an empty table gives a folder of no blocks and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, fresh_path, prepare, spend, table
from quarry.llm.pack import END, RANKS, VOCABULARY, encoding
from quarry.llm.shingles import slices

FILE_BYTES, TEXT_BYTES = 16 << 20, 4 << 20
BLOCKS = "range int, nth int, doc_ids array<long>, sizes array<long>, n long, ids binary"


def id_type(largest: int) -> np.dtype:
    """The narrowest of the two kinds of ids that holds the largest one."""
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def separator(end: int, kind: np.dtype) -> str:
    """The end mark's octets as a line separator."""
    octets = np.array([end], kind).tobytes()
    if max(octets) > 127:
        raise ValueError(f"the end mark {end} cannot stand at the end of a file: its octets must be below 128")
    return octets.decode("ascii")


def _blocks(ranks: str, vocabulary: str, end: int, file_bytes: int, kind: str):
    """A range's documents, in order, as blocks; ids without the last document's end mark."""

    def run(batches):
        from pyspark import TaskContext

        coder, part, nth = encoding(ranks, vocabulary), TaskContext.get().partitionId(), 0
        names = coder.special_tokens_set
        docs, sizes, held, octets = [], [], [], 0

        def block():
            ids = b"".join(held)
            cols = ([part], [nth], [docs], [sizes], [sum(sizes)], [ids[: -np.dtype(kind).itemsize]])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["range", "nth", "doc_ids", "sizes", "n", "ids"])

        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                for doc, cell in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    text = cell or ""
                    found = coder.encode(text, allowed_special="all") if any(x in text for x in names) else coder.encode_ordinary(text)
                    found.append(end)
                    docs.append(doc)
                    sizes.append(len(found))
                    held.append(np.array(found, kind).tobytes())
                    octets += len(held[-1])
                    if octets >= file_bytes:
                        yield block()
                        docs, sizes, held, octets, nth = [], [], [], 0, nth + 1
        if docs:
            yield block()

    return run


def _offsets(batches):
    """Starts of a block's documents and the end of the last; without the highest octet, which is zero below 2**56."""
    for batch in batches:
        out = []
        for base, sizes in zip(batch.column("base").to_pylist(), batch.column("sizes"), strict=True):
            ends = np.cumsum(sizes.values.to_numpy(), dtype=np.uint64) + np.uint64(base)
            out.append(np.concatenate([np.array([base], "<u8"), ends.astype("<u8")]).tobytes()[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "octets"])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, ranks: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Encode docs (doc_id, text) and write ids, offsets and manifest to folder. ranks: the rank file of the vocabulary's JSON file."""
    import public_tokenizers

    vocabulary, ranks = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    kind = id_type(max(encoding(ranks, vocabulary).max_token_value, end))
    mark = separator(end, kind)
    prepare(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("version", F.xxhash64("text")).repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version")
    made = cut(ordered.select("doc_id", "text").mapInArrow(_blocks(ranks, vocabulary, end, file_bytes, kind.str), BLOCKS), "token-blocks")
    totals = made.groupBy("range").agg(F.sum("n").alias("n"))
    bases = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))  # a row for each task of the job above
    inner = F.sum("n").over(Window.partitionBy("range").orderBy("nth")) - F.col("n")
    based = made.select("range", "nth", "n", "doc_ids", "sizes").withColumn("inner", inner).join(bases, "range")
    block = F.shiftleft(F.col("range").cast("long"), 24) + F.col("nth")
    manifest = cut(based.select(block.alias("block"), (F.col("base") + F.col("inner")).alias("base"), "n", "doc_ids", "sizes"), "token-manifest")
    put = lambda rows, name, sep: rows.write.partitionBy("block").option("lineSep", sep).option("compression", "none").text(f"{folder}/{name}")
    put(made.select(block.alias("block"), F.col("ids").cast("string").alias("value")), "ids", mark)
    put(manifest.select("block", "base", "sizes").mapInArrow(_offsets, "block long, octets binary").select("block", F.col("octets").cast("string").alias("value")), "offsets", "\0")
    manifest.select("block", "base", "n", "doc_ids", F.lit(kind.str).alias("kind")).write.parquet(f"{folder}/manifest")
    spend(made, manifest)


class Block:
    """A block's ids and offsets, mapped into memory or in buffers; block[i] are the ids of its i-th document."""

    def __init__(self, ids, offsets, kind: str):
        take = lambda x, t: np.memmap(x, t, "r") if isinstance(x, str) else np.frombuffer(x, t)
        self.ids, self.offsets = take(ids, kind), take(offsets, "<u8")
        if len(self.offsets) < 2 or int(self.offsets[-1] - self.offsets[0]) != len(self.ids):
            raise ValueError("ids and offsets of a block do not belong together")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = (self.offsets[i : i + 2] - self.offsets[0]).tolist()
        return self.ids[a:b]


def read_tokens(spark, folder: str, finish, columns: str, mapped: bool | None = None) -> DataFrame:
    """A row for each document of a folder: doc_id, start, n_tokens and what finish(ids) returns, a tuple with a value for each of columns (a DDL text).

    mapped: files are opened by path, which every executor must see; by default where the folder is of the file scheme.
    """
    if mapped is None:
        mapped = folder.startswith("file:")
    manifest = spark.read.schema("block long, base long, n long, doc_ids array<long>, kind string").parquet(f"{folder}/manifest")
    files = lambda name: spark.read.format("binaryFile").load(f"{folder}/{name}").select(F.col("block").cast("long").alias("block"), F.col("path" if mapped else "content").alias(name))
    if manifest.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {columns}")
    rows = manifest.join(files("ids"), "block").join(files("offsets"), "block").repartition("block")
    schema = spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {columns}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        local = lambda x: "/" + x.removeprefix("file:").lstrip("/") if mapped else x
        for batch in batches:
            for docs, kind, ids, offsets in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "kind", "ids", "offsets")), strict=True):
                block = Block(local(ids), local(offsets), kind)
                starts = block.offsets.tolist()
                made = [(d, a, b - a, *finish(block[i])) for i, (d, a, b) in enumerate(zip(docs, starts[:-1], starts[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)

    return rows.select("doc_ids", "kind", "ids", "offsets").mapInArrow(run, schema)


def digest(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op12_token_files(spark, sf_dir):
    prepare(spark)
    folder = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, digest, "ids_crc32 long")
