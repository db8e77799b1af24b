"""A store of vectors by content, append-only: what has been computed is never computed again, and every append is chained to the last.

A part is a folder of Parquet files with the content hash and the vector of texts that no part before it has. A commit is a row that
names the stream and batch that the part came from, the digest of the part's files and the chain value: a digest over the commit and
the chain value before. A part counts only once its commit is there, so a batch that broke off leaves nothing behind, and a
batch that comes again (after a restart) finds its commit and adds nothing. One writer at a time; any number of readers.

Reading and appending follow the chain. `load` also digests the files of every part again and refuses a store that does not match;
`verified` says how far a store can be trusted, so that the parts up to there can be taken over into a new store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMIT = "part long, stream string, batch long, rows long, digest string, before string, chain string"
#: The chain value before the first commit.
GENESIS = "0" * 64


class Refused(ValueError):
    """The store is not what its commits say."""


@dataclass(frozen=True)
class Store:
    folder: str
    vector: str  # DDL type of a vector

    @property
    def schema(self) -> str:
        return f"content_hash string, vector {self.vector}"


def content_hash(text: Column) -> Column:
    """The name of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _chained(before: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, F.col("part").cast("string"), "stream", F.col("batch").cast("string"), F.col("rows").cast("string"), "digest"), 256)


def commits(spark: SparkSession, store: Store) -> DataFrame:
    """A row for each batch that was ever appended."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{store.folder}/commits")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COMMIT)


def _digest(spark: SparkSession, store: Store, part: int) -> DataFrame:
    """One row with the digest of a part's files: their names and the digests of what they hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{store.folder}/parts/part={part}")
    name = F.substring_index("path", "/", -1)
    return files.select(F.concat(name, F.lit(":"), F.sha2("content", 256)).alias("file")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("file")), "\n"), 256).alias("digest"))


def verified(spark: SparkSession, store: Store, deep: bool = True) -> DataFrame:
    """part, rows, sound for each commit in order: the chain holds up to there and, if deep, so do the files of all parts up to there."""
    order = Window.orderBy("part")  # a row for each batch
    rows = commits(spark, store).withColumn("nth", F.row_number().over(order) - 1)
    before = F.coalesce(F.lag("chain").over(order), F.lit(GENESIS))
    rows = rows.withColumn("holds", (F.col("part") == F.col("nth")) & (F.col("before") == before) & (F.col("chain") == _chained(F.col("before"))))
    if deep:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        try:
            found = files.load(f"{store.folder}/parts")
            file = F.concat(F.substring_index("path", "/", -1), F.lit(":"), F.sha2("content", 256))
            found = found.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), file.alias("file")).groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("file")), "\n"), 256).alias("found"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = spark.createDataFrame([], "part long, found string")
        rows = rows.join(found, "part", "left").withColumn("holds", F.col("holds") & F.coalesce(F.col("found") == F.col("digest"), F.lit(False)))
    return rows.select("part", "rows", F.min("holds").over(order).alias("sound"))


def load(spark: SparkSession, store: Store, deep: bool = True) -> DataFrame:
    """content_hash and vector of all parts; a store that does not verify is refused."""
    state = verified(spark, store, deep).agg(F.count("*").alias("n"), F.min(F.when(~F.col("sound"), F.col("part"))).alias("bad")).first()
    if state.bad is not None:
        raise Refused(f"part {state.bad} of {store.folder} is not what was committed")
    if not state.n:
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).parquet(*[f"{store.folder}/parts/part={k}" for k in range(state.n)])


def append(store: Store, stream: str, texts: DataFrame, batch: int, encode: Callable[[DataFrame], DataFrame]) -> bool:
    """Add the vectors of texts (text) that the store lacks; False if the batch is there already.

    encode: content_hash, text to content_hash, vector. It sees each new text once.
    """
    spark = texts.sparkSession
    done = commits(spark, store)
    known = load(spark, store, deep=False).select("content_hash")
    if not done.filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
        return False
    last = done.agg(F.max(F.struct("part", "chain")).alias("c"), F.count("*").alias("n")).first()
    part, before = last.n, last.c.chain if last.n else GENESIS
    named = texts.select(content_hash(F.col("text")).alias("content_hash"), F.coalesce("text", F.lit("")).alias("text"))
    fresh = named.groupBy("content_hash").agg(F.first("text").alias("text")).join(known, "content_hash", "left_anti")  # copies meet before they move
    path = f"{store.folder}/parts/part={part}"
    encode(fresh).select("content_hash", F.col("vector").cast(store.vector).alias("vector")).write.mode("overwrite").parquet(path)  # what a broken attempt left goes
    row = spark.createDataFrame([(part, stream, batch, spark.read.schema(store.schema).parquet(path).count(), _digest(spark, store, part).first().digest, before)], COMMIT.rpartition(",")[0])
    row.withColumn("chain", _chained(F.col("before"))).coalesce(1).write.mode("overwrite").json(f"{store.folder}/commits/{part:012d}")
    return True


def sink(store: Store, stream: str, encode: Callable[[DataFrame], DataFrame]):
    """For foreachBatch of a stream of texts (text)."""
    return lambda rows, batch: append(store, stream, rows, batch, encode) and None
