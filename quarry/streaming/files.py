"""Streams over Parquet tables that grow by files, run until nothing new is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream_of(spark: SparkSession, path: str, schema: str, files_at_once: int | None = None) -> DataFrame:
    """The table at path (a folder, or one file) as a stream; files_at_once: new files in a batch."""
    parent, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_at_once:
        source = source.option("maxFilesPerTrigger", files_at_once)
    # a stream reads folders: one file is read as its folder, filtered by name
    files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    is_file = bool(files) and files[0].path.rstrip("/").endswith("/" + name)
    return source.option("pathGlobFilter", name).parquet(parent) if is_file else source.parquet(path)


def drain(writer, checkpoint: str) -> None:
    """Take up the stream where its checkpoint stands and run it until all that is there is done."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
