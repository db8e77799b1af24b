"""Retrieval text formats: qrels of four fields, runs of six, with arity checked; JSON lines with sorted keys; CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(line: Column, n: int) -> Column:
    parts = F.split(F.btrim(line), "[ \\t]+")
    return F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields: "), line)).cast("array<string>"))


def parse_run(lines: DataFrame) -> DataFrame:
    """query, id, rank, score, tag from lines (value); an odd line is an error."""
    f = lines.filter(F.btrim("value") != "").select(_fields(F.col("value"), 6).alias("f"))
    return f.select(F.col("f")[0].alias("query"), F.col("f")[2].alias("id"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    f = lines.filter(F.btrim("value") != "").select(_fields(F.col("value"), 4).alias("f"))
    return f.select(F.col("f")[0].alias("query"), F.col("f")[2].alias("id"), F.col("f")[3].cast("int").alias("gain"))


def read_run(spark, path: str) -> DataFrame:
    return parse_run(spark.read.text(path))


def read_qrels(spark, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


def format_run(ranked: DataFrame, tag: str) -> DataFrame:
    """Lines of a run, with 1 / rank as the score."""
    score = F.format_string("%.9f", 1.0 / F.col("rank"))
    return ranked.select(F.concat_ws(" ", F.col("query").cast("string"), F.lit("Q0"), F.col("id").cast("string"), F.col("rank").cast("string"), score, F.lit(tag)).alias("value"))


def write_run(ranked: DataFrame, path: str, tag: str) -> None:
    format_run(ranked, tag).write.mode("errorifexists").text(path)


def canonical_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, keys in alphabetical order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    canonical_json(rows).write.mode("errorifexists").text(path)


def read_json_lines(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def only_new(rows: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose content hash is not known yet: what an append-only index has to embed."""
    return rows.join(known.select(key), key, "left_anti")
