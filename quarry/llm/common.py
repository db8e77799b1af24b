"""What the operators of this folder share: table readers, column names, ASCII rules; written tables come from quarry.scratch."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import cut, fresh_path, scoped, spend  # noqa: F401

#: ASCII white space, as every contract of this folder has it.
SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch: texts make rows large, and a batch is held several times over on its way to Python and back.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it, and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(col):
    """A-Z to a-z and nothing else; plain lower() where the value is ASCII throughout, which is much cheaper."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores at its end as it takes to differ from every column of df, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def tasks_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))
