"""Tables between steps: written to the folder that driver and executors share, and deleted when spent."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Where the tables written by cut lie, while their DataFrames live.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none on a local master (tests) a folder of our own takes its place; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scoped(spark: SparkSession, settings: dict):
    """Session settings that hold for a block and are put back after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The shuffle files of the write go as soon as it is done. The table stays until spend() takes it. by: an integer column by whose
    values the table is laid out, so that a filter on it reads the rows it wants and no others.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with scoped(spark, {_CLEANUP: "true"}):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def spend(*tables: DataFrame | None) -> None:
    """Delete tables that cut wrote and that nothing will read again: whatever was made from them is written itself.

    Other DataFrames are left alone.
    """
    for df in tables:
        path = _written.pop(df, None) if df is not None else None
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def in_blocks(rows: DataFrame, key: str, per_block: int, use) -> DataFrame:
    """The union of use(block) over blocks of about per_block rows each, so that whatever use broadcasts is bounded."""
    blocks = max(1, -(-rows.count() // per_block))
    if blocks == 1:
        return use(rows)
    nth = F.pmod(F.xxhash64(key), F.lit(blocks))
    out = use(rows.filter(nth == 0))
    for k in range(1, blocks):
        out = out.unionByName(use(rows.filter(nth == k)))
    return out
