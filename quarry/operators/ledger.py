"""Evaluation by arms (corpus x method) in phases, with a ledger in which a phase can be scored once.

A phase's rows are written to a folder of their own; its commit is one file that is created only if it is not there, so of two runs at
once one counts and the other is refused, and a run that broke off left nothing that counts. The commit names the folder, the configuration
that the rows are of, and the arm chosen. A later phase is scored with the arm that an earlier one chose, under the same configuration.
The folder must be on a file system whose create is exclusive, as HDFS and local ones are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "corpus string, method string, query long, mrr double, hit double"


class Refused(ValueError):
    """The phase has been scored, or may not be scored yet."""


@dataclass(frozen=True)
class Ledger:
    folder: str
    configuration: str


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit_of(spark: SparkSession, ledger: Ledger, phase: str) -> dict | None:
    """What was committed for a phase; a commit that broke off in its only write is refused, as nothing tells whether its phase was seen."""
    path = f"{ledger.folder}/commits/{phase}.json"
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    text = "".join(r.value for r in spark.read.text(path).collect())  # one line
    if not text:
        raise Refused(f"the commit of {phase} is empty")
    return json.loads(text)


def score(spark: SparkSession, ledger: Ledger, phase: str, rows: Callable[[], DataFrame], simplest: list[tuple[str, str]]) -> dict:
    """Score a phase that has not been scored: rows() gives ROWS, and is not called where the phase is refused. Returns the commit.

    The arm with the largest mean mrr is chosen, then that with the larger mean hit, then the first of simplest.
    """
    if commit_of(spark, ledger, phase) is not None:
        raise Refused(f"{phase} has been scored; use a new ledger for changes")
    part = f"{phase}-{uuid.uuid4().hex}"
    rows().select(*[f.split()[0] for f in ROWS.split(", ")]).write.parquet(f"{ledger.folder}/parts/{part}")
    means = spark.read.schema(ROWS).parquet(f"{ledger.folder}/parts/{part}").groupBy("corpus", "method").agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("hit"))
    found = {(r.corpus, r.method): (r.mrr, r.hit) for r in means.collect()}  # a row for each arm
    if set(found) - set(simplest):
        raise ValueError(f"arms without a place in simplest: {sorted(set(found) - set(simplest))}")
    chosen = max(found, key=lambda arm: (*found[arm], -simplest.index(arm)), default=None)
    commit = {"phase": phase, "part": part, "configuration": ledger.configuration, "chosen": chosen}
    fs, where = _file(spark, f"{ledger.folder}/commits/{phase}.json")
    try:
        out = fs.create(where, False)
    except Exception as e:
        part_fs, lost = _file(spark, f"{ledger.folder}/parts/{part}")
        part_fs.delete(lost, True)
        if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
            raise Refused(f"{phase} was scored by another run meanwhile") from e
        raise
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    return commit


def chosen(spark: SparkSession, ledger: Ledger, phase: str) -> tuple[str, str]:
    """The arm that a phase chose, for the next one; refused where there is none or where the configuration has changed."""
    commit = commit_of(spark, ledger, phase)
    if commit is None or commit["chosen"] is None:
        raise Refused(f"choose an arm on {phase} first")
    if commit["configuration"] != ledger.configuration:
        raise Refused(f"the configuration has changed since {phase} was scored")
    return tuple(commit["chosen"])


def results(spark: SparkSession, ledger: Ledger, phases: list[str]) -> DataFrame:
    """phase, ROWS and chosen (the arm is the one that the phase chose) of committed phases; parts without a commit do not count."""
    out = None
    for phase in phases:
        commit = commit_of(spark, ledger, phase)
        if commit is None:
            continue
        corpus, method = commit["chosen"] or (None, None)
        rows = spark.read.schema(ROWS).parquet(f"{ledger.folder}/parts/{commit['part']}")
        rows = rows.select(F.lit(phase).alias("phase"), "*", F.coalesce((F.col("corpus") == F.lit(corpus)) & (F.col("method") == F.lit(method)), F.lit(False)).alias("chosen"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"phase string, {ROWS}, chosen boolean") if out is None else out
