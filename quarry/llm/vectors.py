"""Reading vector tables: usable rows as blocks of numpy arrays, and query sets in chunks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, spend, tasks_for


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the rows that have an id and only finite components."""
    v = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def matrix(column, width: int | None = None) -> np.ndarray:
    """A list column as rows of float64; a vector that is shorter than width (the longest, unless given) ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = width or int(sizes.max(initial=1))
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = col < width
    out[row[fits], col[fits]] = flat[fits]
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each is between a half and one: squares neither overflow nor vanish.

    Cosines stay as they are to the last bit wherever the plain squares can be had.
    """
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0))
    return np.ldexp(rows, -exponent[:, None])


def by_chunks(queries: DataFrame, per_chunk: int, width: int, search) -> DataFrame | None:
    """search(ids, vectors) for chunk after chunk of the queries, each of about per_chunk rows; the written results together, or None.

    One chunk at a time is on the driver and broadcast, whatever the number of queries. Queries are written once by chunk, so a chunk
    is read from its own files.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows that repeat an id one is asked
    n = queries.count()
    chunk = F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(tasks_for(n, per_chunk))).cast("int")
    dealt = cut(queries.select("vec_id", "v", chunk.alias("chunk")), "queries", by="chunk")
    out = None
    for k in range(tasks_for(n, per_chunk) if n else 0):
        got = dealt.filter(F.col("chunk") == k).select("vec_id", "v").toArrow()
        if got.num_rows:
            found = search(got.column("vec_id").to_numpy(), matrix(got.column("v"), width))
            out = found if out is None else out.unionByName(found)
    spend(dealt)
    return out


def best_per_query(found: DataFrame, top: int) -> DataFrame:
    """query_id, rank, vec_id, score: the top of each query, ties to the smaller vec_id. A task brings at most top rows of a query."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
