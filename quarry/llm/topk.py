"""Exact top-k inner products over norm-sorted vectors.

Vectors are rounded to integers and dealt out by descending length. All are rotated by the right singular vectors of the whole
table (from its d x d Gram matrix, summed over all rows), so that the first coordinates hold most of a product. A block of
vectors is skipped for a query when |q| times the block's largest length cannot reach the query's k-th best; otherwise the
product of the leading coordinates plus the Cauchy-Schwarz bound of the rest prunes candidates, and the survivors' integer
products are computed exactly. Thresholds start from the block of the longest vectors.

Queries are taken in chunks of bounded size against all rows in blocks; a task holds one block and one chunk, computes its
starting thresholds from the longest vectors, and reads on without work once a block's length bound fails for every query, as all
later ones are shorter. Rotated sums are floating point and only prune, with a margin for rounding. Scores come from integer
products: in doubles where no product can pass 2**53, in 64-bit integers where none can pass 2**63, else in integers of any size.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a shorter vector ends in
zeros; rows with the query's own vec_id are not its candidates; rows that repeat a vec_id are candidates each for itself, and as
query one of them is asked, the one whose vector sorts first; ties go to the smaller vec_id; with fewer candidates than k, all are returned; a score beyond 64 bits
raises an error, as its column cannot hold it; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, spend, table, tasks_for
from quarry.llm.vectors import best_per_query, by_chunks, matrix, usable

SCALE, TOP, QUERY_CHUNK, BLOCK, PART_ROWS = 64, 20, 8192, 2048, 8192
NONE, NONE_BIG = -(1 << 62), -(1 << 1000)  # below every score, in 64 bits and beyond
FOUND = "query_id long, vec_id long, score long"


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products over all rows."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v"), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "x"])

    sums = vectors.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # width squared rows
    out = np.zeros((width, width))
    for r in sums:
        out[r.i, r.j] = r.x
    return out


class Tops:
    """The best k of each query so far. thr: scores below it cannot be among the final k."""

    def __init__(self, n: int, k: int, kind=np.int64):
        self.none = NONE_BIG if kind is object else NONE
        self.k, self.thr = k, np.full(n, self.none, kind)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.scores = np.full((n, k), self.none, kind)

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in candidates, one per entry, for the queries in rows."""
        which, back = np.unique(rows, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(which)), self.k), back])
        i = np.concatenate([self.ids[which].ravel(), ids])
        s = np.concatenate([self.scores[which].ravel(), scores])
        order = best_first(q, i, s)
        q, i, s = q[order], i[order], s[order]
        begin = np.searchsorted(q, np.arange(len(which)))
        take = begin[:, None] + np.arange(self.k)
        self.ids[which], self.scores[which] = i[take], s[take]
        self.thr[which] = np.maximum(self.thr[which], self.scores[which][:, -1])


def best_first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by query, descending score and id."""
    if scores.dtype == object:  # by rank, as integers of any size are no sort key
        _, scores = np.unique(scores, return_inverse=True)
    return np.lexsort((ids, -scores, q))


class Products:
    """Exact inner products of integer vectors that are held as doubles. most: no product is larger."""

    def __init__(self, most: float):
        self.kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row."""
        if self.kind is np.float64:
            return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
        if self.kind is np.int64:
            return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
        return np.array([sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)], object)

    def tops(self, n: int, k: int) -> Tops:
        return Tops(n, k, object if self.kind is object else np.int64)


def search_block(tops: Tops, products: Products, queries, cid, c, rotation, lead: int) -> bool:
    """One block of candidates for every query that it can still matter to; whether there is any such query.

    queries: ids, vectors, rotated vectors, lengths, lengths of what lies beyond the leading coordinates.
    """
    qid, q, q_rot, q_len, q_rest = queries
    longest = np.linalg.norm(c, axis=1).max(initial=0.0)
    slack = 1e-6 * (1 + q_len * longest)
    thr = tops.thr.astype(np.float64)
    rows = np.flatnonzero(q_len * longest + slack >= thr)
    if not len(rows):
        return False
    c_rot = c @ rotation
    bound = q_rot[rows, :lead] @ c_rot[:, :lead].T
    bound += np.outer(q_rest[rows], np.linalg.norm(c_rot[:, lead:], axis=1))
    may = bound + slack[rows, None] >= thr[rows, None]
    may &= qid[rows, None] != cid
    r, j = np.nonzero(may)
    if products.kind is np.float64 and len(r) > may.size // 16:
        full = q[rows] @ c.T
        score = np.rint(full[r, j]).astype(np.int64)
    else:
        step = max(1, (1 << 22) // max(1, c.shape[1]))  # rows gathered at once
        parts = [products.of(q[rows[r[k : k + step]]], c[j[k : k + step]]) for k in range(0, len(r), step)]
        score = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    good = score >= tops.thr[rows[r]]
    r, j, score = rows[r[good]], cid[j[good]], score[good]
    if len(r) > 4 * tops.k * len(rows):
        # first the best of each query within the block: fewer to merge
        order = best_first(r, j, score)
        r, j, score = r[order], j[order], score[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, j, score = r[place < tops.k], j[place < tops.k], score[place < tops.k]
    if len(r):
        tops.merge(r, j, score)
    return True


def _search(chunk, shared, top: int, width: int, lead: int, most: float):
    def run(batches):
        (qid, q), (rotation, head_ids, head) = chunk.value, shared.value
        q_rot = q @ rotation
        queries = qid, q, q_rot, np.linalg.norm(q, axis=1), np.linalg.norm(q_rot[:, lead:], axis=1)
        products = Products(most)
        # thresholds from the longest vectors; their ids come again in the task that has them
        seed = products.tops(len(qid), top)
        for at in range(0, len(head_ids), BLOCK):
            search_block(seed, products, queries, head_ids[at : at + BLOCK], head[at : at + BLOCK], rotation, lead)
        tops = products.tops(len(qid), top)
        tops.thr = seed.thr
        more = True
        for batch in batches:
            if not more:
                continue
            ids, rows = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width)
            for at in range(0, len(ids), BLOCK):
                more = more and search_block(tops, products, queries, ids[at : at + BLOCK], rows[at : at + BLOCK], rotation, lead)
        r, k = np.nonzero(tops.scores > tops.none)
        for at in range(0, len(r), 100_000):
            a, b = r[at : at + 100_000], k[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(tops.ids[a, b]), pa.array(tops.scores[a, b].tolist(), pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, queries: DataFrame, top: int = TOP, lead_share: float = 0.9) -> DataFrame:
    """query_id, rank, vec_id, score of the largest inner products. vectors and queries: vec_id and v of integers as doubles."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    asked, longest_query = queries.agg(F.max(F.size("v")), F.max(length)).first()
    if not n or asked is None:
        return nothing
    width, most = max(width, asked), (longest * longest_query) ** 0.5
    if not np.isfinite(longest * longest_query):
        raise OverflowError("inner products pass the range of doubles")
    values, rotation = np.linalg.eigh(gram(vectors, width))
    values, rotation = values[::-1].clip(min=0), rotation[:, ::-1]
    lead = min(width, 1 + int(np.searchsorted(np.cumsum(values), lead_share * values.sum())))
    # by descending length: a task gets a range of lengths and reads it in order
    dealt = vectors.withColumn("norm2", length).repartitionByRange(tasks_for(n, PART_ROWS), F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    dealt = cut(dealt, "norm-sorted")
    head = dealt.orderBy(F.desc("norm2"), "vec_id").limit(BLOCK).toArrow()  # a block
    shared = spark.sparkContext.broadcast((rotation, head.column("vec_id").to_numpy(), matrix(head.column("v"), width)))

    def search(qid, q):
        chunk = spark.sparkContext.broadcast((qid, q))
        found = cut(best_per_query(dealt.select("vec_id", "v").mapInArrow(_search(chunk, shared, top, width, lead, most), FOUND), top), "top-found")
        chunk.destroy()
        return found

    found = by_chunks(queries, QUERY_CHUNK, width, search)
    spend(dealt)
    shared.destroy()
    return nothing if found is None else found


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors with floor(scale * x) of each component x, as doubles; from 2**53 on a double is whole."""
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return usable(vectors).withColumn("v", F.transform("v", whole))


def op10_exact_topk(spark, sf_dir):
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_products(rows, rows.filter(F.col("vec_id") % 20 == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
