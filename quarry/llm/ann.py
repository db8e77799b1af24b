"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard.

Rows are dealt to shards of bounded size by a hash of their id and vector. A shard's graph is built by inserting rows in growing batches:
greedy beam searches over the graph so far propose neighbours, relaxed distance pruning keeps a diverse set of edges (an edge
goes when a kept neighbour is closer to its end by the factor alpha), reverse edges are added and pruned alike. Queries are
answered by beam search in every shard, the whole beam rescored in double precision on the original vectors, and merged. Vectors of
one direction (equal unit vectors in single precision) in a shard are one node that lists its ids, so a vector that a third of the
rows share, in whatever lengths, is found with all of its ids.

Every row is indexed. Graphs are built once and written, a row for each shard; queries come in chunks of bounded size, and a
task holds one shard and one chunk. Searches of a batch walk in step, as matrix operations.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components take no part; a shorter vector ends
in zeros; components of any magnitude (rows are scaled by powers of two, which changes no cosine); rows with the query's own vec_id are not its candidates; rows that repeat a vec_id are candidates each for itself, and
as query one of them is asked, the one whose vector sorts first; ties go to the smaller vec_id; with fewer candidates than asked, all are returned; a row
without vec_id takes no part; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, scoped, spend, table, tasks_for
from quarry.llm.vectors import best_per_query, by_chunks, matrix, scaled, usable

TOP, SHARD_ROWS, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA, QUERY_CHUNK, STEP = 5, 4096, 32, 64, 128, 1.2, 8192, 512
FOUND = "query_id long, vec_id long, score double"


def beam_search(points, edges, entry: int, wanted, beam: int, wide: int = 4):
    """(ids, distances) of the `beam` nearest nodes met for each row of wanted, nearest first; -1 where there are fewer.

    Distance is 1 - cosine of unit vectors. Each round expands the `wide` nearest nodes not yet expanded.
    """
    n, rows = len(wanted), np.arange(len(wanted))
    seen = np.zeros((n, len(points)), bool)
    ids, far = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    ids[:, 0], far[:, 0] = entry, 1 - wanted @ points[entry]
    seen[:, entry] = True
    active = rows
    while len(active):
        open_far = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
        pick = np.argpartition(open_far, wide - 1, axis=1)[:, :wide] if beam > wide else np.tile(np.arange(beam), (len(active), 1))
        real = np.isfinite(np.take_along_axis(open_far, pick, 1))
        some = real.any(axis=1)
        active, pick, real = active[some], pick[some], real[some]
        if not len(active):
            break
        done[active[:, None], pick] |= real
        nodes = np.where(real, ids[active[:, None], pick], -1)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        r, k = np.nonzero(fresh)
        # of a node met twice in one round, the first stays
        code, first = np.unique(r * len(points) + near[r, k], return_index=True)
        r, to = r[first], code % len(points)
        seen[active[r], to] = True
        gap = 1 - np.einsum("ij,ij->i", wanted[active[r]], points[to])
        begin = np.searchsorted(r, np.arange(len(active) + 1))
        most = int(np.diff(begin).max(initial=0))
        if not most:
            continue
        new_ids, new_far = np.full((len(active), most), -1), np.full((len(active), most), np.inf, np.float32)
        place = np.arange(len(r)) - begin[r]
        new_ids[r, place], new_far[r, place] = to, gap
        all_ids, all_far = np.hstack([ids[active], new_ids]), np.hstack([far[active], new_far])
        all_done = np.hstack([done[active], np.zeros_like(new_ids, bool)])
        order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[active], far[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    order = np.argsort(far, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(points, nodes, pool, degree: int, alpha: float):
    """Up to `degree` edges for each node from its pool (ids, -1 where empty): nearest first, without those that a kept one covers."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    vectors = points[pool]
    gap = 1 - np.einsum("bd,bcd->bc", points[nodes], vectors)
    gap[pool < 0] = np.inf
    among = 1 - vectors @ vectors.transpose(0, 2, 1)
    out, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    alive = gap.copy()
    for k in range(degree):
        best = alive.argmin(axis=1)
        real = np.isfinite(alive[rows, best])
        if not real.any():
            break
        out[real, k] = pool[real, best[real]]
        # squared lengths of chords are twice these distances, so alpha enters squared
        alive[(alpha * alpha * among[rows, best] <= gap) & real[:, None]] = np.inf
        alive[rows, best] = np.inf
    return out


def build_graph(points, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
    """(edges, entry): a row of node ids for each node, -1 where empty, and the node at which searches enter."""
    n = len(points)
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    entry = int(order[np.argmax(points[order[: min(n, 1024)]] @ points.mean(axis=0))])
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(STEP, max(8, at))]
        ids, _ = beam_search(points, edges, entry, points[batch], beam)
        edges[batch] = robust_prune(points, batch, np.hstack([ids, edges[batch]]), degree, alpha)
        to, back = edges[batch].ravel(), np.repeat(batch, degree)
        to, back = to[to >= 0], back[to >= 0]
        sort = np.argsort(to, kind="stable")
        to, back = to[sort], back[sort]
        ends, begin, count = np.unique(to, return_index=True, return_counts=True)
        added = np.full((len(ends), int(count.max())), -1)
        added[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(begin, count)] = back
        have = (edges[ends] >= 0).sum(axis=1)
        light = have + count <= degree
        for e, h, c, new in zip(ends[light], have[light], count[light], added[light], strict=True):
            edges[e, h : h + c] = new[:c]
        heavy = np.flatnonzero(~light)
        for k in range(0, len(heavy), STEP):
            some = heavy[k : k + STEP]
            edges[ends[some]] = robust_prune(points, ends[some], np.hstack([edges[ends[some]], added[some]]), degree, alpha)
        at += len(batch)
    return edges, entry


#: A shard's graph: node vectors, edges and, by node, the rows that stand for it. A shard has shard_rows rows on average.
GRAPH = "shard long, entry int, nodes int, points binary, edges binary, begin binary, ids binary, rows binary"


def _build_shard(top: int, width: int, degree: int):
    def run(shard: pa.Table) -> pa.Table:
        ids, rows = shard.column("vec_id").to_numpy(), matrix(shard.column("v"), width)
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], scaled(rows[order])
        points, node = np.unique((rows / np.sqrt((rows * rows).sum(axis=1))[:, None]).astype(np.float32), axis=0, return_inverse=True)
        # of the ids of equal vectors, top + 1 are enough: one may be the query's own, and smaller ids win ties
        _, vector = np.unique(rows, axis=0, return_inverse=True)
        same = np.argsort(vector, kind="stable")
        place = np.arange(len(same)) - np.searchsorted(vector[same], vector[same])
        members = np.sort(same[place <= top])
        members = members[np.argsort(node[members], kind="stable")]
        begin = np.searchsorted(node[members], np.arange(len(points) + 1))
        edges, entry = build_graph(points, degree)
        cells = (points.astype("<f4"), edges.astype("<i4"), begin.astype("<i4"), ids[members].astype("<i8"), rows[members].astype("<f8"))
        name = shard.column("shard")[0].as_py()
        return pa.table([pa.array([name], pa.int64()), pa.array([entry], pa.int32()), pa.array([len(points)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=["shard", "entry", "nodes", "points", "edges", "begin", "ids", "rows"])

    return run


def _search_graphs(chunk, top: int, width: int, beam: int, degree: int):
    def run(batches):
        qid, q = chunk.value
        q = scaled(q)
        unit = (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32)
        for batch in batches:
            for g in batch.to_pylist():
                points = np.frombuffer(g["points"], "<f4").reshape(g["nodes"], width)
                edges = np.frombuffer(g["edges"], "<i4").reshape(g["nodes"], degree)
                begin, ids, rows = np.frombuffer(g["begin"], "<i4"), np.frombuffer(g["ids"], "<i8"), np.frombuffer(g["rows"], "<f8").reshape(-1, width)
                length = np.sqrt((rows * rows).sum(axis=1))
                out = ([], [], [])
                for at in range(0, len(qid), STEP):
                    near, _ = beam_search(points, edges, g["entry"], unit[at : at + STEP], beam)
                    for k, found in enumerate(near):
                        nodes = found[found >= 0]
                        cand = np.concatenate([np.arange(begin[v], begin[v + 1]) for v in nodes])
                        cand = cand[ids[cand] != qid[at + k]]
                        a = q[at + k]
                        cos = (rows[cand] * a).sum(axis=1) / (length[cand] * np.sqrt((a * a).sum()))  # row by row alike, so equal vectors tie
                        best = np.lexsort((ids[cand], -cos))[:top]
                        out[0].append(np.full(len(best), qid[at + k]))
                        out[1].append(ids[cand[best]])
                        out[2].append(cos[best])
                flat = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def build_graphs(vectors: DataFrame, top: int, width: int, degree: int = DEGREE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written graphs of all shards of vectors (vec_id, v without zero vectors; a written table)."""
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(tasks_for(vectors.count(), shard_rows)))
    return cut(vectors.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard(top, width, degree), GRAPH), "ann-graphs")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, beam: int = QUERY_BEAM, degree: int = DEGREE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of each query's nearest found. vectors and queries: vec_id and v."""
    spark = vectors.sparkSession
    nonzero = F.exists("v", lambda x: x != 0)
    vectors = cut(vectors.filter(nonzero), "ann-rows")
    width, asked = (df.agg(F.max(F.size("v"))).first()[0] for df in (vectors, queries))
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width or not asked:
        return nothing
    width = max(width, asked)
    graphs = build_graphs(vectors, top, width, degree, shard_rows)
    spend(vectors)

    def search(qid, q):
        chunk = spark.sparkContext.broadcast((qid, q))
        with scoped(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": 1}):  # a shard's graph at a time
            found = cut(best_per_query(graphs.mapInArrow(_search_graphs(chunk, top, width, beam, degree), FOUND), top), "ann-found")
        chunk.destroy()
        return found

    found = by_chunks(queries.filter(nonzero), QUERY_CHUNK, width, search)
    spend(graphs)
    return nothing if found is None else found


def op6_graph_neighbours(spark, sf_dir):
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
