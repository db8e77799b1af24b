"""A lexical index that outlives a query: postings by document block and term, with what bounds the scores of a block.

A cell is a combination of facets (language, source); a scope is one value of one facet, or all documents. Documents of a cell and
of about one size form blocks of some BLOCK_DOCS. The index is one Parquet table, laid out by the first facet and by term block: a
row for each term of each block with its postings (places in the block and frequencies), and beside them how many there are, the
largest frequency and the least length; a row for the block itself has its ids and lengths. Numbers of documents, mean lengths and
document frequencies of any scope are sums over its blocks, so scopes are ranked by their own statistics without an index of
their own.

A search reads the heads of the asked terms, without postings, and bounds every block's scores for every request. The blocks with
the largest bounds are scored first; the k-th best score found there is a floor, and blocks whose bound lies below it are
skipped: no document of theirs can be among the k best. Only what is left is scored. As a document lies in one block, a block
gives at most k rows for each request. Results are those of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.lexical import top
from quarry.scratch import cut, fresh_path, scoped, spend

#: Documents in a block on average; how many parts the terms are laid out in; blocks that a request scores before it has a floor.
BLOCK_DOCS, TERM_BLOCKS, SEEDS = 256, 4, 6
#: Stands for a document among its own terms; no text has it as a word.
WHOLE = ""
ALL = "all"


@dataclass(frozen=True)
class Index:
    folder: str
    facets: tuple[str, ...]
    schema: StructType

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.folder)


def scope_of(facet: str, value) -> Column:
    """The name of a scope; null for a null value."""
    return F.concat(F.lit(facet + "="), value)


def _home(index_facets: tuple[str, ...]) -> Column:
    """The folder of a row: the scope of its first facet; rows without one share a folder."""
    return F.coalesce(scope_of(index_facets[0], F.col(index_facets[0])) if index_facets else F.lit(None), F.lit("-"))


def _term_block(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BLOCKS)).cast("int")


def _postings(counts, facets: tuple[str, ...]):
    """The rows of each block of a partition; its documents follow each other."""

    def rows_of(block, cell, ids: list, held: list) -> pa.RecordBatch:
        terms, tfs = [WHOLE] * len(held), [1] * len(held)
        for found in held:
            terms += found
            tfs += found.values()
        places = np.concatenate([np.arange(len(held)), np.repeat(np.arange(len(held)), [len(x) for x in held])])
        lengths = np.array([sum(x.values()) for x in held], np.int64)
        coded = pa.array(terms, pa.string()).dictionary_encode()
        code, tf = coded.indices.to_numpy(), np.array(tfs, np.int64)
        order = np.argsort(code, kind="stable")  # the block itself was first, and so has code 0
        begin = np.flatnonzero(np.diff(code[order], prepend=-1))
        places, tf, n = places[order], tf[order], len(begin)
        df = np.diff(np.append(begin, len(order)))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), pa.array(x.astype(np.int32)))
        once = lambda x, kind: pa.array([x, *[None] * (n - 1)], pa.list_(kind))
        cols = [pa.array([block] * n, pa.int64()), *(pa.array([v] * n, pa.string()) for v in cell), coded.dictionary, pa.array(df, pa.int64()), pa.array(np.maximum.reduceat(tf, begin), pa.int64())]
        cols += [pa.array(np.minimum.reduceat(lengths[places], begin), pa.int64()), pa.array(np.add.reduceat(lengths[places], begin), pa.int64()), lists(places), lists(tf), once(ids, pa.int64()), once(lengths.tolist(), pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["block", *facets, "term", "df", "max_tf", "min_length", "total", "places", "tfs", "ids", "lengths"])

    def run(batches):
        at, cell, ids, held = None, (), [], []
        for batch in batches:
            for block, i, text, *values in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "text", *facets)), strict=True):
                if held and block != at:
                    yield rows_of(at, cell, ids, held)
                    ids, held = [], []
                at, cell = block, values
                ids.append(i)
                held.append(counts(text or ""))
        if held:
            yield rows_of(at, cell, ids, held)

    return run


def build(docs: DataFrame, counts, facets: tuple[str, ...], folder: str | None = None, block_docs: int = BLOCK_DOCS) -> Index:
    """Index docs (id, text and the facets, which are strings). counts: words of a lower-cased text with their numbers, in plain Python.

    A row's block follows from its cell, the power of two below its size and a hash of its id, so no block grows with the table.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "index")
    level = F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).cast("int")
    rows = docs.select("id", "text", *facets, level.alias("level"))
    cell = [*facets, "level"]
    parts = cut(rows.groupBy(*cell).agg(F.ceil(F.count("*") / block_docs).cast("int").alias("parts")), "index-cells")
    name = lambda nth, seed: F.xxhash64(*[F.coalesce(scope_of(f, F.col(f)), F.lit("-")) for f in facets], "level", nth, F.lit(seed))
    seed = 0
    while True:  # until no two blocks share a name, which is nearly always at once
        names = parts.select(*cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth")).select(name(F.col("nth"), seed).alias("name"))
        if names.agg(F.count("*") == F.count_distinct("name")).first()[0]:
            break
        seed += 1
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(c + "_of"))
    rows = rows.join(parts.toDF(*[c + "_of" for c in cell], "parts"), same).withColumn("block", name(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), seed))
    dealt = rows.select("block", "id", *facets, F.lower("text").alias("text")).repartition("block").sortWithinPartitions("block")
    kinds = "".join(f"`{f}` string, " for f in facets)
    lists = dealt.mapInArrow(_postings(counts, facets), f"block long, {kinds}term string, df long, max_tf long, min_length long, total long, places array<int>, tfs array<int>, ids array<long>, lengths array<int>")
    laid = lists.withColumn("home", _home(facets)).withColumn("term_block", _term_block("term"))
    with scoped(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        laid.write.partitionBy("home", "term_block").parquet(folder)
    spend(parts)
    return Index(folder, facets, laid.schema)


def part(tf, length, mean, k1: float, b: float) -> Column:
    """What a term adds to a score, but for its weight; grows with tf and falls with length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _scopes(index: Index) -> Column:
    """The scopes that a row of the index belongs to."""
    return F.array_compact(F.array(F.lit(ALL), *[scope_of(f, F.col(f)) for f in index.facets]))


def _heads(spark: SparkSession, index: Index, asked: DataFrame, terms: DataFrame) -> DataFrame:
    """scope, term, block, df, max_tf, min_length, total: every block of the asked scopes that has an asked term, and each block's WHOLE."""
    table = index.table(spark).select("home", "term", "term_block", "block", *index.facets, "df", "max_tf", "min_length", "total")
    if index.facets and asked.agg(F.bool_and(F.col("scope").startswith(index.facets[0] + "="))).first()[0]:
        table = table.join(asked.select(F.col("scope").alias("home")).distinct(), "home", "left_semi")  # folders of other scopes stay unread
    rows = table.join(terms, ["term_block", "term"], "left_semi").withColumn("scope", F.explode(_scopes(index)))
    pairs = asked.select("scope", "term").unionByName(asked.select("scope", F.lit(WHOLE).alias("term"))).distinct()
    return rows.join(pairs, ["scope", "term"], "left_semi").select("scope", "term", "block", "df", "max_tf", "min_length", "total")


#: Scores that a task holds at once.
HELD = 1 << 22


def _best(k: int, k1: float, b: float):
    """The k best documents of a block for each request, from the block's postings and the requests' weights."""

    def run(postings, asked):
        names = postings.column("term").to_pylist()
        if WHOLE not in names or not len(asked):
            return pa.table({"nth": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = names.index(WHOLE)
        ids, lengths = (np.array(postings.column(c)[own].as_py(), np.int64) for c in ("ids", "lengths"))
        flat = lambda c: postings.column(c).combine_chunks().flatten().to_numpy()
        places, tfs = flat("places"), flat("tfs").astype(float)
        size = np.array(postings.column("places").combine_chunks().value_lengths())
        begin = np.cumsum(size) - size
        code = {t: i for i, t in enumerate(names) if t != WHOLE}
        nths, means = asked.column("nth").to_numpy(), asked.column("mean").to_numpy()
        many = np.array(asked.column("terms").combine_chunks().value_lengths())
        terms = np.array([code.get(t, -1) for t in asked.column("terms").combine_chunks().flatten().to_pylist()], np.int64)
        idfs, of = flat_of(asked, "idfs"), np.repeat(np.arange(len(nths)), many)
        met = terms >= 0
        terms, idfs, of = terms[met], idfs[met], of[met]
        out, step = [], max(1, HELD // len(ids))
        for c in range(0, len(nths), step):
            some = (of >= c) & (of < c + step)
            n = size[terms[some]]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[terms[some]] - (ends - n), n)
            row, doc, tf = np.repeat(of[some], n), places[at], tfs[at]
            parts = np.repeat(idfs[some], n) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / means[row])))
            rows = min(step, len(nths) - c)
            scores = np.floor(np.bincount((row - c) * len(ids) + doc, parts, rows * len(ids)) * 1e6 + 0.5).reshape(rows, len(ids)) / 1e6
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if k < len(ids) else 0
            r, d = np.nonzero((scores >= least) & (scores > 0))
            order = np.lexsort((ids[d], -scores[r, d], r))
            r, d = r[order], d[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((nths[c + r[first]], ids[d[first]], scores[r, d][first]))
        nth, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"nth": nth, "id": found, "score": score})

    return run


def flat_of(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy()


def _scores(spark, index: Index, weights: DataFrame, terms: DataFrame, pairs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """nth, id, score: of every block asked for (nth, block) the k best documents that share a term with the request."""
    wanted = pairs.select("nth", "block").join(weights, "nth")
    table = index.table(spark).join(terms, ["term_block", "term"], "left_semi").select("block", "term", "places", "tfs", "ids", "lengths")
    postings = table.join(pairs.select("block").distinct(), "block", "left_semi")
    return postings.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_best(k, k1, b), "nth long, id long, score double")


def search(spark: SparkSession, index: Index, requests: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The k best of each request (request, id, score, rank), and its blocks (request, blocks, skipped).

    requests: request (each of them once), scope, words; a word counts once. Statistics are of the request's scope. Ties go to the smaller id.
    """
    named = cut(requests.select("request", "scope", "words", F.xxhash64(F.struct("request")).alias("nth")), "requests")
    asked = cut(named.select("nth", "scope", F.explode("words").alias("term")).distinct(), "asked")
    terms = cut(asked.select("term").unionByName(spark.range(1).select(F.lit(WHOLE).alias("term"))).distinct().withColumn("term_block", _term_block("term")), "asked-terms")
    heads = cut(_heads(spark, index, asked, terms), "index-heads")
    corpus = heads.filter(F.col("term") == WHOLE).groupBy("scope").agg(F.sum("df").alias("n"), F.greatest(F.sum("total") / F.sum("df"), F.lit(1.0)).alias("mean"))
    dfs = heads.filter(F.col("term") != WHOLE).groupBy("scope", "term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = cut(asked.join(dfs, ["scope", "term"]).join(corpus, "scope").select("nth", "scope", "term", idf.alias("idf"), "mean"), "weighed")
    lists = weighed.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("w"), F.first("mean").alias("mean"))
    weights = cut(lists.select("nth", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"), "mean"), "weights")
    bound = F.sum(F.col("idf") * part(F.col("max_tf"), F.col("min_length"), F.col("mean"), k1, b))
    bounds = cut(heads.join(weighed, ["scope", "term"]).groupBy("nth", "block").agg(bound.alias("bound")), "bounds")
    spend(heads, asked, weighed)
    seeds = cut(top(bounds, SEEDS, by="nth", score="bound", key="block").select("nth", "block"), "seeds")
    floors = top(_scores(spark, index, weights, terms, seeds, k, k1, b), k, by="nth", key="id").filter(F.col("rank") == k).select("nth", F.col("score").alias("floor"))
    judged = cut(bounds.join(floors, "nth", "left").withColumn("skipped", F.coalesce(F.col("bound") < F.col("floor") - 1e-5, F.lit(False))), "judged")
    spend(bounds, seeds)
    best = top(_scores(spark, index, weights, terms, judged.filter("not skipped"), k, k1, b), k, by="nth", key="id")
    best = cut(best.join(named.select("nth", "request"), "nth").select("request", "id", "score", "rank"), "best")
    blocks = cut(judged.groupBy("nth").agg(F.count("*").alias("blocks"), F.count_if("skipped").alias("skipped")).join(named.select("nth", "request"), "nth").select("request", "blocks", "skipped"), "blocks")
    spend(named, terms, weights, judged)
    return best, blocks


#: Indexes written by this process: (application, what was indexed) -> Index.
_known: dict[tuple, Index] = {}


def of_table(spark: SparkSession, path: str, key: str, text: str, counts, facets: tuple[str, ...]) -> Index:
    """The index of the Parquet table at path, written when it is first asked for and again once a file of the table is another.

    counts must be a module's function: its name is part of what the index is known by.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "modificationTime", "length").alias("h"))
    state = files.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    name = (spark.sparkContext.applicationId, path, f"{counts.__module__}.{counts.__name__}", facets, state.n, str(state.h))
    if name not in _known:
        docs = spark.read.parquet(path).select(F.col(key).alias("id"), F.col(text).alias("text"), *facets)
        _known[name] = build(docs, counts, facets)
    return _known[name]
