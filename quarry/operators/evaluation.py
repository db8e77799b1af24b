"""Retrieval evaluation: graded gains, reciprocal rank, hits, subsets, sets of evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.operators.lexical import BLOCK, word_codes
from quarry.scratch import cut, in_blocks


class Grams:
    """The word n-grams of a block of passages: by a number for each, its words as places in `words` and the passages that have it."""

    def __init__(self, passages: DataFrame, width: int):
        held = passages.select("query", "words", "text").toArrow().combine_chunks()
        self.queries, self.kind, self.texts = held.column("query").combine_chunks(), passages.schema["query"].dataType, held.column("text").to_pylist()
        lists = held.column("words").combine_chunks()
        self.words, self.width = lists.flatten().unique(), width
        codes, many = word_codes(lists, self.words)
        at, owner = self.places(codes, many)
        grams = np.stack([codes[at + j] for j in range(width)], axis=1)
        self.grams, of = np.unique(grams, axis=0, return_inverse=True) if len(at) else (grams, np.zeros(0, np.int64))
        pairs = np.unique(of.reshape(-1) * max(1, len(lists)) + owner)
        gram, self.owner = np.divmod(pairs, max(1, len(lists)))
        self.begin = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        self.base = 0x9E3779B97F4A7C15
        while len(np.unique(self.numbers(self.grams))) < len(self.grams):  # no two grams share a number
            self.base += 2
        self.order = np.argsort(self.numbers(self.grams))
        self.sorted = self.numbers(self.grams)[self.order]

    def places(self, codes, many):
        """Where width words follow each other in one list, all of them words of passages, and in which list."""
        ends = np.cumsum(many)
        owner = np.repeat(np.arange(len(many)), many)
        bad = np.concatenate([[0], np.cumsum(codes < 0)])
        at = np.arange(max(0, len(codes) - self.width + 1))
        at = at[(bad[at + self.width] == bad[at]) & (at + self.width <= ends[owner[at]])]
        return at, owner[at]

    def numbers(self, grams) -> np.ndarray:
        out = np.zeros(len(grams), np.uint64)
        for j in range(self.width):
            out = out * np.uint64(self.base) + grams[:, j].astype(np.uint64)
        return out

    def met(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(list, passage) of all that share a gram, each pair once."""
        codes, many = word_codes(lists, self.words)
        at, owner = self.places(codes, many)
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = np.stack([codes[at + j] for j in range(self.width)], axis=1)
        numbers = self.numbers(grams)
        gram = self.order[np.minimum(np.searchsorted(self.sorted, numbers), len(self.sorted) - 1)]
        same = np.flatnonzero((self.grams[gram] == grams).all(axis=1))  # word by word
        gram, owner = gram[same], owner[same]
        n = self.begin[gram + 1] - self.begin[gram]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[gram] - (ends - n), n)
        return np.divmod(np.unique(np.repeat(owner, n) * len(self.queries) + self.owner[places]), len(self.queries))


def shared_grams(docs: DataFrame, passages: DataFrame, width: int, *keep: str) -> DataFrame:
    """query, id, gain and the columns to keep: 2 where a document (id, words, text) contains a passage (query, words, text), 1 where they only share width words in a row; a written table.

    Documents stay where they are read, and words are compared themselves; BLOCK passages at a time are known to every task.
    """

    def of_block(block: DataFrame) -> DataFrame:
        grams = Grams(block, width)

        def run(batches):
            for b in batches:
                doc, query = grams.met(b.column("words"))
                texts = b.column("text")
                gains = [2 if grams.texts[q] in texts[d].as_py() else 1 for d, q in zip(doc.tolist(), query.tolist(), strict=True)]
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([grams.queries.take(pa.array(query)), b.column("id").take(at), pa.array(gains, pa.int32()), *(b.column(c).take(at) for c in keep)], names=["query", "id", "gain", *keep])

        out = StructType([StructField("query", grams.kind), docs.schema["id"]]).add("gain", "integer")
        for c in keep:
            out = out.add(docs.schema[c])
        return cut(docs.select("id", "words", "text", *keep).mapInArrow(run, out), "judged")

    return in_blocks(passages, "query", BLOCK, of_block)


def per_query(run: DataFrame, judged: DataFrame, cutoffs=(1, 3, 5)) -> DataFrame:
    """query, mrr, ndcg_k, hit_k for every judged query; a query without results scores 0.

    run: query, id, rank. judged: query, id, gain. Gains are linear over log2(rank + 1), the ideal order is of all judged gains.
    """
    seen = run.join(judged, ["query", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    discount = lambda r: 1 / F.log2(F.col(r) + 1)
    got = seen.groupBy("query").agg(
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("gain") * discount("rank")).otherwise(0.0)).alias(f"dcg_{k}") for k in cutoffs],
    )
    place = Window.partitionBy("query").orderBy(F.desc("gain"), "id")
    ideal = judged.withColumn("place", F.row_number().over(place)).groupBy("query").agg(*[F.sum(F.when(F.col("place") <= k, F.col("gain") * discount("place")).otherwise(0.0)).alias(f"best_{k}") for k in cutoffs])
    joined = ideal.join(got, "query", "left")
    share = lambda k: F.when(F.col(f"best_{k}") > 0, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"best_{k}")).otherwise(0.0)
    return joined.select(
        "query",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        *[share(k).alias(f"ndcg_{k}") for k in cutoffs],
        *[F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in cutoffs],
    )


def means(rows: DataFrame, columns: list[str]) -> list:
    return [F.round(F.avg(c), 6).alias(c) for c in columns]
