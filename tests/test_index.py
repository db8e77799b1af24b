"""The scoped index against scoring everything in plain Python."""

import math
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import plain_counts
from quarry.operators import index as I

SCHEMA = "id long, text string, lang string, source string"


def plain_search(rows, words, scope, k, k1=1.5, b=0.75):
    within = [r for r in rows if scope == I.ALL or scope in (f"lang={r[2]}" if r[2] is not None else None, f"source={r[3]}" if r[3] is not None else None)]
    bags = {r[0]: Counter((r[1] or "").lower().split()) for r in within}
    mean = max(sum(x.total() for x in bags.values()) / max(len(bags), 1), 1)
    found = []
    for i, bag in bags.items():
        parts = []
        for w in set(words):
            df = sum(w in x for x in bags.values())
            if bag[w]:
                parts.append(math.log1p((len(bags) - df + 0.5) / (df + 0.5)) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * bag.total() / mean)))
        if parts:
            found.append((-round(sum(parts), 6), i))
    return [(i, round(-s, 5)) for s, i in sorted(found)[:k]]


@pytest.mark.parametrize("seed, block", [(0, 1), (1, 5), (2, 1000)])
def test_search_is_that_of_scoring_everything(spark, seed, block):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(terms, weights=[40 / (j + 1) for j in range(40)], k=rng.choice([1, 3, 30]))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "", None])) for i in range(300)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", None), (1002, "only one here", "fr", "z"), *[(2000 + i, "t1 t2 t3", "en", "a") for i in range(8)]]
    index = I.build(spark.createDataFrame(rows, SCHEMA), plain_counts, ("lang", "source"), block_docs=block)
    asked = [(f"{n}/{scope}", scope, words) for n, words in enumerate([["t1", "t2", "t3"], ["t39", "t0"], ["only", "t5", "t5"], ["nowhere"], []]) for scope in (I.ALL, "source=", "lang=en", "lang=fr", "source=b", "source=none", "lang=")]
    best, blocks = I.search(spark, index, spark.createDataFrame(asked, "request string, scope string, words array<string>"), 4)
    got = {}
    for r in best.orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append((r.id, round(r.score, 5)))
    for name, scope, words in asked:
        want = plain_search(rows, words, scope, 4)
        assert [i for i, _ in got.get(name, [])] == [i for i, _ in want]
        assert all(abs(x - y) < 1e-4 for (_, x), (_, y) in zip(got.get(name, []), want, strict=True))
    within = [x for x in asked if x[1].startswith("lang=")]
    again = I.search(spark, index, spark.createDataFrame(within, "request string, scope string, words array<string>"), 4)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, best.filter("request like '%lang=%'").collect()))
    met, skipped = blocks.agg(F.sum("blocks"), F.sum("skipped")).first()
    assert skipped <= met and (block > 5 or skipped > 0)


def test_a_second_query_reads_no_text(spark, tmp_path):
    rows = [(i, f"word{i % 7} word{i % 3} common", "en", "s") for i in range(50)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    index = I.of_table(spark, path, "id", "text", plain_counts, ("lang", "source"))
    assert I.of_table(spark, path, "id", "text", plain_counts, ("lang", "source")) is index
    ask = spark.createDataFrame([("q", "lang=en", ["word3", "word1"])], "request string, scope string, words array<string>")
    first = I.search(spark, index, ask, 5)[0].collect()
    shutil.rmtree(path)
    assert I.search(spark, index, ask, 5)[0].collect() == first and first
    spark.createDataFrame(rows[:20], SCHEMA).write.parquet(path)
    assert I.of_table(spark, path, "id", "text", plain_counts, ("lang", "source")) is not index


def test_no_documents(spark):
    index = I.build(spark.createDataFrame([], SCHEMA), plain_counts, ("lang", "source"))
    ask = spark.createDataFrame([("q", I.ALL, ["x"])], "request string, scope string, words array<string>")
    assert I.search(spark, index, ask, 5)[0].collect() == []
