"""Operators on hand-written rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.operators import coverage, evaluation, lexical, structure
from quarry.plans import intent
from quarry.sources import trec


def test_interval_cover(spark):
    units = spark.createDataFrame([("touch", 10), ("gap", 10), ("overlap", 6), ("none", 3), ("empty", 0)], "u string, length int")
    spans = spark.createDataFrame([("touch", 0, 4), ("touch", 4, 10), ("gap", 0, 4), ("gap", 5, 10), ("overlap", 0, 4), ("overlap", 2, 6), ("overlap", 2, 6)], "u string, start int, stop int")
    got = {r.u: (r.covered, r.complete) for r in coverage.interval_cover(spans, units, "u").collect()}
    assert got == {"touch": (10, True), "gap": (9, False), "overlap": (6, True), "none": (0, False), "empty": (0, True)}


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([([(1, 40, 11), (2, 90, 12), (3, 50, 13), (4, 20, 14), (5, 10, 15)],)], "items array<struct<rank: long, size: long, id: long>>")
    assert rows.select(coverage.greedy_keep(F.col("items"), 100).alias("k")).first().k == [11, 13, 15]


def test_perfect_and_missing_runs(spark):
    judged = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 20, 1)], "query int, id int, gain int")
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, id int, rank int")
    got = {r.query: r for r in evaluation.per_query(run, judged).collect()}
    assert (got[1].mrr, got[1].ndcg_5, got[1].hit_1) == (1.0, 1.0, 1.0)
    assert (got[2].mrr, got[2].ndcg_5, got[2].hit_5) == (0.0, 0.0, 0.0)


def test_bm25_is_the_formula(spark):
    import math

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "c"])], "id int, words array<string>")
    asked = spark.createDataFrame([("q", ["a", "a"])], "query string, words array<string>")
    once, twice = (lexical.bm25(docs, asked, 1.5, 0.75, weigh_query=w).first().score for w in (False, True))
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))
    assert once == pytest.approx(want, abs=1e-6) and twice == pytest.approx(2 * want, abs=1e-6)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranking_does_not_depend_on_partitions(spark, parts):
    rows = spark.range(50).select(F.lit(1).alias("query"), F.col("id"), (F.col("id") % 5).cast("double").alias("score")).repartition(parts)
    assert [r.id for r in lexical.top(rows, 4).orderBy("rank").collect()] == [4, 9, 14, 19]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.!? \n\té\u2003\U0001f600", max_size=300), st.integers(4, 60))
def test_chunks_tile_a_text_under_budget(text, budget):
    """Chunks tile the text, none is too large, and none could have taken the next character without passing the budget or a break."""
    ends = structure.Breaks(text).ends(budget)
    begins = [0, *ends[:-1]] if ends else []
    assert "".join(text[a:b] for a, b in zip(begins, ends, strict=True)) == text
    size = lambda a, b: len(text[a:b].encode())
    for a, b in zip(begins, ends, strict=True):
        assert size(a, b) <= budget
        if b < len(text) and size(a, b + 1) <= budget:  # ended early: behind white space, past the half of what the budget holds
            assert text[b - 1].isspace()
            room = max(e for e in range(b, len(text) + 1) if size(a, e) <= budget)
            assert 2 * (b - a) > room - a - 1


def test_chunks_end_with_sentences(spark):
    rows = spark.createDataFrame([(1, "One two three. Four five six. Seven"), (2, "alpha beta gamma"), (3, ""), (4, None), (5, "para ones\n\npara two three")], "id long, text string")
    got = {}
    for r in structure.sentence_chunks(rows, 20).orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.start, r.stop, r.bytes))
    assert got == {1: [(0, 15, 15), (15, 35, 20)], 2: [(0, 16, 16)], 5: [(0, 11, 11), (11, 25, 14)]}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_windows_cover_a_text(text):
    spans = structure.window_spans(text, 60, 30, 8)
    assert all(0 < b - a <= 60 for a, b in spans) and (not text or (spans[0][0] == 0 and spans[-1][1] == len(text)))
    for (_, stop), (start, _) in zip(spans[:-1], spans[1:], strict=True):
        assert start == stop - 8
        assert stop - 1 < len(text) and (text[stop - 1] in " \n" or text[stop - 60 + 30 : stop].count(" ") + text[stop - 60 + 30 : stop].count("\n") == 0)


def test_names_in_compatibility_form(spark):
    from quarry.functions import text as X

    rows = spark.createDataFrame([("ﬁ Ⅳ Straße", "fiivstrasse"), (None, None), (" ", "")], "t string, want string")
    assert all(r.got == r.want for r in rows.select(X.compact(F.col("t")).alias("got"), "want").collect())


def test_scratch_tables_go_when_spent(spark):
    from quarry import scratch

    before = spark.conf.get(scratch._CLEANUP, None)
    df = scratch.cut(spark.range(10).selectExpr("id", "id % 3 as k"), "t", by="k")
    path = scratch._written[df].removeprefix("file:")
    assert df.filter("k = 1").count() == 3 and __import__("os").path.isdir(path)
    scratch.spend(df, None, spark.range(1))
    assert not __import__("os").path.isdir(path) and spark.conf.get(scratch._CLEANUP, None) == before
    seen = []
    out = scratch.in_blocks(spark.range(100), "id", 30, lambda b: seen.append(1) or b)
    assert sorted(r.id for r in out.collect()) == list(range(100)) and len(seen) == 4


def test_wrong_arity_is_an_error(spark):
    lines = spark.createDataFrame([("q1 Q0 d1 1 0.5 tag",), ("q1 0 d1",)], "value string")
    with pytest.raises(PySparkException):
        trec.parse_run(lines).collect()


def test_files_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query string, id string, rank int")
    trec.write_run(ranked, str(tmp_path / "run"), "t")
    assert sorted((r.id, r["rank"], r.score) for r in trec.read_run(spark, str(tmp_path / "run")).collect()) == [("d1", 1, 1.0), ("d2", 2, 0.5)]
    trec.write_json_lines(ranked, str(tmp_path / "lines"))
    assert trec.read_json_lines(spark, str(tmp_path / "lines"), "query string, id string, rank int").count() == 2
    trec.write_csv(ranked, str(tmp_path / "csv"))
    assert trec.read_csv(spark, str(tmp_path / "csv"), "query string, id string, rank int").count() == 2
    with pytest.raises(PySparkException):
        trec.write_csv(ranked, str(tmp_path / "csv"))


def test_cascade_keeps_its_order(spark):
    rows = spark.createDataFrame([("why did the definition change",), ("compare why",), ("hello",)], "s string")
    got = [r.i for r in rows.select(intent.first_match(F.col("s"), intent.INTENTS, "find").alias("i")).collect()]
    assert got == ["define", "explain", "find"]


def test_follow_up_stream_equals_batch(spark):
    from quarry.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    streamed = {(r.conv_id, r.turn): r.resolved for r in QUERIES["followup_stream"](spark, sf).collect()}
    assert streamed == {(r.conv_id, r.turn): r.resolved for r in QUERIES["followup_resolve"](spark, sf).collect()}
