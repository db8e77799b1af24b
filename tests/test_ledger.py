"""A phase is scored once: refusals change nothing, choices carry over."""

import os

import pytest

from quarry.operators import ledger as G

ARMS = [("a", "x"), ("b", "x"), ("a", "y")]


def rows(spark, *values):
    return lambda: spark.createDataFrame([(c, m, q, float(mrr), float(hit)) for (c, m), q, mrr, hit in values], G.ROWS)


def fail():
    raise AssertionError("the questions were read")


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def test_a_phase_is_scored_once(spark, tmp_path):
    ledger = G.Ledger(f"file://{tmp_path}", "v1")
    G.score(spark, ledger, "development", rows(spark, (ARMS[0], 1, 0.5, 1), (ARMS[1], 1, 1, 1)), ARMS)
    before = files(tmp_path)
    with pytest.raises(G.Refused, match="has been scored"):
        G.score(spark, ledger, "development", fail, ARMS)
    assert files(tmp_path) == before
    assert G.chosen(spark, ledger, "development") == ARMS[1]
    got = {tuple(r) for r in G.results(spark, ledger, ["development", "reserved"]).collect()}
    assert got == {("development", "a", "x", 1, 0.5, 1.0, False), ("development", "b", "x", 1, 1.0, 1.0, True)}


def test_of_two_runs_at_once_one_counts(spark, tmp_path):
    ledger = G.Ledger(f"file://{tmp_path}", "v1")

    def slow():  # another run commits while this one is computing
        G.score(spark, ledger, "p", rows(spark, (ARMS[0], 1, 1, 1)), ARMS)
        return rows(spark, (ARMS[1], 1, 1, 1))()

    with pytest.raises(G.Refused, match="meanwhile"):
        G.score(spark, ledger, "p", slow, ARMS)
    assert [r.corpus for r in G.results(spark, ledger, ["p"]).collect()] == ["a"]
    assert len(os.listdir(tmp_path / "parts")) == 1


def test_a_run_that_broke_off_leaves_nothing_that_counts(spark, tmp_path):
    ledger = G.Ledger(f"file://{tmp_path}", "v1")
    with pytest.raises(ValueError, match="without a place"):
        G.score(spark, ledger, "p", rows(spark, (("z", "z"), 1, 1, 1)), ARMS)
    assert G.results(spark, ledger, ["p"]).count() == 0
    G.score(spark, ledger, "p", rows(spark, (ARMS[0], 1, 1, 1)), ARMS)
    assert G.results(spark, ledger, ["p"]).count() == 1


def test_choices(spark, tmp_path):
    ledger = G.Ledger(f"file://{tmp_path}", "v1")
    with pytest.raises(G.Refused, match="choose an arm"):
        G.chosen(spark, ledger, "development")
    tie = [(arm, q, 0.5, hit) for arm, hit in zip(ARMS, (0, 1, 1)) for q in (1, 2)]
    assert G.score(spark, ledger, "development", rows(spark, *tie), ARMS)["chosen"] == ARMS[1]
    with pytest.raises(G.Refused, match="configuration has changed"):
        G.chosen(spark, G.Ledger(ledger.folder, "v2"), "development")
    G.score(spark, ledger, "empty", rows(spark), ARMS)
    with pytest.raises(G.Refused, match="choose an arm"):
        G.chosen(spark, ledger, "empty")


def test_a_torn_commit_is_refused(spark, tmp_path):
    ledger = G.Ledger(f"file://{tmp_path}", "v1")
    os.makedirs(tmp_path / "commits")
    (tmp_path / "commits" / "p.json").touch()
    with pytest.raises(G.Refused, match="empty"):
        G.score(spark, ledger, "p", fail, ARMS)
