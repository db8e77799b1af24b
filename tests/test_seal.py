"""Seals against plain Python, and the keys that a broken seal leads to."""

import hashlib
from collections import Counter, defaultdict

import pytest

from quarry.operators import seal as S
from quarry.scratch import fresh_path

SCHEMA = "id long, lang string, text string, more string"


def sealed(spark, rows, parts=3):
    path = fresh_path(spark, "seal")
    got = S.seal(spark.createDataFrame(rows, SCHEMA).repartition(parts), "lang", "id", ["id", "text"], path)
    return path, {r.part: (r.members, r.root) for r in got.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """part -> (members, root) by loops."""
    out = {}
    for part in {r[1] for r in rows}:
        keys = defaultdict(Counter)
        for i, lang, text, _ in rows:
            if lang == part:
                cells = [None if v is None else str(v) for v in (i, text)]
                keys[i][sha("".join("-" if c is None else f"{len(c.encode())}:{c}" for c in cells))] += 1
        level = {k: sha(",".join(f"{d}:{n}" for d, n in sorted(c.items()))) for k, c in keys.items()}
        for n in range(6):
            up = defaultdict(list)
            for k, d in level.items():
                up[0 if n == 5 else None if k is None else k >> 12].append((-(1 << 63) if k is None else k, d))
            level = {u: sha(",".join(f"{k}:{d}" for k, d in sorted(v))) for u, v in up.items()}
        out[part] = (sum(sum(c.values()) for c in keys.values()), level[0])
    return out


ROWS = [(i * 977, ("de", "en", None)[i % 3], f"text é {i}", "x") for i in range(60)] + [(5, "de", "again", "x")] * 4 + [(5, "de", None, "x"), (None, "de", "", "x"), (None, None, None, "x"), (-8, "en", "", "x"), (1 << 62, "en", "far", "x")]


def test_roots_and_any_order(spark):
    _, one = sealed(spark, ROWS)
    _, two = sealed(spark, ROWS[::-1], 7)
    assert one == two == plain(ROWS)


@pytest.mark.parametrize("named", [1000, 1])
def test_differences_are_found(spark, monkeypatch, named):
    monkeypatch.setattr(S, "NAMED", named)
    there = [r for r in ROWS if r[0] != 977 * 3]  # lost
    there = [(i, lang, "other" if i == 977 * 7 else text, more) for i, lang, text, more in there]  # changed
    there += [(123_456_789_012, "en", "new", "x"), (1, "fr", "new part", "x")]  # added
    there.remove((5, "de", "again", "x"))  # one copy fewer
    there = [(None, lang, "was null" if lang is None and i is None else text, more) if i is None else (i, lang, text, more) for i, lang, text, more in there]
    (old, _), (new, roots) = sealed(spark, ROWS), sealed(spark, there)
    assert roots == plain(there)
    got = {(r.part, r.node): r.status for r in S.differences(spark, old, new).collect()}
    assert got == {("de", 977 * 3): "lost", ("en", 977 * 7): "changed", ("en", 123_456_789_012): "added", ("fr", 1): "added", ("de", 5): "changed", (None, None): "changed"}


def test_only_differing_ranges_are_read(spark):
    rows = [(i * 3000, "en", str(i), "x") for i in range(200)]
    (old, _), (new, _) = sealed(spark, rows), sealed(spark, [*rows[:100], (300_000, "en", "other", "x"), *rows[101:]])
    found = S.differences(spark, old, new)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "up#" in plan and f"= {300_000 >> 12})" in plan and "PushedFilters: [" in plan
    assert [(r.node, r.status) for r in found.collect()] == [(300_000, "changed")]


def test_equal_and_empty(spark):
    (a, _), (b, none) = sealed(spark, ROWS), sealed(spark, [])
    assert none == {} and S.differences(spark, a, a).count() == 0 and S.differences(spark, b, b).count() == 0
    got = S.differences(spark, a, b).collect()
    assert len(got) == len({(r[0], r[1]) for r in ROWS}) and {r.status for r in got} == {"lost"}
