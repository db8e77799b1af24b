"""Closest words against the standard library's search over all pairs."""

import difflib
import random
from fractions import Fraction

from quarry.operators.similar_words import candidates, closest


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def slips(rng, word, n):
    letters = list(word)
    for _ in range(n):
        i = rng.randrange(len(letters) + 1)
        what = rng.choice("idrs")
        if what == "i":
            letters.insert(i, rng.choice("abcdeé"))
        elif letters and what == "d":
            del letters[i % len(letters)]
        elif letters and what == "r":
            letters[i % len(letters)] = rng.choice("abcde")
        elif len(letters) > 1:
            i %= len(letters) - 1
            letters[i], letters[i + 1] = letters[i + 1], letters[i]
    return "".join(letters)


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 34))) for _ in range(250)} | {"aaaaaaa", "aaaaaaaaaa", "abababababababab"})
    words = sorted({slips(rng, rng.choice(vocabulary), rng.randint(0, 6)) for _ in range(500)} | {"aaaaaaaa", "babababababababa", ""})
    for ratio in ("0.86", "0.7"):
        got = {r.word: (r.fixed, r.ratio) for r in closest(table(spark, words), table(spark, vocabulary), ratio).collect()}
        want = {}
        for w in filter(None, words):
            if near := difflib.get_close_matches(w, vocabulary, n=1, cutoff=float(ratio)):
                want[w] = (near[0], difflib.SequenceMatcher(None, near[0], w).ratio())
        assert got == want and sum(len(w) >= 15 for w in want) > 50


def test_two_edits_in_long_words(spark):
    got = {r.word: r.fixed for r in closest(table(spark, ["comonwealthh", "impairmants", "cat"]), table(spark, ["commonwealth", "impairments", "car"])).collect()}
    assert got == {"comonwealthh": "commonwealth", "impairmants": "impairments"}


def test_nulls_repeats_and_nothing(spark):
    some, none = table(spark, [None, "", "margin", "margin", "margins"]), table(spark, [])
    assert sorted((r.word, r.fixed) for r in closest(some, table(spark, ["margin", None, "", "margin"])).collect()) == [("margin", "margin"), ("margins", "margin")]
    assert closest(some, none).count() == closest(none, some).count() == 0


def test_segments_stay_an_equi_join(spark):
    plan = candidates(table(spark, ["a"]), table(spark, ["b"]), Fraction("0.86"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cross" not in plan and "(part" in plan
