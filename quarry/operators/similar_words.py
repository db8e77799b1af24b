"""The closest vocabulary entry of each word by matching blocks, found by segments that an edit script must leave whole.

Similarity of two words is twice the letters in their matching blocks (the longest common block, then the same to its left and to
its right) over the letters of both. Matching blocks are a common subsequence, so words of a and b letters with a ratio of r or more
are at most (1 - r)(a + b) insertions and deletions apart. With d of those, one of d + 1 segments of the entry is whole in the word, moved
by no more than the insertions before it: an equi-join on lengths, segment and letters that loses no pair at any length. What meets
is held against the edit distance in the JVM, and what is left against the ratio itself.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edits(a: Column, b: Column, ratio: Fraction) -> Column:
    """The most insertions and deletions between words of a and b letters at the ratio: of the parity of a + b; negative if there can be none."""
    apart = ratio.denominator - ratio.numerator
    most = F.floor((a + b) * apart / ratio.denominator + F.lit(1e-9)).cast("int")
    most = most - F.pmod(most + a + b, F.lit(2))
    return F.when(most >= F.abs(a - b), most).otherwise(-1)


def lengths(n: Column, ratio: Fraction) -> Column:
    """Lengths that a partner of a word of n letters can have."""
    low, high = ratio.numerator, 2 * ratio.denominator - ratio.numerator
    return F.sequence(F.ceil(n * low / high - F.lit(1e-9)).cast("int"), F.floor(n * high / low + F.lit(1e-9)).cast("int"))


def _segment(b: Column, k: Column, d: Column) -> tuple[Column, Column]:
    """Where segment k of d + 1 begins in a word of b letters (from 0), and how long it is."""
    begin = F.floor(k * b / (d + 1)).cast("int")
    return begin, F.floor((k + 1) * b / (d + 1)).cast("int") - begin


def _by_segment(words: DataFrame, ratio: Fraction, own: str, other: str) -> DataFrame:
    """words with a, b (letters of the word and of the entry), d and k, a row for each segment of each length of a partner."""
    rows = words.withColumn(own, F.char_length("word")).withColumn(other, F.explode(lengths(F.col(own), ratio)))
    rows = rows.withColumn("d", edits(F.col("a"), F.col("b"), ratio)).filter("d >= 0")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d"))))


def candidates(words: DataFrame, entries: DataFrame, ratio: Fraction) -> DataFrame:
    """word, entry: all pairs that can have the ratio, by segments and edit distance. Both sides are distinct words in a column named word."""
    begin, size = _segment(F.col("b"), F.col("k"), F.col("d"))
    held = _by_segment(entries, ratio, "b", "a").select(F.col("word").alias("entry"), "a", "b", "k", F.substring("word", begin + 1, size).alias("part"))
    moved = F.sequence(-((F.col("d") - F.col("a") + F.col("b")) / 2).cast("int"), ((F.col("d") + F.col("a") - F.col("b")) / 2).cast("int"))
    asked = _by_segment(words, ratio, "a", "b").withColumn("at", begin).withColumn("size", size).withColumn("at", F.explode(F.transform(moved, lambda m: F.col("at") + m)))
    asked = asked.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("a"))).select("word", "a", "b", "k", F.substring("word", F.col("at") + 1, F.col("size")).alias("part"))
    met = asked.distinct().join(held, ["a", "b", "k", "part"])
    return met.filter(F.levenshtein("word", "entry") <= edits(F.col("a"), F.col("b"), ratio)).select("word", "entry").distinct()


def block_ratio(word: Column, entry: Column) -> Column:
    """Similarity by matching blocks, the entry as the first of the two."""
    import pandas as pd

    def run(words, entries):
        from difflib import SequenceMatcher

        matcher = SequenceMatcher(autojunk=False)
        out = []
        for w, e in zip(words, entries, strict=True):
            matcher.set_seqs(e, w)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"words": pd.Series, "entries": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(word, entry)


def closest(words: DataFrame, entries: DataFrame, ratio: str = "0.86") -> DataFrame:
    """word, fixed, ratio: the closest entry of each word at the ratio or more; ties go to the entry that sorts last.

    words and entries have a column named word. Null and empty words meet nothing; a word that is an entry is its own closest one.
    """
    least = Fraction(ratio)
    some = lambda rows: rows.filter("word <> ''").select("word").distinct()
    scored = candidates(some(words), some(entries), least).withColumn("ratio", block_ratio(F.col("word"), F.col("entry")))
    best = F.max(F.struct("ratio", "entry"))
    return scored.filter(F.col("ratio") >= float(least)).groupBy("word").agg(best.alias("m")).select("word", F.col("m.entry").alias("fixed"), "m.ratio")
