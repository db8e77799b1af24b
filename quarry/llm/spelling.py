"""Spelling variants: words one edit apart, the commoner form of each word, and the root that its forms lead to.

Two words of a length that differ in place i, or a word and one that has a character more in place i, share what comes before i
and what comes after it. Words of one length, sorted forward, have a common beginning in one interval; sorted by their reversals,
a common end in one interval. Each word is a point (forward place, backward place), and the words near another at edit position i
are those in a rectangle, which a wavelet tree over the backward places in forward order reports, all rectangles at once.

An edit lies in one half of the word, so the other half stands. Words are therefore dealt out twice, by length and first half
(for edits behind it) and by length and second half (for edits in front), and each near pair is found once: a replaced character
has one place, an added one takes the last of a run of its like. A group of words is bounded by BLOCK_BYTES; a half that has
more words than that is split in blocks, and its queries meet every block. Groups return sums for each word, not pairs.

Words are counted where texts are read, so what is shuffled is a row for each distinct word of a task. Roots come from doubling
the steps to the commoner form, each of which has FACTOR times the occurrences, so the rounds are few.

Defined cases: null text has no words; texts and words of any length are taken whole; a null doc_id counts as an empty one;
repeated rows count as often as they occur; ties go to the smaller word in code-point order; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut, prepare, spend, table
from quarry.llm.shingles import slices
from quarry.llm.sql import CRC_TABLE, crc32, latin_octets

MIN_LENGTH, MIN_COUNT, FACTOR, DELETED = 6, 5, 5, 199
TEXT_BYTES, TASK_WORDS, BLOCK_BYTES, CHUNK = 4 << 20, 1 << 19, 1 << 19, 1 << 17
INDEX, REPLACED, LONGER = 0, 1, 2
NEAR = "word string, n_near long, best_n long, best string"


def _counts(min_length: int, deleted: int):
    """Words of a task with their occurrences; the run of a document whose checksum is due loses a character first."""

    def batch_of(total: dict):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        from collections import Counter

        runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}").findall
        crc = zlib.crc32
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                for doc, text in zip(part.column("doc_id").to_pylist(), pc.ascii_lower(part.column("text")).to_pylist(), strict=True):
                    found = Counter(runs(text or ""))
                    start = crc(b"%d:" % doc if doc is not None else b":")
                    due = [w for w in found if crc(w.encode(), start) % deleted == 0]
                    for w in due:
                        h, n = crc(w.encode(), start) % len(w), found.pop(w)
                        if len(w) > min_length:
                            total[w[:h] + w[h + 1 :]] += n
                    total.update(found)
                if len(total) > TASK_WORDS:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, deleted: int = DELETED) -> DataFrame:
    """word, n of the words of at least min_length code points and min_count occurrences; a written table."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counts(min_length, deleted), "word string, n long")
    return cut(rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "words")


class WaveletTree:
    """Range reporting over a permutation: a bit for each level and place, zeros before ones, with counts of zeros."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            self.levels.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value): the values in [low, high) at places in [lo, hi), for all rectangles."""
        ask, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.levels):
            width = 1 << (self.bits - 1 - level)  # of the values below a child
            a, b = zeros[lo], zeros[hi]
            left = (a < b) & (low[ask] < node + width)
            right = (lo - a < hi - b) & (high[ask] > node + width)
            ones = zeros[-1]
            lo, hi = np.concatenate([a[left], ones + (lo - a)[right]]), np.concatenate([b[left], ones + (hi - b)[right]])
            node, ask = np.concatenate([node[left], node[right] + width]), np.concatenate([ask[left], ask[right]])
            inside = (low[ask] < node + width) & (high[ask] > node)
            lo, hi, node, ask = lo[inside], hi[inside], node[inside], ask[inside]
        return ask, node


def matrix(words: list[str], width: int) -> np.ndarray:
    """A row of Latin-1 octets for each word, with zeros behind shorter ones."""
    return np.array([w.encode("latin-1") for w in words], f"S{width}").reshape(-1, 1).view(np.uint8).reshape(len(words), width)


def intervals(rows: np.ndarray, indexed: int, depths: range) -> tuple[np.ndarray, dict]:
    """The order of all rows, and for each depth the interval of indexed rows (the first ones) that begin with the same depth octets."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    ranked = rows[order]
    before = np.concatenate([[0], np.cumsum(order < indexed)])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    out = {}
    for d in range(depths.stop):
        if d in depths:
            begin = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            lo, hi = before[begin][group], before[np.append(begin[1:], n)][group]
            at = np.empty((2, n), np.int32)
            at[0, order], at[1, order] = lo, hi
            out[d] = at
        if d < width:
            fresh[1:] |= ranked[1:, d] != ranked[:-1, d]
    return order, out


def near_in_group(kinds: np.ndarray, words: list[str], n: np.ndarray, length: int, front: bool) -> pa.Table:
    """What the group's index words and queries find of each other: a row for each word that has a near one.

    length: code points of the index words. front: edits in front of the second half, else behind the first.
    """
    order = np.argsort(kinds, kind="stable")  # index words first
    kinds, n, words = kinds[order], n[order], [words[i] for i in order.tolist()]
    indexed, half = int((kinds == INDEX).sum()), length // 2
    rows = matrix(words, length)
    back = rows[:, ::-1].copy()
    longer = kinds == LONGER  # a character short: the zero stays at the end
    back[longer] = np.concatenate([rows[longer, :-1][:, ::-1], np.zeros((int(longer.sum()), 1), np.uint8)], axis=1)
    places = range(half) if front else range(half, length)
    forward_order, forward = intervals(rows, indexed, range(places.start, places.stop))
    backward_order, backward = intervals(back, indexed, range(length - places.stop, length - places.start))
    rank = np.empty(len(words), np.int64)
    rank[forward_order] = np.arange(len(words))  # in code-point order, for ties
    forward_words, backward_words = forward_order[forward_order < indexed], backward_order[backward_order < indexed]
    backward_place = np.empty(indexed, np.int64)
    backward_place[backward_words] = np.arange(indexed)
    tree = WaveletTree(backward_place[forward_words])
    sums = Sums(n, rank)
    queries = np.arange(indexed, len(words))
    for i in places:
        (lo, hi), (low, high) = forward[i][:, queries], backward[length - 1 - i][:, queries]
        asked = np.flatnonzero((lo < hi) & (low < high))
        for c in range(0, len(asked), CHUNK):
            some = asked[c : c + CHUNK]
            ask, value = tree.report(lo[some].astype(np.int64), hi[some].astype(np.int64), low[some], high[some])
            q, v = queries[some[ask]], backward_words[value]
            # a replacement must differ, an added character must not be followed by its like (zero stands behind the last)
            differs = rows[q, i] != rows[v, i]
            q, v = q[differs], v[differs]
            sums.add(q, v)
            added = kinds[q] == LONGER
            sums.add(v[added], q[added])
    who, found, best = sums.of()
    return pa.table({"word": pa.array([words[i] for i in who.tolist()], pa.string()), "n_near": pa.array(found, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array([words[i] for i in best.tolist()], pa.string())})


class Sums:
    """How many near words each word has, and the best of them: the commonest, then the smallest."""

    def __init__(self, n: np.ndarray, rank: np.ndarray):
        self.n, self.rank, self.parts = n, rank, []

    def add(self, word: np.ndarray, near: np.ndarray, times=1) -> None:
        if len(word):
            order = np.lexsort((self.rank[near], -self.n[near], word))
            word, near = word[order], near[order]
            times = np.broadcast_to(times, len(word))[order] if np.ndim(times) else np.full(len(word), times)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            self.parts.append((word[first], near[first], np.add.reduceat(times, first)))

    def of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, near words, best near word)."""
        parts, self.parts = self.parts, []
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        word, near, times = self.parts[0]
        return word, times, near


def _near(key, group):
    length, front = (x.as_py() for x in key[:2])
    return near_in_group(group.column("kind").to_numpy(), group.column("word").to_pylist(), group.column("n").to_numpy(), length, front)


def near_words(words: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, n_near, best_n, best of every word (word, n) that has a near one; best is the near word of largest n."""
    size = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    buckets = max(1, -(-size // block_bytes))
    length = F.char_length("word")
    kind = lambda k, n: F.struct(F.lit(k).alias("kind"), n.alias("length"))
    # the same half of a query: a word that lacks a character has one less in the half of the edit
    as_kinds = F.array(kind(INDEX, length), kind(REPLACED, length), kind(LONGER, length + 1))
    rows = words.select("word", "n", F.explode(as_kinds).alias("x")).select("word", "n", "x.*").withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    half = F.floor(F.col("length") / 2).cast("int")
    # in front: the last length - half characters; behind: the first half
    key = F.when(F.col("front"), F.substring("word", F.char_length("word") - (F.col("length") - half) + 1, F.col("length") - half)).otherwise(F.substring("word", F.lit(1), half))
    rows = rows.withColumn("key", F.xxhash64(key))
    by = ["length", "front", "key"]
    held = rows.filter(F.col("kind") == INDEX).groupBy(*by).agg(F.ceil(F.sum("length") / block_bytes).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(held, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # few: a row for each block_bytes at most
    own = lambda seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    indexes = F.col("kind") == INDEX
    dealt = rows.withColumn("other", F.explode(others)).withColumn("part", F.when(indexes, own(1) * F.col("parts") + F.col("other")).otherwise(F.col("other") * F.col("parts") + own(2)))
    dealt = dealt.withColumn("bucket", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.col("key"), F.lit(buckets))))
    found = dealt.groupBy("length", "front", "bucket", "parts", "part").applyInArrow(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from steps (word, form), none of which leads round in a circle: steps are doubled until all have ended."""
    steps = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not steps.filter("moved").isEmpty():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, steps = steps, cut(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        spend(before)
    return steps.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, deleted: int = DELETED) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; see the module's docstring."""
    words = word_counts(docs, min_length, min_count, deleted)
    near = near_words(words)
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = cut(rows, "variants")
    spend(words)
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


_FOLD = f"translate(x, '{UPPER}', '{LOWER}')"
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, {_FOLD} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS x FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {crc32(latin_octets("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM r, crc_table WHERE length(run) >= {MIN_LENGTH}),
w AS (SELECT CASE WHEN h % {DELETED} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
d AS (SELECT word, n, length(word) AS l, i, left(word, i) || chr(1) || substr(word, i + 2) AS swapped, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word)))::INTEGER AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.swapped = b.swapped AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.less = b.word),
b AS (SELECT word, count(*) AS n_near, min({{'minus': -other_n, 'other': other}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= {FACTOR} * v.n THEN best.other END AS form, CASE WHEN -best.minus >= {FACTOR} * v.n THEN -best.minus END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word"""
