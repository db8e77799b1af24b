"""Toxicity scores from a learned lexicon, matched with misspellings.

Terms (words, and word beginnings that stand for a stem) are learned from labelled rows by a likelihood-ratio test against the
base rate. They form a trie; its intersection with the Levenshtein automaton of distance one is walked as a lazily built
automaton, so a word costs a few steps, and most words die after two or three letters. Every hit is judged in a window of the
words around it: inside quotation marks, or after a word that reports speech, it counts as quotation, else as abuse. A logistic
regression over hit counts gives the score. Scoring is one pass over the texts without a shuffle.

The lexicon and the regression are fitted on a bounded sample: the SAMPLE_ROWS labelled rows with the smallest hash of doc_id.
Nothing but that sample's ids, the lexicon and a few weights reaches the driver or a broadcast. The lexicon has all terms that the
evidence test admits; a term must stand in 0.2 % of the toxic rows of the sample, so there are at most 500 times as many as one
such row has on average, whatever the corpus.

Defined cases: null text counts as empty and gets the score of a text without hits; a text of any length is read as a whole;
without labelled rows of both kinds there is no lexicon and every score is the base rate, (toxic + 1) / (rows + 2) of the sample;
repeated rows and ties get equal scores; a null doc_id is held out; a doc_id labelled twice with both values is left out of the
fit; an empty table gives an empty result; extra columns are kept, whatever their names: where one is called score, the added
column gets underscores at its end.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, free_names, spend, table

#: WINDOW words around a hit are searched for quotation marks, REPORT_WINDOW words before it for a word that reports speech.
SAMPLE_ROWS, PREFIXES, MIN_FUZZY, WINDOW, REPORT_WINDOW = 20_000, (4, 5, 6), 5, 12, 6
WORD = re.compile(r"\w+")
LEET = str.maketrans("013457", "oieast")
#: Words that report speech, in the languages of the corpus.
REPORTS = {"said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "term", "word", "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "cité", "mot", "dijo", "escribió", "cita", "palabra"}
OPEN, CLOSE = "\"“„«‹‘", "\"”“»›’"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain(word: str) -> str:
    """A word that mixes letters and digits, with the digits read as letters."""
    return word.translate(LEET) if not word.isalpha() and not word.isdigit() else word


def terms_of(text: str) -> set[str]:
    """Distinct words, and beginnings of words written with a star."""
    found = {plain(w) for w in words_of(text)}
    return found | {w[:n] + "*" for w in found for n in PREFIXES if len(w) > n}


class Automaton:
    """The lexicon's trie times the Levenshtein automaton of distance one, built as it is walked.

    A state is a set of (trie node, edits so far); walking a letter matches, substitutes or inserts, and skipping a trie letter
    deletes. Only words of MIN_FUZZY letters or more, listed in fuzzy, admit an edit, and never in the first letter.
    """

    DEAD = frozenset()

    def __init__(self, terms, fuzzy=()):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.loose = [False]
        fuzzy = set(fuzzy)
        for term in sorted(terms):
            self.add(term, term in fuzzy)
        self.letters = {c for k in self.kids for c in k}
        self.steps: dict = {}
        self.start = frozenset({(0, 0)})
        self.found: dict[str, tuple[str, int] | None] = {}

    def add(self, term: str, loose: bool) -> None:
        at = 0
        self.loose[0] |= loose
        for c in term:
            at = self.kids[at].setdefault(c, len(self.kids))
            if at == len(self.ends):
                self.kids.append({})
                self.ends.append(None)
                self.loose.append(False)
            self.loose[at] |= loose
        self.ends[at] = term

    def step(self, state: frozenset, c: str) -> frozenset:
        key = (state, c if c in self.letters else "")
        if key in self.steps:
            return self.steps[key]
        out = set()
        for node, cost in state:
            kids = self.kids[node]
            if c in kids and (cost == 0 or self.loose[kids[c]]):
                out.add((kids[c], cost))
            if cost == 0 and node:
                if self.loose[node]:
                    out.add((node, 1))
                for k, to in kids.items():
                    if self.loose[to] and k != "*":
                        out.add((to, 1))
                        if c in self.kids[to]:
                            out.add((self.kids[to][c], 1))
        self.steps[key] = got = frozenset(out)
        return got

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term, or None."""
        state, best = self.start, None
        for c in word:
            state = self.step(state, c)
            if not state:
                return best
            for node, cost in state:
                star = self.kids[node].get("*")
                if star and cost == 0 and self.ends[star]:
                    best = best or (self.ends[star], 0)
        ends = [(cost, self.ends[node]) for node, cost in state if self.ends[node] and (cost == 0 or self.loose[node])]
        ends += [(1, self.ends[to]) for node, cost in state if cost == 0 and node for k, to in self.kids[node].items() if k != "*" and self.loose[to] and self.ends[to]]
        if best:
            ends.append((0, best[0]))
        return min(ends)[::-1] if ends else None

    def lookup(self, word: str):
        if word not in self.found:
            if len(self.found) > 100_000:
                self.found.clear()
            self.found[word] = self.match(plain(word))
        return self.found[word]


def surroundings(text: str, start: int, stop: int) -> tuple[str, str]:
    """The text with the WINDOW words before start, and with the WINDOW words behind stop, up to the next word."""
    reach, ends = 16 * WINDOW, []
    while True:
        low = max(0, start - reach)
        ends = [m.end() for m in WORD.finditer(text, low, start)]
        if low == 0 or len(ends) > WINDOW + 1:  # the first may be the rest of a word
            break
        reach *= 2
    before = text[ends[-WINDOW - 1] if len(ends) > WINDOW else 0 : start]
    begins = [m.start() for m in itertools.islice(WORD.finditer(text, stop), WINDOW + 1)]
    return before, text[stop : begins[WINDOW]] if len(begins) > WINDOW else text[stop:]


def quoted(text: str, start: int, stop: int) -> bool:
    """Whether the words around a hit make it a quotation: marks on both sides within the window, or a report before it."""
    before, after = surroundings(text, start, stop)
    opened = max((before.rfind(c) for c in OPEN), default=-1)
    closed = max((before.rfind(c) for c in CLOSE if c not in OPEN), default=-1)
    if opened > closed and "\n" not in before[opened:] and any(c in after.split("\n")[0] for c in CLOSE):
        if before[opened] != '"' or before.count('"') % 2:
            return True
    return any(w in REPORTS for w in WORD.findall(before)[-REPORT_WINDOW:])


def features(text: str, lexicon: dict[str, float], machine: Automaton) -> list[float]:
    """Counts by kind of hit: abuse, misspelt abuse, quotation, weight of the strongest abuse, abuse in a hundred words (10 stands for more)."""
    lower = text.lower()
    tokens = WORD.findall(lower)
    hits = {w: m for w in set(tokens) if (m := machine.lookup(w))}
    if not hits:
        return [0.0] * 5
    abuse = misspelt = cited = top = 0.0
    for m in WORD.finditer(lower):
        if hit := hits.get(m.group()):
            if quoted(lower, *m.span()):
                cited += 1
            else:
                abuse += 1
                misspelt += hit[1]
                top = max(top, lexicon[hit[0]] * (1 if not hit[1] else 0.5))
    return [math.log1p(abuse), math.log1p(misspelt), math.log1p(cited), top, min(10.0, 100 * abuse / len(tokens))]


def _term_counts(wanted: frozenset | None):
    def run(batches):
        toxic, rest = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                terms = terms_of(text.as_py() or "")
                (toxic if label.as_py() else rest).update(terms if wanted is None else terms & wanted)
        terms = list(toxic if wanted is None else toxic | rest)
        for i in range(0, len(terms), 100_000):
            part = terms[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([rest[t] for t in part], pa.int64())], names=["term", "toxic", "rest"])

    return run


def _hit_rows(lexicon, fuzzy):
    def run(batches):
        machine = Automaton(lexicon, fuzzy)
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                body = text.as_py() or ""
                near = {m[0] for w in set(words_of(body)) if (m := machine.lookup(w)) and m[1]}
                rows.append((label.as_py(), features(body, lexicon, machine), sorted(near)))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.list_(pa.string()))], names=["toxic", "x", "near"])

    return run


def evidence(tox: int, rest: int, n_tox: int, n_rest: int) -> float:
    """Log-likelihood ratio of a term's toxic share against the base rate; 0 where it speaks for the other side."""
    n, p = tox + rest, n_tox / (n_tox + n_rest)
    q = tox / n
    if q <= p:
        return 0.0
    return tox * math.log(q / p) + (rest * math.log((1 - q) / (1 - p)) if rest else 0.0)


def choose_terms(counts, n_tox: int, n_rest: int, tested: int) -> dict[str, float]:
    """Terms whose evidence outweighs the number of terms tested, with their smoothed log-odds; a term under a chosen beginning is left out."""
    need = math.log(max(tested, 2)) + 4
    odds = {}
    for term, tox, rest in counts:
        weight = math.log((tox + 0.5) / (n_tox + 1)) - math.log((rest + 0.5) / (n_rest + 1))
        if weight >= 2 and evidence(tox, rest, n_tox, n_rest) >= need:
            odds[term] = (weight, tox)
    chosen: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t.rstrip("*")), t)):
        stem = term.rstrip("*")
        over = [stem[:n] + "*" for n in PREFIXES if n < len(stem) or (n == len(stem) and not term.endswith("*"))]
        if not any(p in chosen for p in over):
            chosen[term] = odds[term][0]
    for term in [t for t in chosen if t.endswith("*")]:
        # a beginning that stands for one word only is that word
        words = [(odds[w][1], w) for w in odds if not w.endswith("*") and w.startswith(term[:-1])]
        if words and max(words)[0] >= 0.9 * odds[term][1]:
            word = max(words)[1]
            del chosen[term]
            chosen[word] = odds[word][0]
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60):
    """Ridge logistic regression by Newton's method; the intercept is not shrunk."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, pull = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of the sample: labelled rows outside the held-out fold, the first by hash."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select(F.col("doc_id").alias("__doc"), "toxic")
    ids = cut(ids.orderBy(F.xxhash64("__doc"), "__doc").limit(rows), "toxic-sample")
    out = cut(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__doc")).select("text", "toxic"), "toxic-rows")
    spend(ids)
    return out


def learn(sample: DataFrame) -> dict:
    """lexicon (term: log-odds), fuzzy (terms that admit an edit) and weights of the regression. sample: a written table of SAMPLE_ROWS or so."""
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_tox, n_rest = n.get(1, 0), n.get(0, 0)
    base = (n_tox + 1) / (n_tox + n_rest + 2)
    flat = {"lexicon": {}, "fuzzy": [], "weights": [math.log(base / (1 - base)), 0, 0, 0, 0, 0]}
    if not n_tox or not n_rest:
        return flat
    total = lambda df: df.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))
    form = "term string, toxic long, rest long"
    # a term must be in 0.2 % of the toxic rows at least, so there are at most 500 times as many as a row has
    seen = total(sample.filter("toxic = 1").mapInArrow(_term_counts(None), form)).filter(F.col("toxic") >= max(3, n_tox // 500))
    wanted = frozenset(r.term for r in seen.select("term").collect())
    counts = [(r.term, r.toxic, r.rest) for r in total(sample.mapInArrow(_term_counts(wanted), form)).collect()]
    lexicon = choose_terms(counts, n_tox, n_rest, len(wanted))
    fuzzy = [t for t in lexicon if not t.endswith("*") and len(t) >= MIN_FUZZY and t.isalpha()]
    kind = "toxic int, x array<double>, near array<string>"
    rows = sample.mapInArrow(_hit_rows(lexicon, fuzzy), kind).collect()
    near = {0: Counter(), 1: Counter()}
    for r in rows:
        near[r.toxic].update(r.near)
    # an edit stays allowed unless texts labelled 0 have it at least a tenth as often as texts labelled 1
    kept = [t for t in fuzzy if near[0][t] / n_rest <= 0.1 * max(near[1][t], 0.5) / n_tox]
    if len(kept) < len(fuzzy):
        rows = sample.mapInArrow(_hit_rows(lexicon, kept), kind).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    return {"lexicon": lexicon, "fuzzy": kept, "weights": fit_logistic(x, y).tolist()}


def _scores(shared, column: int, name: str):
    def run(batches):
        model = shared.value
        machine = Automaton(model["lexicon"], model["fuzzy"])
        bias, weights = model["weights"][0], model["weights"][1:]
        for batch in batches:
            z = [bias + sum(w * x for w, x in zip(weights, features(t.as_py() or "", model["lexicon"], machine), strict=True)) for t in batch.column(column)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score added (see score_name)."""
    # mapInArrow looks its columns up by name and takes a dot in one for a field of a struct
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    scored = plain.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), "score"), schema)
    return scored.toDF(*docs.columns, score_name(docs))


def score_name(docs: DataFrame) -> str:
    """What score() calls its column for these docs."""
    return free_names(docs, "score")[0]


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    out = score(docs, model).select("doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
