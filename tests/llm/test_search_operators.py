"""The Jaccard join, toxicity, nearest neighbours, exact top-k and BPE against plain Python on small tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ann, bpe, jaccard, shingles, topk, toxicity
from quarry.llm.common import cut
from quarry.llm.components import components
from quarry.llm.vectors import usable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t", "one", "One two", "one TWO", "é É", "É é", "w " * 5000, "a b c", "A\nb\x0bc"]


def shingle_set(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(ids, texts, width, percent):
    sets, parent = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [(x, len(sets[i]), least[root(i)]) for i, x in enumerate(ids)]


def near_copies(rng, groups, size, words=60):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent,crowd", [(3, 90, 32), (5, 80, 32), (3, 90, 0), (5, 80, 0)])
def test_join_finds_every_link(spark, monkeypatch, width, percent, crowd):
    """With crowd 0 every open token is crowded, so links come from families."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(width)
    texts = near_copies(rng, 4, 18) + near_copies(rng, 12, 2, 12) + ODD + ["shared boilerplate line of nine words in many texts " + f"n{i} m{i}" for i in range(20)]
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame([(i, t, "extra") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, cid string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, width, percent).collect())
    assert got == brute(ids, texts, width, percent)


def test_join_of_nothing_and_null_ids(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "z"), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (6, 6), (None, 5)]


def test_one_direction_in_many_lengths():
    """More rows of one direction than the rescored part of the beam held; the smallest ids win the tie."""
    rng = np.random.default_rng(3)
    base = np.array([1.0, 2.0, 2.0, 4.0])
    vectors = [base * 2.0 ** (i % 90 - 45) for i in range(90)] + list(rng.normal(size=(200, 4)))
    ids = [*rng.permutation(90).tolist(), *range(1000, 1200)]

    class Chunk:
        value = (np.array([5000]), base[None])

    shard = pa.table({"vec_id": pa.array(ids, pa.int64()), "v": pa.array([list(v) for v in vectors], pa.list_(pa.float64())), "shard": pa.array([0] * len(ids), pa.int64())})
    graphs = ann._build_shard(5, 4, ann.DEGREE)(shard).to_batches()
    found = pa.Table.from_batches(list(ann._search_graphs(Chunk, 5, 4, ann.QUERY_BEAM, ann.DEGREE)(graphs)))
    assert found.column("vec_id").to_pylist() == [0, 1, 2, 3, 4]


def test_null_ids_take_part_in_links(spark):
    """A text that only rows with a null id have is a near copy of one document, and joins two others."""
    w = [f"w{i}" for i in range(60)]
    text = lambda a: " ".join([*(f"x{i}" for i in range(a)), *w[a:]])
    docs = [(None, text(4)), (None, text(4)), (8, text(0)), (9, text(8)), (None, "p q r s t u v w x y"), (None, "p q r s t u v w x y z"), (4, "none of these")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()), key=str)
    assert got == [(4, 4), (8, 8), (9, 8), (None, 8), (None, 8), (None, None), (None, None)]


def test_shingles_read_whole_texts():
    big = [f"t{i} " * (i * 700 + 1) for i in range(12)]
    offsets, _ = shingles.shingle_sets(pa.array(ODD + big), 3)
    assert np.diff(offsets).tolist() == [len(shingle_set(t, 3)) for t in ODD + big]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in [*range(1, 41), 100]}) == 1 and got[200] == got[201] != got[1]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms, rng = ["rotten", "beastly", "vile", "gro*"], random.Random(3)
    machine = toxicity.Automaton(terms, ["rotten", "beastly"])
    words = ["rotten", "roten", "rottten", "rattan", "rotte", "beastlyx", "vile", "vila", "gross", "gro", "grow", "xotten", "r", ""]
    words += ["".join(rng.choice("rotenbasly") for _ in range(rng.randint(4, 8))) for _ in range(3000)]
    for w in words:
        exact = next((t for t in ("rotten", "beastly", "vile") if w == t), None)
        near = [t for t in ("rotten", "beastly") if w[:1] == t[0] and edits(w, t) <= 1]
        stem = w.startswith("gro")
        got = machine.match(w)
        assert (got is not None) == bool(exact or near or stem), w
        if exact:
            assert got == (exact, 0)


def test_quotation_is_told_from_abuse():
    machine = toxicity.Automaton(["rotten"], ["rotten"])
    value = lambda t: toxicity.features(t, {"rotten": 5.0}, machine)
    assert value("you rotten person")[0] > 0 and value("you rotten person")[2] == 0
    assert value('the word "rotten" is old')[0] == 0 and value('the word "rotten" is old')[2] > 0
    assert value("she said rotten")[2] > 0
    assert value("you roten person")[1] > 0
    assert value("") == [0.0] * 5


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(40)] = rng.choice(["rotten", "beastly", "rottem"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (9999, "", "x")], "doc_id long, text string, score_ string")
    model = toxicity.learn(toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert "beastly" in model["lexicon"] and any("rotten".startswith(t.rstrip("*")) for t in model["lexicon"])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in truth]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[9999] == got[None]


def test_no_labels_no_lexicon(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.learn(toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.score(docs, model).first().score == pytest.approx(0.5)


# vectors


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string").drop("v")


@pytest.mark.parametrize("top", [1, 5, 20])
def test_top_products_equal_brute_force(spark, top):
    rng = np.random.default_rng(top)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 3, size=(300, 1))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)] + [(900, None, ""), (901, [1.0, None], ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] * 12, ""), (904, [], "")]
    ints = topk.integers(vector_table(spark, rows))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(ints, ints.filter("vec_id % 20 = 0"), top).collect()]
    whole = np.floor(64 * np.array([r[1] for r in rows[:300]], np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 300, 20):
        s = whole @ whole[q]
        order = [c for c in np.lexsort((np.arange(300), -s)) if c != q][:top]
        want += [(q, k + 1, int(c), int(s[c])) for k, c in enumerate(order)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [3e7, 2.0**40])
def test_large_products_are_exact(spark, size):
    """Beyond 2**53, and beyond 2**62 where what is left after cancelling fits a long."""
    rows = [(0, [size, 1.0], ""), (1, [size, 1 / 64], ""), (2, [size, 2 / 64], ""), (3, [-size, 3.0], ""), (20, [1.0, -5.0], "")]
    if size > 1e9:
        rows = [(0, [size, 1.0], ""), (1, [1 / 64, 7.0], ""), (2, [1 / 64, 6.0], ""), (3, [0.0, -3.0], "")]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string").drop("v"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_products(ints, ints.filter("vec_id = 0")).collect())
    whole = {i: [int(64 * x // 1) for x in v] for i, v, _ in rows}
    want = sorted(((sum(a * b for a, b in zip(whole[0], w, strict=True)), i) for i, w in whole.items() if i), key=lambda t: (-t[0], t[1]))
    assert got == [(k + 1, i, s) for k, (s, i) in enumerate(want)]


def test_scores_beyond_a_long_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    ints = topk.integers(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        topk.top_products(ints, ints).collect()


def test_repeated_ids_and_ties(spark):
    rows = vector_table(spark, [(0, [1.0, 0.0], ""), (0, [0.0, 1.0], ""), (1, [1.0, 1.0], ""), (2, [1.0, 1.0], ""), (2, [1.0, 1.0], ""), (None, [9.0, 9.0], "")])
    ints, near = topk.integers(rows), usable(rows)
    asked = [[(r["rank"], r.vec_id) for r in found.orderBy("rank").collect()] for found in (topk.top_products(ints, ints.filter("vec_id = 0")), ann.nearest(near, near.filter("vec_id = 0")))]
    assert asked == [[(1, 1), (2, 2), (3, 2)]] * 2


def test_many_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_CHUNK", 7)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 7)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(60, 4)), 3)
    rows = vector_table(spark, [(i, v.tolist(), "") for i, v in enumerate(x)])
    ints, near = topk.integers(rows), usable(rows)
    assert topk.top_products(ints, ints.filter("vec_id % 2 = 0"), 3).groupBy("query_id").count().filter("count = 3").count() == 30
    assert ann.nearest(near, near.filter("vec_id % 2 = 0"), 3).groupBy("query_id").count().filter("count = 3").count() == 30


def test_few_and_no_vectors(spark):
    two = topk.integers(vector_table(spark, [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], "")]))
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_products(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 2048)]
    none = topk.integers(vector_table(spark, []))
    assert topk.top_products(none, none).count() == 0
    assert ann.nearest(usable(vector_table(spark, [])), usable(vector_table(spark, []))).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:500] = x[200]
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)] + [(5000, [0.0] * 24, ""), (5050, None, "")]
    vectors = usable(vector_table(spark, rows))
    found = ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=400).collect()
    x = x.astype(float)
    length, hits, n = np.sqrt((x * x).sum(1)), 0, 0
    for q in range(0, 1500, 50):
        s = (x * x[q]).sum(1) / (length * length[q])
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and all(abs(c - s[v]) < 1e-12 for _, v, c in own)
        hits, n = hits + len(set(want) & {v for _, v, _ in own}), n + 5
    assert hits / n >= 0.9 and not any(r.query_id >= 5000 or r.vec_id >= 5000 for r in found)


@pytest.mark.parametrize("scale", [1e-320, 1e-200, 1.0, 1e200, 1e307])
def test_neighbours_of_any_magnitude(spark, scale):
    """Squares of the components would vanish or overflow; the answer is that of the vectors at scale one."""
    x = np.random.default_rng(9).integers(-9, 10, size=(80, 4)).astype(float)
    x[(x == 0).all(axis=1)] = 1
    rows = usable(spark.createDataFrame([(i, [float(c * scale) for c in v], "more") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(rows, rows.filter("vec_id % 40 = 0")).collect())
    cos = lambda a, b: float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
    for q in (0, 40):
        want = sorted((-round(cos(x[q], x[i]), 9), i) for i in range(80) if i != q)[:5]
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == [1, 2, 3, 4, 5] and all(abs(-w[0] - r[3]) < (1e-2 if scale < 1e-300 else 1e-8) for w, r in zip(want, own, strict=True))


def test_a_repeated_id_lies_in_many_shards(spark):
    x = np.random.default_rng(2).normal(size=(600, 6))
    rows = cut(usable(spark.createDataFrame([(7 if i % 2 else i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "rows")
    graphs = ann.build_graphs(rows, 5, 6, shard_rows=60)
    holds = sum(bool((np.frombuffer(r.ids, "<i8") == 7).any()) for r in graphs.select("ids").collect())
    assert holds == graphs.count() >= 8


def test_prune_keeps_diverse_edges():
    points = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]], np.float32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    kept = ann.robust_prune(points, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)[0]
    assert kept.tolist()[0] == 1 and 3 in kept and 2 not in kept


# BPE


def test_encoding_round_trip(spark):
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    encode = bpe.encoding(path).encode_ordinary
    rng = random.Random(6)
    odd = [chr(c) for c in (0, 9, 0x1C, 0x1F, 0x85, 0xA0, 0xB2, 0x2028, 0x3000, 0x1F600, 0xFEFF)]
    texts = ODD + ["don't STOP 123 ½ ²", "<|endoftext|>", "a" * 9000, *[f"x{c}y {c} {c}{c}  1{c}" for c in odd]]
    texts += ["".join(rng.choice("ab é9.,'\n ") for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["twice"] * 3
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encoded(docs, path).collect())
    assert got == sorted((i // 2, tuple(encode(t or ""))) for i, t in enumerate(texts))
    for _, ids in got[:40]:
        assert bpe.decode(ids, path).decode() in {t or "" for t in texts}
    n, a, b = bpe._digests(path)(np.array(encode("hello wörld"), np.uint32))
    assert (n, b) == (len(encode("hello wörld")), hashlib.sha256("hello wörld".encode()).hexdigest()) and a == hashlib.sha256(",".join(map(str, encode("hello wörld"))).encode()).hexdigest()


def test_encoding_of_nothing(spark):
    import public_tokenizers

    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path(bpe.VOCABULARY)).count() == 0


def test_the_commonest_pre_tokens_never_travel(spark):
    """Of the thousand commonest pre-tokens, punctuation and line breaks among them, none is left to the shuffle."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    split = bpe.splitter()
    counted = Counter(w for r in docs.collect() for w in split(r.text or ""))
    known, size = bpe.frequent_words(docs)
    assert size == sum(len((r.text or "").encode()) for r in docs.collect())
    common = [w for w, _ in counted.most_common(1000)]
    assert {".", ",", "\n"} & set(common) and not set(common) - set(known)
    few, _ = bpe.frequent_words(docs, 100)
    assert 50 < len(few) <= 100 and set(few) <= {w for w, _ in counted.most_common(130)}


def test_a_word_that_crowds_a_block_goes_to_many_tasks():
    hashes = np.array([5] * 40_000 + list(range(100, 40_100)), np.uint32)
    keys, places = np.arange(80_000, dtype=np.int64) * 7919, np.arange(80_000) % 3000
    targets = bpe.dealt(hashes, keys, places, 16)
    assert np.bincount(targets[:40_000], minlength=16).max() < 40_000 / 8
    assert (targets[40_000:] == hashes[40_000:] % 16).all()
    alone = bpe.dealt(hashes[:40_000], np.zeros(40_000, np.int64), np.arange(40_000), 16)
    assert np.bincount(alone, minlength=16).max() < 40_000 / 8


def test_words_that_escape_the_count_are_encoded_alike(spark):
    """No word at hand, few words at hand, and runs of white space that the count does not see."""
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    encode = bpe.encoding(path).encode_ordinary
    texts = ["a" + " " * k + "b\n\n  \tc" for k in range(40)] * 20 + ["x . y , z ." * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (0, 3, 1000):
        got = bpe.encode_documents(docs, lambda ids: (ids.tolist(),), [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))], path, hot).collect()
        assert sorted((r.doc_id, tuple(r.ids)) for r in got) == [(i, tuple(encode(t))) for i, t in enumerate(texts)]


def test_texts_are_split_once_for_words_and_skeletons(spark):
    """The words that travel and the skeletons come from one pass over the texts: its shuffle is written once and read twice."""
    import public_tokenizers

    docs = spark.createDataFrame([(i, f"some words {i} and zq{i}x") for i in range(40)], "doc_id long, text string")
    got = bpe.encoded(docs, public_tokenizers.path(bpe.VOCABULARY))
    assert len(got.collect()) == 40
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("MapInArrow") == 2


def test_joined_values():
    column = pa.array([b"", b"ab", b"c"], pa.large_binary())
    assert bytes(bpe.joined(column, np.array([2, 1, 0, 1], np.uint32))) == b"cabab"
    assert bytes(bpe.joined(column, (0,))) == bytes(bpe.joined(column, [])) == b""
    assert bytes(bpe.joined(bpe.decimals(12), [11, 0])) == b"11,0,"
