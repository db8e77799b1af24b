"""Spelling variants, token files and Merkle manifests against plain Python on small tables, with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import merkle, spelling, token_files
from quarry.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
ALL = "doc_id long, source string, lang string, n_chars long, text string, word string, range int, block string, `group` int, at string, node string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "b", 2, "a", "n") for r in rows], ALL)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module, query", [(spelling, spelling.op11_spelling_variants), (merkle, merkle.op13_merkle_manifest)])
def test_equal_to_sql(spark, module, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(module.SQL)
    names = [c[0] for c in cursor.description]
    assert as_set(query(spark, SF).select(*names)) == sorted(cursor.fetchall(), key=repr)


# spelling


def plain_variants(rows, min_count, factor=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if v != w and near(v, w))
        form[w] = others[0][1] if others and -others[0][0] >= factor * n else None
        out.append((w, n, len(others)))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, k, words[form[w]] if form[w] else None) for w, n, k in out), key=repr)


@pytest.mark.parametrize("seed, block", [(0, 1 << 19), (1, 40), (2, 7)])
def test_variants_by_brute_force(spark, seed, block):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿ÷") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "bbbaaa", "bbbaab", "Straßenbahn", "strassenbahn", "x" * 300, "x" * 301]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "aaaaaa,aaaaaaÉ9aaaaab", ("aaaaab " * 70).upper(), "x" * 300 + "-" + "x" * 301, " ".join(["aaaaaa"] * 500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    docs = rows_of(spark, [(i, "s", "l", 1, t) for i, t in rows])
    counted = spelling.word_counts(docs, min_count=1)
    got = {r.word: r.n_near for r in spelling.near_words(counted, block).collect()}
    want = plain_variants(rows, 1)
    assert got == {w: k for w, _, _, _, k, _ in want if k}
    assert as_set(spelling.variants(docs, min_count=1)) == want and any(r[1] for r in want)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        lo, low = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        hi, high = lo + rng.integers(0, n + 1, 200), low + rng.integers(0, n + 1, 200)
        hi = np.minimum(hi, n)
        ask, value = spelling.WaveletTree(values).report(lo, hi, low, high)
        want = sorted((k, int(v)) for k in range(200) for v in values[lo[k] : hi[k]] if low[k] <= v < high[k])
        assert sorted(zip(ask.tolist(), value.tolist(), strict=True)) == want


def test_no_documents_no_words(spark):
    assert spelling.variants(rows_of(spark, [])).collect() == []


# token files


def tokens_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    return [np.array([*e.ids, 2], "<u4") for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("file_bytes, mapped", [(token_files.FILE_BYTES, True), (64, True), (500, False)])
def test_files_hold_what_the_tokenizer_gives(spark, file_bytes, mapped):
    texts = [None, "", "#", "# # 2", "word " * 3000, "é ß ﬀ x\x00", "<|endoftext|> in a<|endoftext|>b", "same", *[f"text {i} of many" for i in range(50)]]
    order = list(range(-3, len(texts) - 3))
    shuffled = list(zip(order, texts, strict=True))
    random.Random(5).shuffle(shuffled)
    docs = rows_of(spark, [(i, "s", "l", 1, t) for i, t in shuffled])
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, folder, file_bytes=file_bytes)
    got = token_files.read_tokens(spark, folder, lambda ids: (ids.tolist(),), "ids array<long>", mapped).orderBy("doc_id").collect()
    start = 0
    for r, i, ids in zip(got, order, tokens_of(texts), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids.tolist())
        start += len(ids)


def test_files_are_flat_and_in_order(spark):
    texts = ["b # b", "a", "c c c"]
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(rows_of(spark, [(i, "s", "l", 1, t) for i, t in enumerate(texts)]), folder, file_bytes=2)
    parts = lambda name: sorted(spark.read.format("binaryFile").load(f"{folder}/{name}").collect(), key=lambda r: r.block)
    assert b"".join(r.content for r in parts("ids")) == b"".join(x.astype("<u2").tobytes() for x in tokens_of(texts))
    assert [np.frombuffer(r.content, "<u8").tolist() for r in parts("offsets")] == [[0, 4], [4, 6], [6, 10]]


def test_rows_without_and_with_the_same_id(spark):
    texts = [(None, "none"), (7, "one"), (7, "one"), (7, "two"), (None, "nil nil"), (1, "x")]
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(rows_of(spark, [(i, "s", "l", 1, t) for i, t in texts]), folder)
    got = token_files.read_tokens(spark, folder, lambda ids: (ids.tolist(),), "ids array<long>").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 7, 7, 7]
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(x.tolist()) for x in tokens_of([t for _, t in texts]))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_no_documents_no_files(spark):
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(rows_of(spark, []), folder)
    assert token_files.read_tokens(spark, folder, token_files.digest, "ids_crc32 long").collect() == []


def test_marks_that_no_separator_can_spell():
    assert token_files.separator(2, np.dtype("<u2")) == "\x02\x00" and token_files.id_type(1 << 16).itemsize == 4
    with pytest.raises(ValueError):
        token_files.separator(50256, np.dtype("<u2"))


def test_block_refuses_files_of_two_blocks():
    with pytest.raises(ValueError):
        token_files.Block(np.zeros(3, "<u2").tobytes(), np.array([0, 4], "<u8").tobytes(), "<u2")


# manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, text: H(*map(spell, (*r[:4], text)))
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    first = lambda v: (v is not None, v if v is not None else 0)

    def tree(nodes):
        """Root, and for each node its (before, after) by level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, at in zip(paths, where, strict=True):
                run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                p.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            where = [at // 8 for at in where]
            nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], digest(r, r[4]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {lang: (sorted(groups[lang], key=lambda x: (first(x[0]), x[1]))) for lang in langs}
    trees = {lang: tree([x[1] for x in made[lang]]) for lang in langs}
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (doc, leaf, r), path in zip(made[lang], trees[lang][1], strict=True):
            node = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and r[4] is not None:
                node = digest(r, r[4].translate(lower))
            for before, after in path + top:
                node = H(before, node, after)
            out.append((doc, leaf, trees[lang][0], root, H(*(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1, None: 3}, {"en": 65, "de": 64, "": 8, None: 2, **{f"l{i}": 1 + i % 3 for i in range(9)}}])
def test_manifest_by_plain_python(spark, sizes):
    rng, rows, at = random.Random(1), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            at += rng.randint(1, 3)
            rows.append((at, rng.choice([None, "s", "é"]), lang, rng.choice([None, 5]), rng.choice([None, "", "Plain Text É", "lower", "X" * 5000])))
    rows += [rows[0], (rows[0][0], "other", *rows[0][2:]), (None, None, rows[0][2], None, "Upper")]
    rng.shuffle(rows)
    got = as_set(merkle.manifest(rows_of(spark, rows)))
    assert got == plain_manifest(rows)


def test_no_documents_no_manifest(spark):
    assert merkle.manifest(rows_of(spark, [])).collect() == []
