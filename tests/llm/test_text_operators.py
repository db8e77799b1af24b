"""Packing, line dedup, WARC, sharding and chunk dedup against plain Python on small tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import chunk_dedup, line_dedup, pack, shard, warc

DOCS = "doc_id long, text string, source string, __lines string, length int"


def table(spark, texts):
    """Documents with extra columns, two of them named like working columns."""
    return spark.createDataFrame([(i, t, "s", "x", 7) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "a", "A\nb \nB", "word " * 3000, "é ß ﬀ x", "same text here", "same text here", "\x00nul", "<|endoftext|> inside", "a<|endoftext|><|endoftext|>b <|endoftext |>"]


# packing


def first_fit_free_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_whole_and_few(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 120))]
    counts = np.bincount(lengths, minlength=61)
    patterns = pack.complete_bins(counts, 60, nodes=400)
    used = Counter()
    for items, n in patterns:
        assert sum(items) <= 60
        for x in items:
            used[x] += n
    assert used == Counter(lengths)
    bins = pack.bins_of(patterns)
    assert first_fit_free_bound(lengths, 60) <= pack.lower_bound(counts, 60) <= bins <= pack.bins_of(pack.best_fit(counts, 60))


def brute_bins(lengths, capacity):
    """The least number of bins, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(10))
def test_bins_equal_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(3, 19) for _ in range(11)]
    counts = np.bincount(lengths, minlength=21)
    assert pack.bins_of(pack.complete_bins(counts, 20, nodes=20_000)) == brute_bins(lengths, 20)


def test_searches_complete_with_all_lengths_and_large_counts():
    """Searches of 1,200 nodes end before a descent does: 26,422,945 sequences."""
    counts = np.r_[0, np.random.default_rng(0).integers(500, 100_000, 1024)]
    patterns = pack.complete_bins(counts, 1024)
    used = np.zeros(1025, np.int64)
    for items, n in patterns:
        assert sum(items) <= 1024
        for x in items:
            used[x] += n
    assert (used == counts).all() and len(patterns) > 1000
    assert pack.lower_bound(counts, 1024) <= pack.bins_of(patterns) < 26_422_000


def test_fillings_of_many_small_pieces():
    """The optimum needs a filling that the good ones leave out."""
    for capacity, lengths in ((30, [2, 2, 4, 4, 5, 5, 5, 6, 6, 7, 7, 7, 12, 18]), (49, [3, 6, 7, 8, 9, 10, 10, 12, 12, 16, 19, 35])):
        counts = np.bincount(lengths, minlength=capacity + 1)
        assert pack.bins_of(pack.complete_bins(counts, capacity, nodes=3000)) == brute_bins(lengths, capacity) == 3


def test_all_fillings_are_the_undominated_ones():
    for seed in range(40):
        rng = random.Random(seed)
        lengths, gap = [rng.randint(1, 12) for _ in range(7)], rng.randint(3, 20)
        sets = {tuple(sorted((x for k, x in enumerate(lengths) if m >> k & 1), reverse=True)) for m in range(1 << 7)}
        sets = {f for f in sets if sum(f) <= gap}
        got = [f for f in pack.all_fillings(gap, np.bincount(lengths, minlength=gap + 1)) if f is not None]
        assert len(got) == len(set(got)) and set(got) <= sets
        assert all(any(pack.fits_into(f, g) for g in got) for f in sets)
        if len(set(lengths)) == len(lengths):
            assert not any(f != g and pack.fits_into(f, g) for f in got for g in sets)


def test_pieces_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack.pack(pack.tokenized_pieces(table(spark, ODD))).collect()
    ids = defaultdict(dict)
    for r in rows:
        ids[r.doc_id][r.piece] = (r.start, np.frombuffer(r.ids, "<u4").tolist())
        assert r.length == len(r.ids) // 4 and 1 <= r.length <= 1024
    for i, text in enumerate(ODD):
        got = [x for k in sorted(ids[i]) for x in ids[i][k][1]]
        assert got == [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        starts, at = [ids[i][k][0] for k in sorted(ids[i])], 0
        for k in sorted(ids[i]):
            assert starts[k] == at
            at += len(ids[i][k][1])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_equal_rows_and_no_rows(spark):
    rows = pack.pack(pack.tokenized_pieces(spark.createDataFrame([(1, "x")] * 5 + [(None, "y")], "doc_id long, text string"))).collect()
    assert len(rows) == 6 and sorted((r.sequence_id, r.offset) for r in rows) == [(0, 2 * k) for k in range(6)]
    assert pack.pack(pack.tokenized_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# line dedup


def test_lines_against_python(spark):
    rng = random.Random(1)
    pool = ["Common Line", " common line\t", "rare", "", "ÄB", "äB", "x" * 40]
    texts = ODD + ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {r.doc_id: r for r in line_dedup.drop_common_lines(table(spark, texts), min_docs=4).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < 4]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert out[i].length == 7 and out[i].source == "s"


def test_lines_of_nothing(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    null = line_dedup.drop_common_lines(spark.createDataFrame([(None, "a\nb")] * 10, "doc_id long, text string")).collect()
    assert {r.n_dropped for r in null} == {2}


def test_rows_are_documents_whatever_their_ids(spark):
    """Repeated rows, and rows that share an id, each count; names of working and added columns are free."""
    rows = [(1, "x\ny", 0.3, 5)] * 4 + [(1, "y\nz", 0.3, 5)] * 6 + [(2, "x\nq", 0.3, 5)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text double, N_Lines int")
    assert line_dedup.added_names(docs) == ["kept_text_", "n_lines_", "n_dropped"]
    out = line_dedup.drop_common_lines(docs, min_docs=9).collect()
    assert Counter(r.kept_text_ for r in out) == Counter({"": 4, "z": 6, "q": 5})
    assert {(r.kept_text, r.N_Lines) for r in out} == {(0.3, 5)}


# WARC


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "body"), (2, "http://a/2", "body"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5", "x\r\n\r\nWARC/1.1\r\nü"), (6, "http://a b/6", "body"), (7, None, "y" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=140_000)
    raw = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {i: raw[i].payload for i in (4, 5, 6, 7)} == {4: "", 5: pages[4][2], 6: "body", 7: "y" * 100_000}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved_heads(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    for i, _, html in pages:
        body = (html or "").encode()
        top = max(p for p, _, h in pages if (h or "") == (html or ""))
        assert got[i] == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)


def test_archives_small_payloads_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "v", "abcd")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), min_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.resolved_heads(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# sharding


def brute_capacity(sizes, shards):
    """Least capacity for ordered groups by trying the sums that can be one."""
    for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                break
            if held + s > c:
                n, held = n + 1, 0
            held += s
        else:
            if n <= shards:
                return c


@pytest.mark.parametrize("seed,shards", [(0, 3), (1, 5), (2, 7), (3, 40)])
def test_shards_have_the_least_maximum(spark, seed, shards):
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.1 else "t" * rng.randint(0, 9) + str(rng.randint(0, 30)) for _ in range(90)] + ODD
    rows = shard.shard_documents(table(spark, texts), shards).collect()
    groups, totals, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id]
        assert r["size"] == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())
        groups[text].add(r.shard)
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in groups.values()) and len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keyed = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("case when text is null then 0 else xxhash64(text) end k", "coalesce(octet_length(text), 0) + 16 s").groupBy("k").sum("s").orderBy("k").collect()
    assert max(totals.values()) == brute_capacity([r[1] for r in keyed], shards)


def test_shards_of_nothing(spark):
    assert shard.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# chunk dedup


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_passages_are_caught_and_clean_texts_left(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(30, 300)) for _ in range(40)]
    holders = [3, 11, 12, 30]
    for i in holders:
        at = rng.randint(0, len(texts[i]))
        at = texts[i].find(" ", at) + 1
        texts[i] = texts[i][:at] + passage + " " + texts[i][at:]
    docs = table(spark, texts + ODD)
    spans = chunk_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == set(holders)
    dropped = Counter()
    for r in spans:
        dropped[r.doc_id] += (r.stop - r.start) * (not r.kept)
    assert dropped[3] == 0 and all(dropped[i] > 0.6 * len(passage) for i in holders[1:])
    after = {r.doc_id: r.text for r in chunk_dedup.drop_repeats(docs).collect()}
    for i, t in enumerate(texts + ODD):
        if i in holders[1:]:
            assert len(after[i]) < len(t) - 0.6 * len(passage)
        else:
            assert after[i] == t


def brute_spans(rows, radius=16, least=128):
    """(doc_id, start, stop, keeper, kept) of repeated spans by the definition, one byte at a time."""
    gear = [int(x) for x in chunk_dedup.GEAR]

    def chunks_of(text):
        body = text.replace("\0", " ").encode()
        data = bytes(48) + body + bytes(48)
        score = [0xFFFFFFFF] * len(data)
        for p in range(1, len(data)):
            if data[p] == 0 or data[p] & 0xC0 == 0x80:
                continue
            h = sum(gear[data[p - 1 - j]] << j for j in range(16) if p - 1 - j >= 0) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            h ^= h >> 12
            space = lambda c: c == 32 or 9 <= c <= 13
            score[p] = h >> 1 | (0 if space(data[p - 1]) and not space(data[p]) else 1 << 31)
        cuts = [p for p in range(radius, len(data) - radius) if score[p] != 0xFFFFFFFF and score[p] < min(score[p - radius : p]) and score[p] <= min(score[p + 1 : p + radius + 1])]
        edges = sorted({48, 48 + len(body), *(p for p in cuts if 48 <= p <= 48 + len(body))})
        return [(a - 48, b - 48, data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    cut, holders = {}, defaultdict(set)
    for doc, text in set(rows):
        if doc is not None and text:
            cut[doc, text] = chunks_of(text)
            for _, _, c in cut[doc, text]:
                holders[c].add(doc)
    out = []
    for (doc, _), own in cut.items():
        runs = [[]]
        for a, b, c in own:
            if len(holders[c]) > 1:
                if runs[-1] and runs[-1][-1][1] != a:
                    runs.append([])
                runs[-1].append((a, b, min(holders[c])))
        for run in runs:
            if run and run[-1][1] - run[0][0] >= least:
                part = []
                for a, b, keeper in [*run, (None, None, None)]:
                    if part and (a is None or (keeper == doc) != (part[-1][2] == doc)):
                        out.append((doc, part[0][0], part[-1][1], part[0][2], part[0][2] == doc))
                        part = []
                    part.append((a, b, keeper))
    return sorted(out)


def test_spans_equal_brute_force(spark):
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (20, 45, 80)] + ["é ß " * 60, "a" * 400]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i // 2, None]) if i % 7 == 0 else i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(rows[3][0], rows[3][1]), (200, rows[5][1]), (201, None), (202, "")]
    got = sorted(tuple(r) for r in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "start", "stop", "keeper", "kept").collect())
    assert len(got) > 20 and got == brute_spans(rows)


def test_long_texts_are_cut_alike_in_windows():
    data = np.frombuffer((prose(random.Random(3), 3000) + "\0" * 60 + "b" * 500).encode(), np.uint8)
    whole = chunk_dedup.cut_places(data, 16)
    assert len(whole) > 300 and all((chunk_dedup.cut_places(data, 16, step) == whole).all() for step in (101, 1000))
    a, b = whole[:-1], whole[1:]
    names = chunk_dedup.digests(data, a, b)
    assert len(set(names.tolist())) == len({data[i:j].tobytes() for i, j in zip(a, b, strict=True)})
    twice = np.concatenate([data, data])
    assert (chunk_dedup.digests(twice, a + len(data), b + len(data)) == names).all()


def test_columns_called_like_working_ones_stay(spark):
    t = prose(random.Random(6), 100)
    docs = spark.createDataFrame([(1, t, 0.5, "k"), (2, t, 0.6, "l")], "doc_id long, text string, __doc double, __Gone string")
    got = sorted(tuple(r) for r in chunk_dedup.drop_repeats(docs).collect())
    assert got == [(1, t, 0.5, "k"), (2, "", 0.6, "l")]


def test_insertions_do_not_shift_cuts(spark):
    rng = random.Random(9)
    base = prose(rng, 400)
    docs = spark.createDataFrame([(1, base), (2, "new words in front " + base)], "doc_id long, text string")
    lost = len(base) - len(chunk_dedup.drop_repeats(docs).filter("doc_id = 2").first().text)
    assert lost > 0.9 * len(base) - 40


def test_copies_repeats_and_nothing(spark):
    rng = random.Random(2)
    t = prose(rng, 200)
    docs = spark.createDataFrame([(1, t), (2, t), (None, t), (4, "tiny"), (5, "tiny")], "doc_id long, text string")
    after = {r.doc_id: r.text for r in chunk_dedup.drop_repeats(docs).collect()}
    assert after == {1: t, 2: "", None: t, 4: "tiny", 5: "tiny"}
    assert chunk_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(7, t), (7, t)], "doc_id long, text string")
    assert chunk_dedup.repeated_spans(twice).count() == 0


def test_texts_under_one_id_keep_their_own_offsets(spark):
    rng = random.Random(4)
    passage, one, two = prose(rng, 120), prose(rng, 300), prose(rng, 300)
    docs = spark.createDataFrame([(1, passage), (7, passage + " " + one), (7, two)], "doc_id long, text string")
    after = [r.text for r in chunk_dedup.drop_repeats(docs).collect()]
    assert two in after and passage in after and len(after) == 3
    cleaned = next(t for t in after if t not in (two, passage))
    assert len(cleaned) < len(one) + 60 and cleaned.endswith(one[60:])
    spans = [r for r in chunk_dedup.repeated_spans(docs).collect() if r.doc_id == 7]
    assert len(spans) == 1 and spans[0].start == 0 and not spans[0].kept


def test_gear_hash_rolls():
    data = np.frombuffer(b"the quick brown fox jumps over", np.uint8)
    h = chunk_dedup.gear_hashes(data)
    i = 25
    want = sum(int(chunk_dedup.GEAR[data[i - j]]) << j for j in range(chunk_dedup.WINDOW)) & 0xFFFFFFFF
    assert int(h[i]) == want
