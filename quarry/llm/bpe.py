"""Byte-level BPE encoding and decoding with every distinct rare word encoded once.

Pre-tokens are split off with their positions. The most frequent ones (HOT of them, counted over all documents) are encoded
on the driver and their ids go to every task; all others are exploded with positions and shuffled by word, so that all
occurrences of a word meet in one task, which encodes it once. Ids travel back by document and are put into the document's
skeleton (the ranks of its frequent words, with holes) by position. Decoding looks ids up in the token-byte table.

Rare words and skeletons come from one split of each text and leave in one shuffle, which is read twice: for the words, and for the
skeletons once the words have ids.

Rare words travel in packed columns (a row for each target task and batch, not for each word), and a skeleton as a compressed
stream, which keeps the shuffle below the size of the input. A frequent word never travels. Which words are frequent is counted on
pre-tokens between single spaces, punctuation included; should a word escape that count (long runs of white space, say) and still
make up more than 1 / SALTED of the words that one block of text sends, its occurrences there are dealt to all tasks by document and place, so
that no task is hot whatever the counts say.

Defined cases: null or empty text has no ids; a very long text is encoded as a whole; equal rows, and rows that share a doc_id, are encoded each for itself; a null
doc_id is carried along; a word of any length is one word; extra columns are kept out of the result.
"""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, spend, table
from quarry.llm.pack import encoding
from quarry.llm.shingles import slices

HOT, TASK_HOT, BLOCK_BYTES, BUCKET_BYTES, SALTED = 1 << 18, 1 << 17, 8 << 20, 32 << 20, 256
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: Letters up to U+02C1, and the characters up to there that the standard library's patterns read like the tokenizer's.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1"
SIMPLE = "\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u02c1"


@functools.lru_cache(maxsize=1)
def splitter():
    """The pre-tokens of a text. A text of simple characters takes a pattern of explicit classes, which is more than twice as fast."""
    import public_tokenizers
    import regex

    full = regex.compile(public_tokenizers.PATTERN).findall
    spelled = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
    fast, odd = re.compile(spelled).findall, re.compile(f"[^{SIMPLE}]").search
    return lambda text: full(text) if odd(text) else fast(text)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * (max(pairs)[0] + 1)
    for i, b in pairs:
        out[i] = b
    return out


def piece_encoder(path: str):
    """Ids of one pre-token, given as bytes."""
    return encoding(path)._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=2)
def byte_column(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.large_binary())


@functools.lru_cache(maxsize=2)
def decimals(n: int) -> pa.Array:
    """Each id in decimal, with a comma."""
    return pa.array([f"{i}," for i in range(n)], pa.large_string())


def joined(column: pa.Array, ids) -> memoryview:
    """The bytes of the column's values at ids, one after the other."""
    if not len(ids):
        return memoryview(b"")
    _, ends, data = column.take(pa.array(np.asarray(ids, np.uint32))).buffers()
    return memoryview(b"" if data is None else data)[: np.frombuffer(ends, np.int64)[len(ids)]]


def _frequent(batches):
    """Pre-tokens and how often they occur, counted on the distinct strings between single spaces, each split once for a block of text.

    A pre-token takes one space at most, before it, so the count is exact but for runs of white space and for what a text begins
    with. It decides over speed, never over ids. The row without a word counts bytes.
    """
    find = splitter()
    total: dict[str, int] = collections.defaultdict(int)
    size = 0
    for batch in batches:
        for part in slices(batch, "text", 2 * BLOCK_BYTES):
            text = pc.fill_null(part.column("text"), "")
            size += pc.sum(pc.binary_length(text)).as_py() or 0
            strings, counts = pc.split_pattern(text, pattern=" ").flatten().value_counts().flatten()
            single = pc.ascii_is_alpha(strings)  # letters alone are one pre-token with the space before them
            for w, k in zip(strings.filter(single).to_pylist(), counts.filter(single).to_pylist(), strict=True):
                total[" " + w] += k
            for string, k in zip(strings.filter(pc.invert(single)).to_pylist(), counts.filter(pc.invert(single)).to_pylist(), strict=True):
                for w in find(" " + string):
                    total[w] += k
    top = sorted(total.items(), key=lambda x: -x[1])[:TASK_HOT]
    yield pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in top)], pa.string()), pa.array([size, *(k for _, k in top)], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, hot: int = HOT) -> tuple[list[str], int]:
    """At most hot pre-tokens, most frequent first, so that skeletons hold small ranks; and the bytes of all texts.

    A histogram of the counts, in steps of a 32nd of an octave, says from which count on there are no more than hot words; only these
    come to the driver.
    """
    counts = cut(docs.select("text").mapInArrow(_frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    size = counts.filter("word is null").first()
    words = counts.filter("word is not null and n > 1").withColumn("step", F.floor(F.log2("n") * 32))
    room, least = hot, None
    for r in words.groupBy("step").agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():  # 2,048 rows at most
        room -= r.k
        if room < 0:
            break
        least = r.step
    kept = [] if least is None else [(-r.n, r.word) for r in words.filter(F.col("step") >= least).select("word", "n").collect()]
    spend(counts)
    return [w for _, w in sorted(kept)], size.n if size else 0


def pack_planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_planes(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def row_key(doc, text: bytes) -> int:
    """A name for a row by what it holds; equal rows share it, and their ids."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{doc}/".encode() + text) - (1 << 63)


#: A packet of words or ids by key: the distinct keys, how many entries each has, the entries' places and sizes, and their bytes one after the other.
PACKET = "target int, sizes binary, keys binary, runs binary, places binary, data binary"


def packets(targets: np.ndarray, parts: int, entries: list[bytes], keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Entries dealt out to their targets, a row for each target that has any."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    order = np.lexsort((places, keys, targets))
    begin = np.searchsorted(targets[order], np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(begin)):
        own = order[begin[p] : begin[p + 1]]
        mine = [entries[i] for i in own.tolist()]
        distinct, runs = np.unique(keys[own], return_counts=True)
        rows.append((int(p), pack_planes(np.fromiter(map(len, mine), np.uint32, len(mine))), distinct.astype("<i8").tobytes(), pack_planes(runs), pack_planes(places[own]), pack(b"".join(mine))))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["target", "sizes", "keys", "runs", "places", "data"])


def opened(batch_or_table):
    """(sizes, keys, places, data) of each packet."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for sizes, keys, runs, places, data in zip(*(batch_or_table.column(c) for c in ("sizes", "keys", "runs", "places", "data")), strict=True):
        yield unpack_planes(sizes.as_py()), np.repeat(np.frombuffer(keys.as_py(), "<i8"), unpack_planes(runs.as_py())), unpack_planes(places.as_py()), unpack(data.as_py())


def dealt(hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, parts: int) -> np.ndarray:
    """The target of each word by its hash; a word with more than 1 / SALTED of all entries goes to many targets, by document and place."""
    _, word, count = np.unique(hashes, return_inverse=True, return_counts=True)
    crowded = (count > max(SALTED, len(hashes) // SALTED))[word]
    salt = np.where(crowded, ((keys >> 7) + (places >> 10)) & 0xFFFF, 0).astype(np.uint64)
    return ((hashes.astype(np.uint64) + salt) % np.uint64(parts)).astype(np.int64)


#: What one split of a text leaves behind: skeletons (with doc_id and key) or packets, the other columns being null.
SPLIT = PACKET + ", doc_id long, key long, skeleton binary"
COLUMNS = [x.split()[0] for x in SPLIT.split(", ")]


def of_kind(batch_or_table, column: str):
    """The rows that have a value in the column."""
    return batch_or_table.filter(pc.is_valid(batch_or_table.column(column)))


def _split(hot, parts: int):
    """For each row of the documents its skeleton, the frequent words by rank (rare ones have the number of frequent ones), by the row's key; and packets of the
    rare words, by the hash of the word; the hash of a word that crowds its block is salted."""

    def filled(known: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known[c] if c in known else pa.nulls(n, pa.int64() if c in ("doc_id", "key") else pa.binary()) for c in COLUMNS], names=COLUMNS)

    def run(batches):
        import xxhash

        find, known, hashed = splitter(), hot.value[0], xxhash.xxh32_intdigest
        hole = len(known)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                docs, keys, rows, words, places = part.column("doc_id"), [], [], [], []
                for doc, cell in zip(docs.to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = cell or ""
                    keys.append(row_key(doc, text.encode()))
                    found = find(text)
                    ranks = np.fromiter(map(known.get, found, itertools.repeat(hole)), np.uint32, len(found))
                    rows.append(pack_planes(ranks))
                    rare = np.flatnonzero(ranks == hole)
                    words += [found[i].encode() for i in rare.tolist()]
                    places.append(len(rare))
                k = np.array(keys, np.int64)
                yield filled({"target": pa.array((k % parts).astype(np.int32)), "doc_id": docs, "key": pa.array(k), "skeleton": pa.array(rows, pa.binary())}, len(k))
                if words:
                    many = np.array(places)
                    key, place = np.repeat(k, many), np.arange(len(words)) - np.repeat(np.cumsum(many) - many, many)
                    sent = packets(dealt(np.fromiter(map(hashed, words), np.uint32, len(words)), key, place, parts), parts, words, key, place)
                    yield filled({c: sent.column(c) for c in sent.schema.names}, sent.num_rows)

    return run


def _encode(path: str, buckets: int):
    """Packets of ids by document bucket. A task has all occurrences of its words, and encodes each word once."""

    def run(batches):
        encode, known = piece_encoder(path), {}

        def ids_of(word: bytes) -> bytes:
            got = known.get(word)
            if got is None:
                got = known[word] = array("I", encode(word)).tobytes()
            return got

        entries, keys, places = [], [], []
        for batch in batches:
            for sizes, key, place, data in opened(of_kind(batch, "sizes")):
                ends = np.cumsum(sizes).tolist()
                entries += [ids_of(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                keys.append(key)
                places.append(place)
                if len(entries) > 1_000_000:
                    k = np.concatenate(keys)
                    yield packets(k % buckets, buckets, entries, k, np.concatenate(places))
                    entries, keys, places = [], [], []
        if entries:
            k = np.concatenate(keys)
            yield packets(k % buckets, buckets, entries, k, np.concatenate(places))

    return run


def gather(begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + size[i]] for all i, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - (ends - size), size)]


def _assemble(hot, finish, names):
    """Ids of each row of a bucket, in order: frequent words by rank, rare ones from the packets by key and place."""

    def run(left: pa.Table, found: pa.Table) -> pa.Table:
        skeletons = of_kind(left, "skeleton")
        _, hot_size, hot_ids = hot.value
        sizes, keys, places, data = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
        for s, k, p, d in opened(found):
            for to, x in zip((sizes, keys, places, data), (s, k, p, d), strict=True):
                to.append(x)
        size, key, place = (np.concatenate(x) for x in (sizes, keys, places))
        rare_ids = np.frombuffer(b"".join(data), "<u4")
        size = size.astype(np.int64) // 4
        begin = np.cumsum(size) - size
        order = np.lexsort((place, key))
        key, place, size, begin = key[order], place[order], size[order], begin[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])  # equal rows bring equal entries
        key, size, begin = key[first], size[first], begin[first]
        all_size = np.concatenate([hot_size, size])
        all_begin = np.concatenate([np.cumsum(hot_size) - hot_size, begin + len(hot_ids)])
        flat = np.concatenate([hot_ids, rare_ids])
        out = []
        for doc, k, cell in zip(*(skeletons.column(c).to_pylist() for c in ("doc_id", "key", "skeleton")), strict=True):
            words = unpack_planes(cell).astype(np.int64)
            holes = np.flatnonzero(words == len(hot_size))
            words[holes] = len(hot_size) + np.searchsorted(key, k) + np.arange(len(holes))
            out.append((doc, *finish(gather(all_begin[words], all_size[words], flat))))
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, names, strict=True)], names=[n for n, _ in names])

    return run


def encode_documents(docs: DataFrame, finish, names: list, vocabulary: str, hot: int = HOT) -> DataFrame:
    """A row for each row of docs: doc_id and what finish(ids: array of unsigned 32-bit) returns. names: (name, Arrow type) of all columns.

    Ids can be the result themselves (see encoded) or be digested where they are made.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    words, size = frequent_words(docs, hot)
    encode = piece_encoder(vocabulary)
    ids = [encode(w.encode()) for w in words]
    table_of = ({w: i for i, w in enumerate(words)}, np.array([len(x) for x in ids], np.int64), np.array([t for x in ids for t in x], "<u4"))
    at_hand = spark.sparkContext.broadcast(table_of)  # at most hot words
    parts = max(8, -(-size // BUCKET_BYTES))
    split = docs.mapInArrow(_split(at_hand, parts), SPLIT).repartition(parts, "target")  # both sides below read this shuffle; a filter here would part it in two
    found = split.mapInArrow(_encode(vocabulary, parts), PACKET).repartition(parts, "target")
    schema = ", ".join(f"{n} {_spark_type(t)}" for n, t in names)
    return split.groupBy("target").cogroup(found.groupBy("target")).applyInArrow(_assemble(at_hand, finish, names), schema)


def _spark_type(t) -> str:
    return "array<long>" if pa.types.is_list(t) else {"int64": "long", "string": "string"}[str(t)]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids of every document."""
    return encode_documents(docs, lambda ids: (ids.astype(np.int64),), [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))], vocabulary)


def decode(ids, path: str) -> bytes:
    """Bytes of ids by the token-byte table."""
    return bytes(joined(byte_column(path), ids))


def _digests(path: str):
    def finish(ids: np.ndarray):
        text = joined(decimals(len(byte_column(path))), ids)[:-1]
        return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(joined(byte_column(path), ids)).hexdigest()

    return finish


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    names = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return encode_documents(table(spark, sf_dir, "documents"), _digests(path), names, path)
