"""Best-fit packing of token sequences by bin completion.

A document's ids are cut into pieces of at most `capacity`; pieces are packed into sequences of that capacity. What matters
for packing is only how many pieces there are of each length, so the driver works on that histogram (at most `capacity`
rows, whatever the corpus): bin completion takes the largest length left, enumerates the undominated fillings around it,
and applies one as often as the counts allow, branching over good fillings first and pruning a branch whose waste
already rules out beating the incumbent. The incumbent starts as best-fit decreasing. The result is a list of patterns with
multiplicities, again bounded by the number of lengths; pieces find their place in it by their rank within their length,
which comes from counts of salted cells. No task sees all pieces of a length.

Defined cases: null text is empty, and an empty document is the one piece that holds the end mark; a very long text becomes as
many pieces as it fills; equal rows and rows that share a doc_id are packed each for itself; a null doc_id is carried along;
added tokens of the vocabulary inside a text are one id each; extra columns of docs are left out, extra columns of pieces are
kept, whatever their names but those of the two added columns; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.shard import places

CAPACITY, END = 1024, 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoding(path: str, vocabulary: str | None = None):
    """The ranks in a file as an encoder. With the JSON file of the same vocabulary, its added tokens are known as well."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(vocabulary) if vocabulary else {})


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, which stand for themselves wherever a text holds them."""
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that do not stand for themselves alone: {odd}")
    return {t["content"]: t["id"] for t in added}


def piece_spans(n: int, capacity: int):
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def _pieces(ranks: str, vocabulary: str, capacity: int, end: int):
    def run(batches):
        coder = encoding(ranks, vocabulary)
        names = coder.special_tokens_set

        def encode(text: str) -> list[int]:
            """Ids as the JSON file's reader gives them: added tokens inside a text are taken whole."""
            return coder.encode(text, allowed_special="all") if any(x in text for x in names) else coder.encode_ordinary(text)

        for batch in batches:
            rows, held = ([], [], [], [], []), 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for k, (start, n) in enumerate(piece_spans(len(ids), capacity)):
                    for out, x in zip(rows, (doc.as_py(), k, start, n, ids[start : start + n].tobytes()), strict=True):
                        out.append(x)
                held += ids.nbytes
                if held > 8 << 20:
                    yield _piece_batch(rows)
                    rows, held = ([], [], [], [], []), 0
            if rows[0]:
                yield _piece_batch(rows)

    return run


def _piece_batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document.

    vocabulary: a tokenizer's JSON file; ranks: the rank file of the same vocabulary, which is read several times as fast.
    """
    import public_tokenizers

    vocabulary, ranks = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(ranks, vocabulary, capacity, end), "doc_id long, piece int, start long, length long, ids binary")


def fits_into(items: tuple, bins: tuple) -> bool:
    """Whether items can be placed into bins of those sizes."""
    if not items:
        return True
    for i, b in enumerate(bins):
        if b >= items[0] and b not in bins[:i] and fits_into(items[1:], tuple(sorted((*bins[:i], *bins[i + 1 :], b - items[0]), reverse=True))):
            return True
    return False


def fillings(gap: int, left: np.ndarray, slack: int, width: int = 6, most: int = 4, work: list | None = None) -> list[tuple]:
    """Undominated sets of lengths that fill gap with a waste of at most slack, best first.

    One piece that fills the gap dominates all else. A filling is dominated by another into whose pieces it fits. Sets of up to
    `most` pieces are looked at, for each head the best rest; left: counts by length. work[0] grows by the tails looked at.
    """
    work = [0] if work is None else work
    if gap <= 0 or not left[1 : gap + 1].any():
        return [()]
    if left[gap]:
        return [(gap,)]
    sizes = np.flatnonzero(left[: gap + 1])[::-1]

    def best(room: int, used: tuple, depth: int) -> tuple:
        """The fullest tail no larger than the last piece used."""
        work[0] += 1
        cap = min(room, used[-1]) if used else room
        for x in range(cap, 0, -1):
            if left[x] > used.count(x):
                break
        else:
            return used
        if x == room or depth == 1:
            return (*used, x)
        found = (*used, x)
        pool = sizes[(sizes <= cap) & (sizes >= max(1, room // depth))]
        for y in (int(v) for v in pool[:24]):
            if left[y] <= used.count(y):
                continue
            got = best(room - y, (*used, y), depth - 1)
            if sum(got) > sum(found):
                found = got
            if sum(found) - sum(used) == room:
                break
        return found

    made = set()
    for x in (int(v) for v in sizes[:: max(1, len(sizes) // 48)]):
        got = best(gap - x, (x,), most - 1)
        made.add(got)
        if sum(got) == gap and len(made) >= width:
            break
    made.add(best(gap, (), most))
    ranked = sorted(made, key=lambda f: (gap - sum(f), len(f), tuple(-v for v in f)))
    kept: list[tuple] = []
    for f in ranked:
        if gap - sum(f) <= slack and not any(fits_into(f, k) for k in kept):
            kept.append(f)
        if len(kept) == width:
            break
    return kept


def all_fillings(gap: int, left: np.ndarray):
    """Every undominated filling of gap, one at a time, larger pieces first; None for each set that was looked at and is dominated.

    A filling is dominated if one more piece fits, or if a spare piece can stand for some of its pieces (two or more, or a smaller
    one) within the waste. There may be very many: the caller stops.
    """
    sizes = [int(x) for x in np.flatnonzero(left[: gap + 1])[::-1]]
    have, used = [int(left[x]) for x in sizes], [0] * len(sizes)
    spare = sum(1 << x for x in sizes)
    items: list[int] = []
    i = 0
    while True:
        while i < len(sizes) and gap:
            if sizes[i] <= gap and used[i] < have[i]:
                items.append(i)
                used[i] += 1
                gap -= sizes[i]
                if used[i] == have[i]:
                    spare ^= 1 << sizes[i]
            else:
                i += 1
        one = many = 0  # sums of one of the pieces, of two and more, as bits
        for k in items:
            many |= (many | one) << sizes[k]
            one |= 1 << sizes[k]
        larger = many
        for more in range(1, gap + 1):
            larger |= (1 | one | many) << more
        yield None if larger & spare else tuple(sizes[k] for k in items)
        if not items:
            return
        i = items.pop()
        if used[i] == have[i]:
            spare ^= 1 << sizes[i]
        used[i] -= 1
        gap += sizes[i]
        i += 1


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by total size, and by pieces over half with what cannot lie beside them."""
    n = np.arange(len(left))
    total = int((n * left).sum())
    most = -(-total // capacity)
    big = n > capacity // 2
    for k in range(1, capacity // 2 + 1):
        huge, middle, small = n > capacity - k, big & (n <= capacity - k), (n >= k) & ~big
        room = int(left[middle].sum()) * capacity - int((n * left)[middle].sum())
        most = max(most, int(left[huge].sum() + left[middle].sum()) + max(0, -(-(int((n * left)[small].sum()) - room) // capacity)))
    return most


def times_of(items: tuple, left: np.ndarray) -> int:
    return min(int(left[x]) // items.count(x) for x in set(items))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over the histogram: the largest piece, then again and again the largest that still fits."""
    left, out = counts.copy(), []
    while (some := np.flatnonzero(left)).size:
        items, room = (int(some[-1]),), capacity - int(some[-1])
        while room > 0:
            fit = next((x for x in range(room, 0, -1) if left[x] > items.count(x)), 0)
            if not fit:
                break
            items, room = (*items, fit), room - fit
        n = times_of(items, left)
        for x in items:
            left[x] -= n
        out.append((items, n))
    return out


def bins_of(patterns) -> int:
    return sum(n for _, n in patterns)


#: Tails that one search looks at before it ends with its next full packing, some 11 s of one thread.
WORK = 600_000


def complete_bins(counts: np.ndarray, capacity: int, nodes: int = 6000, weights=(1.1, 1.05, 1.15, 1.02, 1.3), most_work: int = WORK) -> list[tuple[tuple, int]]:
    """Patterns with multiplicities that place every piece: bin completion with branch and bound.

    Branches go depth first from the largest piece left; of the undominated fillings the one with the largest sum of powers comes
    first, which saves small pieces for gaps that need them. Each exponent in weights is one search with its share of nodes, and
    what one search finds is the next one's incumbent. A descent to a full packing takes about one node for each length, so each
    search gets two for each length besides its share. These searches branch over a few good fillings; a last one branches over all
    undominated ones. A filling is always applied as often as the counts allow. nodes and most_work (counted, so that
    results repeat) bound each search, never the result: when one runs out, the best packing so far stands.
    """
    counts = counts.astype(np.int64)
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    share = nodes // len(weights) + 2 * int(np.count_nonzero(counts))
    for weight in weights:
        if bins_of(best) <= bound:
            break
        best = _search(counts, capacity, best, bound, weight, share, most_work)
    return best if bins_of(best) <= bound else _search(counts, capacity, best, bound, weights[0], share, most_work, every=True)


def best_fit_filling(gap: int, left: np.ndarray) -> tuple:
    items: tuple = ()
    while gap > 0 and (x := next((x for x in range(gap, 0, -1) if left[x] > items.count(x)), 0)):
        items, gap = (*items, x), gap - x
    return items


def _search(counts, capacity: int, best, bound: int, weight: float, nodes: int, most_work: int, every: bool = False):
    """The best packing that a search with this weight finds within nodes and most_work, the last descent to its end; best is the incumbent.

    every: branch over all undominated fillings, after the good ones.
    """
    total = int((np.arange(len(counts)) * counts).sum())
    path: list[tuple[tuple, int]] = []
    spent, down, work = 0, True, [0]

    def expand(left, waste):
        large = int(np.flatnonzero(left)[-1])
        left[large] -= 1
        slack = (bins_of(best) - 1) * capacity - total - waste
        found = {*fillings(capacity - large, left, slack, most=3, work=work), best_fit_filling(capacity - large, left)}
        rest = all_fillings(capacity - large, left.copy()) if every else ()
        if large < capacity and left[capacity - large]:
            found, rest = {(capacity - large,)}, ()
        left[large] += 1
        good = sorted(((large, *f) for f in found), key=lambda f: -sum(x**weight for x in f))
        return itertools.chain(good, (None if f is None or f in found else (large, *f) for f in rest))

    first = counts.copy()
    stack = [(first, 0, expand(first, 0), 0)] if counts.any() else []
    while stack and (down or (spent < nodes and work[0] < most_work)):
        left, waste, options, depth = stack[-1]
        del path[depth:]
        down = False
        items = next(options, ())
        if items == ():
            stack.pop()
            continue
        spent += 1
        if items is None:
            continue
        n = times_of(items, left)
        lost = waste + n * (capacity - sum(items))
        if total + lost > (bins_of(best) - 1) * capacity:
            continue  # even without further waste this is no better than the incumbent
        rest = left.copy()
        for x in items:
            rest[x] -= n
        path.append((items, n))
        if not rest.any():
            best = list(path)
            if bins_of(best) <= bound:
                break
            continue
        stack.append((rest, lost, expand(rest, lost), depth + 1))
        down = True
    return best


def layout(patterns: list[tuple[tuple, int]]) -> list[tuple]:
    """(length, from rank, to rank, first sequence, pieces a sequence, first offset): where the pieces of a length go by their rank."""
    rows, used, sequence = [], {}, 0
    for items, n in patterns:
        offset = 0
        for x in sorted(set(items), reverse=True):
            k = items.count(x)
            at = used.get(x, 0)
            rows.append((x, at, at + n * k, sequence, k, offset))
            used[x], offset = at + n * k, offset + k * x
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 6000) -> DataFrame:
    """pieces (with length from 1 to capacity) with sequence_id and offset added. pieces is read twice: pass a written table."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    rows = layout(complete_bins(counts, capacity, nodes))
    grouped: dict[int, list] = {}
    for x, *rest in rows:
        grouped.setdefault(x, []).append(tuple(rest))
    plan = spark.createDataFrame(list(grouped.items()), "__length long, __slots array<struct<lo: long, hi: long, seq: long, per: long, off: long>>")
    salt = F.xxhash64("doc_id", "piece")
    order = [c for c, t in pieces.dtypes if not t.startswith(("array", "map", "struct"))]
    ranked = places(pieces, "length", salt, order, int(counts.sum()))
    slot = F.filter("__slots", lambda s: (s.lo <= F.col("__place")) & (F.col("__place") < s.hi))[0]
    placed = ranked.join(F.broadcast(plan), F.col("length") == F.col("__length")).withColumn("__slot", slot)
    nth = F.col("__place") - F.col("__slot.lo")
    return (
        placed.withColumn("sequence_id", F.col("__slot.seq") + F.floor(nth / F.col("__slot.per")))
        .withColumn("offset", F.col("__slot.off") + F.pmod(nth, F.col("__slot.per")) * F.col("length"))
        .drop("__length", "__slots", "__slot", "__place")
    )


def op1_best_fit_packing(spark, sf_dir):
    pieces = tokenized_pieces(table(spark, sf_dir, "documents"))
    heads = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(heads)
