"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, kept for the next call."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word in order. Words are runs of anything but ASCII white space, with A-Z lower-cased; null has none."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, offsets, body = lower.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    before, after = bound[:-1].copy(), bound[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    begins, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = powers_of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[begins]) * down[begins]
    return np.searchsorted(offsets, begins, "right") - 1, mix(h ^ mix((ends - begins).astype(np.uint64)))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in row order, repeats included. A text of fewer words than width is one shingle."""
    n = len(texts)
    row, word = word_hashes(texts)
    count = np.bincount(row, minlength=n)
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    m = len(word) - width + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for j in range(width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ word[j : j + m])
        whole = row[:m] == row[width - 1 :]
        rows.append(row[:m][whole])
        hashes.append(h[whole])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.cumsum(count) - count
        for r in short:
            x = np.full(1, count[r], np.uint64)
            for w in word[begin[r] : begin[r] + count[r]]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ w)
            rows.append(np.full(1, r))
            hashes.append(x)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingles of text i are hashes[offsets[i] : offsets[i + 1]], ascending."""
    rows, hashes = shingles(texts, width)
    begin = np.searchsorted(rows, np.arange(len(texts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]), np.concatenate([np.zeros(0, np.uint64), *sets])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """A batch in parts whose texts hold about limit bytes, so that one part of long texts does not fill the memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held > limit:
            yield batch.take(pa.array(np.arange(begin, i + 1)))  # a copy: string kernels misread slices
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield batch.take(pa.array(np.arange(begin, len(sizes))))
