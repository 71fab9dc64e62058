"""Hashes of the words of a whole Arrow batch, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["p"]) < n:
        size = max(n, WINDOW + 1)
        for name, base in (("p", _P), ("i", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["p"], _tables["i"]


def buffers(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows (one more than rows); null reads as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def pieces(batches, column: int, size: int = 1 << 20):
    """The batches cut into slices of at most about ``size`` bytes of text, one row at least.

    Work on a slice takes some dozen bytes of memory a byte of text, whatever the batches' size is.
    """
    for batch in batches:
        col = batch.column(column)
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        pa.default_memory_pool().release_unused()


def words(col, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash, row, [hash of the first k bytes for each k of ``prefixes``]) of every lower-case word, in text order.

    A word is a longest run of ASCII letters and digits and of other characters beyond ASCII. A word
    of at most k bytes has 0 for its prefix of k bytes.
    """
    data, off = buffers(col)
    hashes, rows, firsts = [], [], [[] for _ in prefixes]
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(end, lo + WINDOW)
        if hi < end:
            hi = _cut(data, off, lo, hi, end)
        b = data[lo:hi]
        m = _WORD[b]
        first = m.copy()
        first[1:] &= ~m[:-1]
        at = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        first[at] = m[at]
        start = np.flatnonzero(first)
        if len(start):
            last = m.copy()
            last[:-1] &= ~(m[1:] & ~first[1:])
            stop = np.flatnonzero(last) + 1
            p, inv = _powers(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=sums[1:])
            base, back = sums[start], inv[start]
            hashes.append(mix((sums[stop] - base) * back))
            rows.append(np.searchsorted(off, start + lo, "right") - 1)
            for k, out in zip(prefixes, firsts):
                h = mix((sums[np.minimum(start + k, stop)] - base) * back + np.uint64(k))
                h[stop - start <= k] = 0
                out.append(h)
        lo = hi
    none = np.zeros(0, np.uint64)
    join = lambda parts: np.concatenate(parts) if parts else none
    return join(hashes), join(rows).astype(np.int64), [join(x) for x in firsts]


def _cut(data, off, lo, hi, end) -> int:
    """A place near ``hi`` that splits no word: back to one, or on to the next one."""
    if not (_WORD[data[hi]] and _WORD[data[hi - 1]]):
        return hi
    starts = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi, "right")]
    gaps = np.flatnonzero(~_WORD[data[lo:hi]])
    back = max(int(starts[-1]) if len(starts) else lo, lo + int(gaps[-1]) + 1 if len(gaps) else lo)
    if back > lo:
        return back
    nexts = np.searchsorted(off, hi, "right")
    limit = int(off[nexts]) if nexts < len(off) else end
    while hi < limit and _WORD[data[hi]]:
        hi += 1
    return hi


def word_hash(word: str, prefix: int = 0) -> int:
    """The hash that ``words`` gives to one word, or to its first ``prefix`` bytes."""
    h, _, first = words(pa.array([word]), (prefix,) if prefix else ())
    return int(first[0][0]) if prefix else int(h[0])


def spans(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each row's items in an array ordered by row, and how many it has."""
    count = np.bincount(rows, minlength=n).astype(np.int64)
    return np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count


def segment(ufunc, values: np.ndarray, start: np.ndarray, count: np.ndarray, empty):
    """``ufunc.reduceat`` over rows' items, with ``empty`` for rows without any."""
    out = np.full(len(start), empty, values.dtype)
    some = count > 0
    if some.any():
        out[some] = ufunc.reduceat(values, start[some])
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within a row, with each row's start and count.

    A row of fewer words, but one at least, has one shingle of all its words.
    """
    start, count = spans(rows, n)
    if not len(hashes):
        return hashes, start, count
    mult = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(hashes), np.uint64)
    left = (start + count)[rows] - np.arange(len(hashes))
    for k in range(width):
        part = np.zeros(len(hashes), np.uint64)
        part[: len(hashes) - k] = hashes[k:]
        total += np.where(left > k, part * mult[k], np.uint64(0))
    keep = left >= width
    short = start[(count > 0) & (count < width)]
    keep[short] = True
    total = mix(total[keep])
    start, count = spans(rows[keep], n)
    return total, start, count
