"""Edit alignments of token arrays: deletions, insertions, replacements and matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("delete", "insert", "replace", "equal")])


#: Bits of traced rows that are kept at once; longer pairs are split in two first.
TRACE_BITS = 1 << 27


def _masks(tokens: Sequence) -> dict:
    """For each token the bits of its places."""
    out: dict = {}
    for i, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _sweep(ref: Sequence, hyp: Sequence, kept: list | None = None) -> tuple[int, int]:
    """Bits where the last column of the table rises and falls along ``ref``; ``kept`` gets those of every column.

    A column of the table is held as the signs of its steps, so one token of ``hyp`` takes a handful
    of operations on integers of as many bits as ``ref`` has tokens.
    """
    masks, full = _masks(ref), (1 << len(ref)) - 1
    up, down = full, 0
    for token in hyp:
        same = masks.get(token, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        if kept is not None:
            kept.append((up, down))
    return up, down


def _column(ref: Sequence, hyp: Sequence) -> np.ndarray:
    """Distances of every beginning of ``ref`` from the whole of ``hyp``."""
    up, down = _sweep(ref, hyp)
    size = -(-len(ref) // 8)
    bits = lambda v: np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(ref)].astype(np.int64)
    return np.concatenate([[len(hyp)], len(hyp) + np.cumsum(bits(up) - bits(down))])


def _trace(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(deletions, insertions, replacements) of a cheapest alignment; a step back deletes if it can, then inserts."""
    kept: list[tuple[int, int]] = []
    _sweep(ref, hyp, kept)
    i, j, d, s, r = len(ref), len(hyp), 0, 0, 0
    while i and j:
        if kept[j - 1][0] >> (i - 1) & 1:
            i, d = i - 1, d + 1
        else:
            j -= 1
            if j and kept[j - 1][1] >> (i - 1) & 1:
                s += 1
            else:
                i -= 1
                r += ref[i] != hyp[j]
    return d + i, s + j, r


def edit_counts(ref: Sequence, hyp: Sequence) -> tuple[int, int, int, int]:
    """(deletions, insertions, replacements, matches) of a cheapest alignment.

    Deletions + replacements + matches is the reference's length, insertions + replacements + matches
    the hypothesis'. Equal ends are set apart first. Pairs whose traced rows would take more than
    TRACE_BITS are split at the middle of the hypothesis, where both halves are cheapest together.
    """
    total = [0, 0, 0]
    todo = [(ref, hyp)]
    while todo:
        a, b = todo.pop()
        lo, n, m = 0, len(a), len(b)
        while lo < n and lo < m and a[lo] == b[lo]:
            lo += 1
        while n > lo and m > lo and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
        a, b = a[lo:n], b[lo:m]
        if not len(a) or not len(b):
            total[0] += len(a)
            total[1] += len(b)
        elif len(a) * len(b) > TRACE_BITS and len(b) > 1:
            half = len(b) // 2
            cut = int(np.argmin(_column(a, b[:half]) + _column(a[::-1], b[half:][::-1])[::-1]))
            todo += [(a[:cut], b[:half]), (a[cut:], b[half:])]
        else:
            total = [x + y for x, y in zip(total, _trace(a, b))]
    d, s, r = total
    return d, s, r, len(ref) - d - r


@F.pandas_udf(COUNTS)
def _counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if a is None or b is None else edit_counts(list(a), list(b)) for a, b in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["delete", "insert", "replace", "equal"], dtype="Int64")


@F.pandas_udf(COUNTS)
def _character_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if a is None or b is None else edit_counts(a, b) for a, b in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["delete", "insert", "replace", "equal"], dtype="Int64")


def character_counts(ref: Column, hyp: Column) -> Column:
    """``counts`` of the characters of two texts, which go to Python as texts: as arrays they take many times the room."""
    return _character_counts(ref, hyp)


def counts(ref: Column, hyp: Column) -> Column:
    """Struct of counts of two token arrays; null fields where either is null."""
    return _counts(ref, hyp)


def characters(text: Column) -> Column:
    """The characters of a text, spaces too; none for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def phonemes(tokens: Column) -> Column:
    """Phoneme tokens split at underscores, empty parts dropped."""
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "_"))), lambda p: p != "")
