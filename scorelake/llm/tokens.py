"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Byte-pair encodings have a useful property: the encoding of a prefix ends in exactly one token t
for which the encoding before it and t stay apart when encoded together. So with count[j] =
count[j - |t|] + 1 one pass gives the count of every prefix. A pre-token's counts are computed once
and kept; a text's counts are those of its pre-tokens put end to end. Counts are stored as the
change at each character, which takes a few bits each, and questions of truncation and budget are
answered from them without encoding again.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm._common import mapped, require

#: Rank file of a public byte-level BPE; the path is a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept, and the bytes of their counts; a longer one than LONG characters isn't kept.
CACHE, CACHE_BYTES, LONG = 400_000, 32 << 20, 256
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


class Counter(dict):
    """Pre-token -> int32 counts at each of its characters, as bytes; made when first asked for."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY) -> None:
        """``vocabulary`` is the path of a rank file, or what it holds."""
        import regex
        import tiktoken

        super().__init__()
        self.held = 0
        lines = contents(vocabulary).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.apart: dict[int, bool] = {}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, 3, np.uint8)  # 0 letter, 1 number, 2 white space, 3 other
        for kind, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (2, r"\s")):
            self.kind[[ord(c) for c in regex.findall(pattern, chars)]] = kind

    def __missing__(self, token: str) -> bytes:
        found = self.counts_of(token).tobytes()
        if len(token) <= LONG:
            if len(self) >= CACHE or self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[token] = found
            self.held += len(found)
        return found

    def counts_of(self, token: str) -> np.ndarray | array:
        """Count at each character of one pre-token."""
        if len(token) > 2 and token[0] == "'" and token[1:] in _SUFFIXES:  # "'re" splits as "'", "r" while it is "'r"
            return np.array([len(self.encoding.encode_ordinary(token[:j])) for j in range(1, len(token) + 1)], np.int32)
        raw = token.encode("utf-8")
        counts = self.dynamic(raw)
        if len(raw) == len(token):
            return array("i", counts[1:])
        ends = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[1:]
        return np.array(counts, np.int32)[np.append(ends, len(raw))]

    def dynamic(self, raw: bytes) -> list[int]:
        """Count at each byte, 0 first.

        Exactly one token that ends at a place stays apart from what comes before it. The likeliest is tried
        first: the last token of the place before with one byte more, then shorter ones, then longer ones.
        """
        ranks, apart = self.ranks, self.apart
        n = len(raw)
        counts, last, start = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i, first = start, start
            while True:
                t = ranks.get(raw[i:j])
                if t is not None:
                    if not i:
                        break
                    pair = last[i] << 20 | t
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > 1_000_000:
                            apart.clear()
                        ok = apart[pair] = self._stay_apart(last[i], t)
                    if ok:
                        break
                if i >= first:
                    i += 1
                    if i == j:
                        i = first - 1
                else:
                    i -= 1
                if i < 0:
                    raise ValueError("the vocabulary lacks single bytes")
            counts[j], last[j], start = counts[i] + 1, t, i
        return counts

    def _stay_apart(self, a: int, b: int) -> bool:
        return self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the pre-tokens and the text's length, kinds of the characters)."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(kind)
        cut = np.ones(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        # the last of a run of white space goes with what follows: as its first character if it is a space, else alone
        end = np.flatnonzero((kind[:-1] == 2) & (kind[1:] != 2)) + 1 if n > 1 else np.zeros(0, np.int64)
        space = codes[end - 1] == 32
        cut[end - 1] = True
        cut[end[space]] = False
        quote = np.flatnonzero((codes == 39) & cut[:n]) if "'" in text else ()
        for q in quote:
            if q + 1 < n and kind[q + 1] == 0:
                for s in _SUFFIXES:
                    if text.startswith(s, q + 1):
                        cut[q + 1] = False
                        cut[q + 1 + len(s)] = True
                        break
        return np.flatnonzero(cut), kind

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for i = 1 to len(text)."""
        if not text:
            return np.zeros(0, np.int32)
        at, kind = self.split(text)
        edges = at.tolist()
        tokens = [text[a:b] for a, b in zip(edges, edges[1:])]
        own = np.frombuffer(b"".join(map(self.__getitem__, tokens)), np.int32)
        totals = own[at[1:] - 1]
        base = np.cumsum(totals) - totals
        out = own + np.repeat(base, np.diff(at)).astype(np.int32)
        # a prefix that ends inside white space has all of that run as its last pre-token
        white = kind == 2
        inside = white[1:] & white[:-1]
        if inside.any():
            first = np.flatnonzero(white & np.concatenate([[True], ~white[:-1]]))
            stop = np.flatnonzero(white & np.concatenate([~white[1:], [True]])) + 1
            for a, b in zip(first[stop - first > 1].tolist(), stop[stop - first > 1].tolist()):
                before = int(out[a - 1]) if a else 0
                out[a:b] = np.frombuffer(self[text[a:b]], np.int32) + before
        return out


_counters: dict[str, Counter] = {}


def contents(vocabulary: str | bytes) -> bytes:
    if isinstance(vocabulary, bytes):
        return vocabulary
    with open(vocabulary, "rb") as f:
        return f.read()


def counter(vocabulary: str | bytes = VOCABULARY) -> Counter:
    """The process's counter of a vocabulary."""
    data = contents(vocabulary)
    name = hashlib.sha256(data).hexdigest()
    if name not in _counters:
        _counters[name] = Counter(data)
    return _counters[name]


def prefix_table(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, changes): changes[i] is the count of the first i + 1 characters less that of the first i.

    An empty text has 0 tokens and no change, a null one has nulls. Null ids and repeated rows have
    a row each. The vocabulary is read here and sent to the executors once, a file of a few MB.
    """
    require(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(contents(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(sent.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo, size, parts = 0, 0, []
            for i, t in enumerate(texts):
                parts.append(None if t is None else c.prefix_counts(t))
                size += 0 if t is None else len(t)
                if size > 2_000_000 or i + 1 == len(texts):
                    yield _rows(ids.slice(lo, i + 1 - lo), parts)
                    lo, size, parts = i + 1, 0, []

    def _rows(ids: pa.Array, parts: list) -> pa.RecordBatch:
        flat = [np.diff(p, prepend=0).astype(np.int32) for p in parts if p is not None]
        sizes = np.array([-1 if p is None else len(p) for p in parts])
        null = sizes < 0
        cuts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts, mask=np.append(null, False)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        total = pa.array([None if p is None else (int(p[-1]) if len(p) else 0) for p in parts], pa.int64())
        return pa.RecordBatch.from_arrays([ids, total, lists], ["doc_id", "n_tokens", "changes"])

    return mapped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_tokens long, changes array<int>")


def tokens_at(changes: Column | str, chars: Column | int) -> Column:
    """Token count of the first ``chars`` characters; beyond the text's end that of the whole text."""
    n = F.lit(chars) if isinstance(chars, int) else chars
    return F.aggregate(F.slice(changes, F.lit(1), F.greatest(n, F.lit(0))), F.lit(0), lambda a, x: a + x)


def longest_within(changes: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + x
        i = a["i"] + 1
        return F.struct(i.alias("i"), n.alias("n"), F.when(n <= most, i).otherwise(a["best"]).alias("best"))

    return F.aggregate(changes, start, step)["best"]
