"""Near-duplicate documents by b-bit MinHash.

Every document gets K minima over its word shingles. Bands of full minima propose candidates; of
each minimum only the low b bits stay, packed into one binary value, and the share of equal b-bit
cells, corrected for the chance 2^-b that two cells agree by accident, estimates the Jaccard
similarity. Documents with equal minima are one node before bands are formed, and inside a bucket
only the edges that connect it are emitted, so that a group of n copies costs about n edges. A bucket
of any size is compared in lists of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import _text
from scorelake.llm._common import mapped, require, staged
from scorelake.llm.graph import components

SHINGLE, HASHES, BITS, BANDS, THRESHOLD = 3, 126, 2, 42, 0.45
#: Nodes of a bucket that one list may hold; larger buckets go by blocks.
BUCKET = 4096
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BLOCK = 1 << 14


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = _text.mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (a[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (a[k:] >> np.uint64(32)).astype(np.uint32)


def minima(col, width: int = SHINGLE, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """(minima as rows x hashes, number of shingles); a row without a word has no shingle."""
    n = len(col)
    h, rows, _ = _text.words(col)
    x, start, count = _text.shingles(h, rows, n, width)
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full((n, hashes), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(count)
    a, b = _seeds(hashes)
    starts, ends = start[some], start[some] + count[some]
    at = 0
    while at < len(some):
        # rows of about a block's shingles together, so that each pass stays in the cache; a row that
        # ends further than 8 blocks on isn't among them: a group by itself, it is read part by part
        near = min(np.searchsorted(starts, starts[at] + _BLOCK, "left"), np.searchsorted(ends, starts[at] + _BLOCK * 8, "right"))
        to = max(at + 1, int(near))
        group = some[at:to]
        for p in range(starts[at], ends[to - 1], _BLOCK * 8):
            part = x[p : min(ends[to - 1], p + _BLOCK * 8)]
            cuts = starts[at:to] - p if len(group) > 1 else np.zeros(1, np.int64)
            for k in range(hashes):
                low = np.minimum.reduceat(part * a[k] + b[k], cuts)
                out[group, k] = np.minimum(out[group, k], low)
        at = to
    return out, count


def pack(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` of each minimum, plane after plane, as bytes.

    A minimum is scrambled first: minima of large documents are small numbers, whose low bits the
    linear hash leaves dependent.
    """
    scrambled = _text.mix(low.astype(np.uint64) + (np.arange(1, low.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))
    planes = [np.packbits(((scrambled >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), axis=1) for i in range(bits)]
    return np.concatenate(planes, axis=1)


def similarity(one: np.ndarray, many: np.ndarray, bits: int = BITS, cells: int = HASHES) -> np.ndarray:
    """Collision-corrected Jaccard estimate of packed signatures, row by row or one against many."""
    x = (many ^ one).reshape(len(many), bits, -1)
    differ = _POP[np.bitwise_or.reduce(x, axis=1)].sum(axis=1, dtype=np.int64)
    chance = 0.5**bits
    return ((1 - differ / cells) - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shingles, same, sig, bands): ``same`` is a hash of all minima, ``bands`` one key a band."""
    require(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_a_band = HASHES // BANDS
        for batch in _text.pieces(batches, 1):
            low, count = minima(batch.column(1))
            n = len(count)
            wide = low.astype(np.uint64)
            mult = _text.mix(np.arange(7, 7 + HASHES, dtype=np.uint64)) | np.uint64(1)
            cells = _text.mix(wide * mult)
            bands = _text.mix(cells.reshape(n, BANDS, rows_a_band).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            same = _text.mix(cells.sum(axis=1, dtype=np.uint64))
            packed = pack(low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count),
                    pa.array(same.view(np.int64)),
                    pa.array([p.tobytes() for p in packed], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                ["doc_id", "shingles", "same", "sig", "bands"],
            )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    return mapped(narrow, run, "doc_id long, shingles long, same long, sig binary, bands array<long>")


def bucket_edges(nodes: np.ndarray, sigs: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Edges that connect exactly what all pairs at or over the threshold would connect.

    Breadth first: each node that joins is compared with all that have not joined yet, so a tight
    bucket takes about one comparison a member, and no pair that could matter is left out.
    """
    out = []
    left = np.argsort(nodes, kind="stable")
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            sim = similarity(sigs[at], sigs[left])
            hit = sim >= threshold
            out += [(int(nodes[at]), int(nodes[x]), float(s)) for x, s in zip(left[hit], sim[hit])]
            queue += list(left[hit])
            left = left[~hit]
    return out


def cross_edges(nodes: np.ndarray, sigs: np.ndarray, roots: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Edges between the two sides of a cell (0 and 1) that join different roots, one for each pair of roots.

    Roots joined on the way count as one, so most comparisons of a cell fall away once its groups meet.
    """
    out, root = [], roots.copy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at in left:
        other = right[root[right] != root[at]]
        if not len(other):
            continue
        sim = similarity(sigs[at], sigs[other])
        hit = np.flatnonzero(sim >= threshold)
        for x in hit[np.unique(root[other[hit]], return_index=True)[1]]:
            out.append((int(nodes[at]), int(nodes[other[x]]), float(sim[x])))
        root[np.isin(root, root[other[hit]])] = root[at]
    return out


_EDGES = "a long, b long, similarity double"


def _edge_batch(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, sim = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(nodes, signatures, starts, stops, structs) of a column of lists of structs of node and sig."""
    lists = batch.column(0)
    inner = lists.flatten()
    node = inner.field(0).to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(inner.field(1).to_pylist()), np.uint8).reshape(len(node), -1)
    stop = np.cumsum(np.asarray(lists.value_lengths()))
    return node, sig, stop - np.asarray(lists.value_lengths()), stop, inner


def _within(groups: DataFrame, threshold: float) -> DataFrame:
    """Edges inside each list of a column of lists of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, start, stop, _ = _lists(batch)
            pairs = start[stop - start == 2]
            found: list[tuple[int, int, float]] = []
            if len(pairs):
                sim = similarity(sig[pairs], sig[pairs + 1])
                ok = sim >= threshold
                found += zip(node[pairs][ok].tolist(), node[pairs + 1][ok].tolist(), sim[ok].tolist())
            for s, e in zip(start[stop - start > 2], stop[stop - start > 2]):
                found += bucket_edges(node[s:e], sig[s:e], threshold)
            if found:
                yield _edge_batch(found)

    return mapped(groups, run, _EDGES)


def _between(cells: DataFrame, threshold: float) -> DataFrame:
    """Edges between the sides of each cell, of lists of (node, sig, root, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, start, stop, inner = _lists(batch)
            root, side = (inner.field(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for s, e in zip(start, stop):
                found = cross_edges(node[s:e], sig[s:e], root[s:e], side[s:e], threshold)
                if found:
                    yield _edge_batch(found)

    return mapped(cells, run, _EDGES)


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, node, size) of the buckets of two nodes and more.

    Sizes are counted first, from keys alone: what most nodes are alone in goes no further, and
    signatures come only to nodes that share a bucket.
    """
    each = nodes.select(F.explode("bands").alias("band"), "node")
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return each.join(shared, "band").select("band", "node", "size")


def edges(nodes: DataFrame, threshold: float = THRESHOLD, most: int = BUCKET) -> DataFrame:
    """(a, b, similarity) from nodes (node, sig, bands): edges that connect what all pairs of a bucket would connect.

    A bucket of up to ``most`` nodes is one list. A larger one is cut into blocks of about half as many:
    nodes are joined within their block, and then the least nodes of the blocks' groups with one another,
    in blocks again. Where that leaves a bucket in more than one group, all pairs of its blocks are
    compared, nodes of one group apart. So no list exceeds ``most`` by more than chance, and no pair that
    could matter is left out.
    """
    nodes = staged(nodes, "nodes")
    sigs = nodes.select("node", "sig")
    shared = staged(buckets(nodes).join(sigs, "node"), "buckets")
    item = F.struct("node", "sig")
    small = _within(shared.filter(F.col("size") <= most).groupBy("band").agg(F.collect_list(item).alias("x")).select("x"), threshold)
    hot = shared.filter(F.col("size") > most)
    if hot.isEmpty():
        return _tidy(small)
    half = max(2, most // 2)
    salted = lambda df, size: df.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.ceil(size / half).cast("long")).cast("int")).withColumn("blocks", F.ceil(size / half).cast("int"))
    cut = staged(salted(hot, F.col("size")), "blocks")
    inside = staged(_within(cut.groupBy("band", "block").agg(F.collect_list(item).alias("x")).select("x"), threshold).unionByName(small), "inside")
    # the least node of each group of a bucket stands for it
    first = components(inside.select("a", "b"))
    rooted = lambda df, found: df.join(found.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
    leaders = rooted(cut, first).groupBy("band", "root").agg(F.min(item).alias("x")).select("band", "root", "x.node", "x.sig")
    counted = leaders.join(leaders.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "band")
    among = _within(salted(counted, F.col("size")).groupBy("band", "block").agg(F.collect_list(item).alias("x")).select("x"), threshold)
    joined = staged(inside.unionByName(among), "joined")
    # buckets that are still in several groups: every pair of their blocks
    again = rooted(cut, components(joined.select("a", "b")))
    open_ = again.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    rest = again.join(open_, "band")
    with_all = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low = rest.select("band", F.struct("node", "sig", "root", F.lit(0).alias("side")).alias("x"), F.col("block").alias("i"), with_all.alias("j")).filter("i <= j")
    high = rest.select("band", F.struct("node", "sig", "root", F.lit(1).alias("side")).alias("x"), with_all.alias("i"), F.col("block").alias("j")).filter("i <= j")
    cells = low.unionByName(high).groupBy("band", "i", "j").agg(F.collect_list("x").alias("x")).select("x")
    return _tidy(joined.unionByName(_between(cells, threshold)))


def _tidy(found: DataFrame) -> DataFrame:
    return found.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def membership(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id): every document that has a near duplicate, with the least doc_id of its group.

    Rows with a null id or text, and texts without a word, are in no group. Rows repeated under one
    doc_id count as one document. Similarity is transitive: groups are connected components.
    """
    sigs = staged(signatures(docs, key, text).filter("shingles > 0"), "signatures")
    nodes = sigs.groupBy("same").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("x")).select("same", F.col("x.doc_id").alias("node"), "x.sig", "x.bands")
    copies = sigs.select("same", "doc_id").join(nodes.select("same", "node"), "same").filter("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    near = edges(nodes.select("node", "sig", "bands"), threshold).select("a", "b")
    return components(copies.union(near)).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(group_id, doc_ids, n_docs): one row a group of near duplicates; the document group_id stays.

    ``doc_ids`` is sorted and holds the group's members once each. An empty table and a table
    without near duplicates give no row.
    """
    return membership(docs, key, text, threshold).groupBy("group_id").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"), F.count_distinct("doc_id").alias("n_docs"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the near duplicates of an earlier document, columns as they were.

    The document with the least id of each group stays. Rows with a null id stay.
    """
    gone = membership(docs, key, text, threshold).filter("doc_id != group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[key].cast("long") == gone["__gone"], "left_anti")
