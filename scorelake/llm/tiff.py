"""TIFF media columns: one row a page.

Walks the chain of image directories of each binary value, decodes strips and tiles (none, PackBits,
LZW, deflate), undoes horizontal and floating-point predictors, and emits each page's properties
and samples. Both byte orders and 64-bit offsets are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm._common import mapped, require

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FORM = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NAMES = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate"}
#: Samples that an array of a row can hold.
MOST_SAMPLES = (1 << 31) - 16
#: Bytes that a byte of each compression can stand for at most.
_GROWTH = {1: 1, 5: 4096, 8: 1040, 32773: 64, 32946: 1040}


def unpackbits(data: bytes, size: int) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    table = _SINGLE[:]
    out: list[bytes] = []
    total, width, mask, grow, last = 0, 9, 511, 511, b""
    acc = bits = 0
    for at in range(0, len(data), 128):
        piece = data[at : at + 128]
        acc, bits = (acc & ((1 << bits) - 1)) << 8 * len(piece) | int.from_bytes(piece, "big"), bits + 8 * len(piece)
        while bits >= width:
            bits -= width
            code = acc >> bits & mask
            if code < 256 or 257 < code < len(table):
                entry = table[code]
            elif code == 257:
                return b"".join(out)[:size]
            elif code == 256:
                table, width, mask, grow, last = _SINGLE[:], 9, 511, 511, b""
                continue
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            if last:
                table.append(last + entry[:1])
                if len(table) >= grow and width < 12:
                    width += 1
                    mask = grow = (1 << width) - 1
            out.append(entry)
            total += len(entry)
            last = entry
            if total >= size:
                return b"".join(out)[:size]
    return b"".join(out)[:size]


_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def packbits(data: bytes) -> bytes:
    """Runs of 2 to 128 equal bytes, and what lies between them in pieces of up to 128."""
    out, at = bytearray(), 0
    for m in [*_RUN.finditer(data), None]:
        stop = m.start() if m else len(data)
        for i in range(at, stop, 128):
            piece = data[i : min(stop, i + 128)]
            out.append(len(piece) - 1)
            out += piece
        if m:
            at = m.end()
            out += bytes([257 - (at - stop), data[stop]])
    return bytes(out)


def lzw(data: bytes) -> bytes:
    table: dict[int, int] = {}  # code of a beginning and the byte after it -> code of both
    out, acc, bits, width, size, now = bytearray(), 256, 9, 9, 258, -1
    for c in data:
        if now < 0:
            now = c
            continue
        both = table.get(now << 8 | c)
        if both is not None:
            now = both
            continue
        acc, bits = acc << width | now, bits + width
        table[now << 8 | c] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        if size == 4094:
            acc, bits = acc << width | 256, bits + width
            table, size, width = {}, 258, 9
        now = c
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
    if now >= 0:
        acc, bits = acc << width | now, bits + width
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    return bytes(out) + (acc << (-bits % 8)).to_bytes(-(-bits // 8), "big")


_DECODE = {1: lambda d, n: d[:n], 5: unlzw, 8: lambda d, n: zlib.decompressobj().decompress(d, n), 32773: unpackbits}
_DECODE[32946] = _DECODE[8]
_ENCODE = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def directories(data: bytes) -> tuple[str, Iterator[dict[int, tuple | None] | ValueError]]:
    """(byte order, tags of each image directory in chain order, read one at a time); a loop in the chain ends it.

    A tag whose values lie beyond the end is None. A directory that can't be read comes as an error
    and ends the chain, since the next one's place isn't known.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version == 42:
        count, entry, offset, inline, at = "H", 12, "I", 4, struct.unpack_from(order + "I", data, 4)[0]
    elif version == 43:
        count, entry, offset, inline, at = "Q", 20, "Q", 8, struct.unpack_from(order + "Q", data, 8)[0]
    else:
        raise ValueError("not a TIFF")

    def chain(at: int) -> Iterator[dict[int, tuple | None] | ValueError]:
        seen = set()
        while at and at not in seen:
            seen.add(at)
            p = at + struct.calcsize(order + count)
            n = struct.unpack_from(order + count, data, at)[0] if p <= len(data) else 0
            if p > len(data) or p + n * entry > len(data):
                yield ValueError("a directory lies beyond the end")
                return
            tags: dict[int, tuple | None] = {}
            for tag, kind, many, body in struct.iter_unpack(f"{order}HH{offset}{inline}s", data[p : p + n * entry]):
                form = _FORM.get(kind)
                if form is None:
                    continue
                size = _SIZE[kind] * many
                if size > inline:
                    at = struct.unpack(order + offset, body)[0]
                    tags[tag] = struct.unpack_from(f"{order}{many}{form}", data, at) if at + size <= len(data) else None
                else:
                    tags[tag] = struct.unpack_from(f"{order}{many}{form}", body)
            yield tags
            p += n * entry
            if p + struct.calcsize(order + offset) > len(data):
                yield ValueError("the chain of directories is cut off")
                return
            at = struct.unpack_from(order + offset, data, p)[0]

    return order, chain(at)


def _undo(block: np.ndarray, predictor: int, raw: bytes, shape: tuple[int, int, int], size: int, order: str, dtype: np.dtype) -> np.ndarray:
    h, w, s = shape
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(h, -1).copy()
        for k in range(s):
            planes[:, k::s] = np.cumsum(planes[:, k::s], axis=1, dtype=np.uint8)
        # most significant bytes of all samples of a row come first
        return np.ascontiguousarray(planes.reshape(h, size, w * s).transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    if predictor == 2:
        return np.cumsum(block.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
    return block


def page(data: bytes, order: str, tags: dict[int, tuple | None]) -> tuple[dict, np.ndarray]:
    """(properties, samples as height x width x samples a pixel)."""
    tiled = 322 in tags
    if None in tags.values() and any(tags.get(t, ()) is None for t in (256, 257, 258, 259, 277, 284, 317, 339, *((322, 323, 324, 325) if tiled else (273, 278, 279)))):
        raise ValueError("a tag's values lie beyond the end")
    one = lambda t, d=None: tags[t][0] if t in tags else d
    width, height = one(256), one(257)
    if not width or not height:
        raise ValueError("a page has no size")
    s, bits, form = one(277, 1), one(258, 1), one(339, 1)
    compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    if width * height * s > MOST_SAMPLES:
        raise ValueError("a page has more samples than an array holds")
    if compression not in _DECODE:
        raise ValueError(f"compression {compression}")
    if bits == 1:
        dtype = np.dtype(np.uint8)
    elif bits in (8, 16, 32, 64) and (form != 3 or bits > 8):
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f', 4: 'u'}[form] }{bits // 8}")
    else:
        raise ValueError(f"{bits} bits a sample")
    bw, bh = (one(322), one(323)) if tiled else (width, min(height, one(278, height)))
    offsets, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    # no room is made for samples that the data can't hold
    if height * -(-width * s * bits // 8) > (min(sum(sizes), len(data) * len(sizes)) + 8) * _GROWTH[compression]:
        raise ValueError("a strip or tile is cut off")
    across, down = -(-width // bw), -(-height // bh)
    per = 1 if planar == 2 else s
    out = np.zeros((height, width, s), dtype.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        plane, k = divmod(k, across * down)
        y, x = divmod(k, across)
        if plane and planar != 2:
            break
        rows = bh if tiled else min(bh, height - y * bh)
        row_bytes = -(-bw * per * bits // 8)
        raw = _DECODE[compression](data[at : at + size], rows * row_bytes)
        if len(raw) < rows * row_bytes:
            raise ValueError("a strip or tile is cut off")
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : bw * per].reshape(rows, bw, per)
        else:
            block = np.frombuffer(raw, dtype).reshape(rows, bw, per)
            block = _undo(block, predictor, raw, (rows, bw, per), bits // 8, order, dtype)
        h, w = min(rows, height - y * bh), min(bw, width - x * bw)
        out[y * bh : y * bh + h, x * bw : x * bw + w, plane : plane + per] = block[:h, :w]
    return {"width": width, "height": height, "samples": s, "bits": bits, "format": {1: "uint", 2: "int", 3: "float", 4: "uint"}[form], "compression": NAMES[compression], "predictor": predictor, "blocks": len(offsets), "tiled": tiled}, out


_SHORT, _LONG = struct.Struct("<HHIHxx").pack, struct.Struct("<HHII").pack


def _differences(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode(pages: list[dict]) -> bytes:
    """A little-endian TIFF of pages {pixels (height x width), compression, predictor, rows or tile}."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for p in pages:
        x = np.ascontiguousarray(p["pixels"])
        height, width = x.shape
        code, predictor, tile = p.get("compression", 1), p.get("predictor", 1), p.get("tile")
        bh, bw = (tile, tile) if tile else (p.get("rows", height), width)
        offsets, sizes = [], []
        for y in range(0, height, bh):
            for c in range(0, width, bw):
                block = x[y : y + bh, c : c + bw]
                if tile:
                    whole = np.zeros((bh, bw), block.dtype)
                    whole[: block.shape[0], : block.shape[1]] = block
                    block = whole
                if predictor == 2:
                    block = _differences(block)
                elif predictor == 3:
                    planes = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(block), -1, x.itemsize).transpose(0, 2, 1).reshape(len(block), -1)
                    block = _differences(planes)
                raw = block.tobytes()
                packed = _ENCODE[code](raw)
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\x00" * (len(packed) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [x.itemsize * 8]), (259, 3, [code]), (262, 3, [1]), (277, 3, [1])]
        tags += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [bh]), (279, 4, sizes)]
        tags = sorted([*tags, (317, 3, [predictor]), (339, 3, [kind])])
        entries = b""
        for tag, form, values in tags:
            if len(values) == 1:
                entries += (_SHORT if form == 3 else _LONG)(tag, form, 1, values[0])
            else:
                body = struct.pack(f"<{len(values)}I", *values)
                entries += _LONG(tag, form, len(values), len(out))
                out += body
        at = len(out)
        out[link : link + 4] = struct.pack("<I", at)
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


SCHEMA = "key long, page int, width int, height int, samples int, bits int, format string, compression string, predictor int, blocks int, tiled boolean, pixels array<double>, error string"


def pages(media: DataFrame, key: str, data: str) -> DataFrame:
    """One row a page: key, page from 0 on, properties, and ``pixels`` row by row, samples of a pixel together.

    A null value has no row. A value that isn't a TIFF has one row, with page -1 and the reason in
    ``error``; a page that can't be decoded has a row with its number and the reason, and the pages
    after it are read. Where the chain of pages breaks, those before have their rows and the page at
    fault one with the reason. Repeated rows give their pages each time. A page of any size is decoded,
    up to the 2^31 elements of an array; beyond that it has a row with the reason.
    """
    require(media, key, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value is None:
                    continue
                try:
                    order, chain = directories(value)
                except (ValueError, struct.error) as e:
                    rows.append({"key": k, "page": -1, "error": str(e)})
                    continue
                for n, tags in enumerate(chain):
                    try:
                        if isinstance(tags, ValueError):
                            raise tags
                        about, x = page(value, order, tags)
                        rows.append({"key": k, "page": n, **about, "pixels": x.astype(np.float64).reshape(-1)})
                        held += x.size
                    except (ValueError, TypeError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                        rows.append({"key": k, "page": n, "error": str(e)})
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    fields = [("key", pa.int64()), ("page", pa.int32()), *((c, pa.int32()) for c in ("width", "height", "samples", "bits")), ("format", pa.string()), ("compression", pa.string()), ("predictor", pa.int32()), ("blocks", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.list_(pa.float64())), ("error", pa.string())]

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields], [c for c, _ in fields])

    return mapped(media.select(F.col(key).cast("long").alias("key"), F.col(data).alias("data")), run, SCHEMA)


def from_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 8) -> DataFrame:
    """(key, data): each vector as a TIFF of three pages, ``width`` samples a row.

    Page 0 holds the values (32-bit float, deflate, predictor 3), page 1 them in 8 bits (LZW,
    predictor 2, strips of 4 rows), page 2 in 16 bits (PackBits, tiles). Null and empty vectors, and
    those with null, have null data; rows are filled up with 0.
    """
    require(vectors, key, vector)

    def one(v: list[float]) -> bytes | None:
        x = np.zeros(-(-len(v) // width) * width, np.float32)
        x[: len(v)] = v
        x = x.reshape(-1, width)
        wide = np.clip((x.astype(np.float64) + 1) / 2, 0, 1)
        return encode(
            [
                {"pixels": x, "compression": 8, "predictor": 3},
                {"pixels": np.floor(wide * 255).astype(np.uint8), "compression": 5, "predictor": 2, "rows": 4},
                {"pixels": np.floor(wide * 65535).astype("<u2"), "compression": 32773, "tile": 16},
            ]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if not v or any(e is None for e in v) else one(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "data"])

    return mapped(vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v")), run, "key long, data binary")
