"""FLAC streams to integer samples, after the published format (RFC 9639)."""

from __future__ import annotations

from operator import mul

import numpy as np

_RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class _Bits:
    """Bits of a piece of a stream, most significant first."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        # place of the next 1 at or after each place
        at = np.where(self.bits, np.arange(n), n)
        self.next = np.minimum.accumulate(at[::-1])[::-1].tolist()
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise EOFError("a frame is cut off")
        self.at += n
        return int("0" + "".join(map(str, self.bits[self.at - n : self.at])), 2)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def signs(self, many: int, n: int) -> np.ndarray:
        return np.array([self.signed(n) for _ in range(many)], np.int64)

    def unary(self) -> int:
        stop = self.next[self.at] if self.at < len(self.bits) else len(self.bits)
        if stop == len(self.bits):
            raise EOFError("a frame is cut off")
        n, self.at = stop - self.at, stop + 1
        return n

    def rice(self, many: int, k: int) -> np.ndarray:
        """Folded Golomb-Rice codes: a first pass finds where each lies, the low bits are gathered together."""
        ends, at, nexts, limit = [], self.at, self.next, len(self.bits)
        for _ in range(many):
            if at >= limit:
                raise EOFError("a frame is cut off")
            at = nexts[at] + 1
            ends.append(at)
            at += k
        if at > limit:
            raise EOFError("a frame is cut off")
        low = np.array(ends, np.int64)
        starts = np.concatenate([[self.at], low[:-1] + k]) if many else low
        value = low - starts - 1
        for j in range(k):
            value = value << 1 | self.bits[low + j]
        self.at = at
        return value >> 1 ^ -(value & 1)


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % parts:
        raise ValueError("unknown coding of residuals")
    width = 5 if method else 4
    out = []
    for i in range(parts):
        many, k = size // parts - (order if i == 0 else 0), bits.take(width)
        out.append(bits.signs(many, bits.take(5)) if k == (1 << width) - 1 else bits.rice(many, k))
    return np.concatenate(out)


def _subframe(bits: _Bits, size: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe begins with a 1")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(size, bits.signed(width), np.int64)
    elif kind == 1:
        x = bits.signs(size, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.signs(order, width)
        x = _residual(bits, size, order)
        # a residual is a difference of its order: sums undo it, each from the last difference of the warm-up on
        for k in range(order - 1, -1, -1):
            x = np.cumsum(x) + np.diff(first, k)[-1]
        x = np.concatenate([first, x])
    elif kind >= 32:
        order = kind - 31
        first = bits.signs(order, width)
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = bits.signs(order, precision).tolist()[::-1]
        values = first.tolist()
        for r in _residual(bits, size, order).tolist():
            values.append(r + (sum(map(mul, weights, values[-order:])) >> shift))
        x = np.array(values, np.int64)
    else:
        raise ValueError("unknown kind of subframe")
    return x << wasted


def decode_flac(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, bits a sample, samples x channels). A stream that is cut off is an error."""
    if data[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, rate = 4, 0
    while True:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            about = int.from_bytes(data[at + 14 : at + 22], "big")
            rate, channels, width, total = about >> 44, (about >> 41 & 7) + 1, (about >> 36 & 31) + 1, about & ((1 << 36) - 1)
            largest, most = int.from_bytes(data[at + 6 : at + 8], "big"), int.from_bytes(data[at + 11 : at + 14], "big")
        at += 4 + size
        if last or at >= len(data):
            break
    if not rate:
        raise ValueError("no stream information")
    out, held = [], 0
    while at + 6 <= len(data) and (not total or held < total):
        piece = max(most, largest * channels * (width + 1) // 8 + 256)
        while True:
            try:
                frame, used = _frame(data[at : at + piece], width)
                break
            except (EOFError, IndexError):
                if at + piece >= len(data):
                    raise EOFError("a frame is cut off") from None
                piece *= 2
        out.append(frame)
        held += len(frame)
        at += used
    if total and held < total:
        raise EOFError("the stream is cut off")
    return rate, width, np.concatenate(out) if out else np.zeros((0, channels), np.int64)


def _frame(data: bytes, width: int) -> tuple[np.ndarray, int]:
    """(samples x channels, bytes used) of the frame at the beginning of ``data``."""
    bits = _Bits(data)
    if bits.take(15) != 0x7FFC:
        raise ValueError("a frame doesn't begin where it should")
    bits.take(1)
    block, rate, layout, kind = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    head = bits.take(8)
    for _ in range(max(0, f"{head:08b}".index("0") - 1) if head != 255 else 0):
        bits.take(8)
    size = 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else bits.take(8) + 1 if block == 6 else bits.take(16) + 1 if block == 7 else 256 << (block - 8)
    if block == 0:
        raise ValueError("reserved size of a block")
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    width = _WIDTHS.get(kind, width)
    bits.take(8)
    if layout > 10:
        raise ValueError("reserved layout of channels")
    sides = [_subframe(bits, size, width + (layout in (8, 10) and i == 1 or layout == 9 and i == 0)) for i in range(layout + 1 if layout < 8 else 2)]
    if layout == 8:
        sides[1] = sides[0] - sides[1]
    elif layout == 9:
        sides[0] = sides[0] + sides[1]
    elif layout == 10:
        middle = sides[0] * 2 + (sides[1] & 1)
        sides = [(middle + sides[1]) >> 1, (middle - sides[1]) >> 1]
    bits.at += -bits.at % 8
    bits.take(16)
    return np.stack(sides, axis=1), bits.at // 8
