"""FLAC streams that an encoder of the test's own made, back to their samples."""

import numpy as np
import pytest

from scorelake.sources import audio
from scorelake.sources.flac import decode_flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(self, value, n):
        self.put(int(value) & ((1 << n) - 1), n)

    def rice(self, values, k):
        for v in values:
            u = int(v) * 2 if v >= 0 else -int(v) * 2 - 1
            self.bits += [0] * (u >> k) + [1]
            self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def subframe(w, x, width, how):
    kind = how[0]
    wasted = how[1] if kind == "wasted" else 0
    w.put(0, 1)
    if kind == "constant":
        w.put(0, 7)
        w.signed(x[0], width)
    elif kind in ("verbatim", "wasted"):
        w.put(1, 6)
        w.put(1 if wasted else 0, 1)
        if wasted:
            w.bits += [0] * (wasted - 1) + [1]
        for v in x:
            w.signed(v >> wasted, width - wasted)
    elif kind == "fixed":
        order, parts = how[1], how[2]
        w.put(8 + order, 6)
        w.put(0, 1)
        for v in x[:order]:
            w.signed(v, width)
        residual = np.diff(x, order)
        w.put(how[3], 2)
        w.put(parts.bit_length() - 1, 4)
        cuts = [0, *(len(x) // parts * (i + 1) - order for i in range(parts))]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if i % 2:
                w.put(31 if how[3] else 15, 5 if how[3] else 4)
                w.put(20, 5)
                for v in residual[a:b]:
                    w.signed(v, 20)
            else:
                w.put(5, 5 if how[3] else 4)
                w.rice(residual[a:b], 5)
    else:
        weights, shift = how[1], how[2]
        order = len(weights)
        w.put(31 + order, 6)
        w.put(0, 1)
        for v in x[:order]:
            w.signed(v, width)
        w.put(11, 4)
        w.signed(shift, 5)
        for c in weights:
            w.signed(c, 12)
        w.put(0, 6)
        w.put(6, 4)
        w.rice([int(x[i]) - (sum(c * int(x[i - 1 - j]) for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))], 6)


def stream(frames, rate=16_000, width=16, channels=1, total=None):
    """frames: (channels' arrays as coded, how each is coded, layout)."""
    size = max(len(f[0][0]) for f in frames)
    n = sum(len(f[0][0]) for f in frames) if total is None else total
    about = rate << 44 | (channels - 1) << 41 | (width - 1) << 36 | n
    info = size.to_bytes(2, "big") * 2 + bytes(6) + about.to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([129]) + (4).to_bytes(3, "big") + b"pad!"
    for number, (sides, hows, layout) in enumerate(frames):
        w = Writer()
        w.put(0x7FFC, 15)
        w.put(0, 1)
        w.put(7, 4)
        w.put(0, 4)
        w.put(layout, 4)
        w.put(0, 4)
        w.put(number, 8) if number < 128 else w.put(0xC080 | number >> 6 << 8 | number & 63, 16)
        w.put(len(sides[0]) - 1, 16)
        w.put(0, 8)
        for i, (x, how) in enumerate(zip(sides, hows)):
            subframe(w, x, width + (layout in (8, 10) and i == 1 or layout == 9 and i == 0), how)
        out += w.bytes() + b"\0\0"
    return out


def tone(n=480, seed=0):
    rng = np.random.default_rng(seed)
    return (8000 * np.sin(np.arange(n) / 9) + rng.normal(size=n) * 30).astype(np.int64)


@pytest.mark.parametrize("how", [("verbatim",), ("wasted", 3), *(("fixed", k, parts, m) for k, parts, m in ((0, 1, 0), (1, 4, 0), (2, 1, 1), (3, 2, 1), (4, 1, 0))), ("lpc", [1900, -990], 10), ("lpc", [700, 300, -200, 100], 10)])
def test_every_kind_of_subframe(how):
    x = tone() >> 3 << 3 if how[0] == "wasted" else tone()
    rate, width, got = decode_flac(stream([((x[:240],), (how,), 0), ((x[240:],), (how,), 0)]))
    assert (rate, width) == (16_000, 16) and (got[:, 0] == x).all()


def test_constant_and_many_frames():
    x = np.full(16, -7)
    _, _, got = decode_flac(stream([((x,), (("constant",),), 0)] * 130))
    assert got.shape == (130 * 16, 1) and (got == -7).all()


def test_joint_channels():
    a, b = tone(seed=1), tone(seed=2)
    v = ("verbatim",)
    for layout, sides in ((1, (a, b)), (8, (a, a - b)), (9, (a - b, b)), (10, ((a + b) >> 1, a - b))):
        _, _, got = decode_flac(stream([(sides, (v, v), layout)], channels=2))
        assert (got == np.stack([a, b], axis=1)).all(), layout


def test_broken_streams():
    whole = stream([((tone(),), (("fixed", 2, 1, 0),), 0)])
    for bad in (whole[:-20], whole[:60], whole[:30], b"fLaC", b"fLaX" + whole[4:], whole[:50] + b"\0\0" + whole[52:], stream([((tone(),), (("verbatim",),), 0)], total=999)):
        with pytest.raises((EOFError, ValueError, IndexError)):
            decode_flac(bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.flac").write_bytes(stream([((tone(),), (("fixed", 2, 1, 0),), 0)]))
    (tmp_path / "cut.flac").write_bytes((tmp_path / "a.flac").read_bytes()[:-30])
    got = {r["key"]: r for r in audio.load(spark.createDataFrame([(n, str(tmp_path / f"{n}.flac")) for n in ("a", "cut")], "key string, path string")).collect()}
    assert got["a"]["rate"] == 16_000 and got["a"]["samples"] == pytest.approx((tone() / 32767).tolist())
    assert got["cut"]["samples"] is None and got["cut"]["error"]
