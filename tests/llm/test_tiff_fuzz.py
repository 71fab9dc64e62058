"""TIFF files damaged at random: never a failed job, pages before the damage whole."""

import numpy as np
import pytest

from scorelake.llm import tiff


def sample(seed):
    rng = np.random.default_rng(seed)
    kinds = [(c, p, b) for c in (1, 5, 8, 32773) for p in (1, 2) for b in ({"tile": 16}, {"rows": 3}, {})]
    pages = [{"pixels": rng.integers(0, 250, (9, 11)).astype([np.uint8, np.dtype("<u2")][seed % 2]), "compression": c, "predictor": p, **b} for c, p, b in [kinds[int(k)] for k in rng.integers(0, len(kinds), 3)]]
    return [p["pixels"] for p in pages], tiff.encode(pages)


def damaged(seed):
    rng = np.random.default_rng(seed)
    _, data = sample(seed % 40)
    data = bytearray(data)
    how = seed % 4
    if how == 0:
        return bytes(data[: int(rng.integers(0, len(data)))])
    for _ in range(int(rng.integers(1, 6))):
        at = int(rng.integers(0, len(data)))
        if how == 1:
            data[at] ^= 1 << int(rng.integers(0, 8))
        elif how == 2:
            data[at] = int(rng.integers(0, 256))
        else:
            data[at : at + 4] = bytes([0, 255, 0, 255][int(rng.integers(0, 4)) :][:1]) * len(data[at : at + 4])
    return bytes(data)


def test_damaged_files_give_rows(spark):
    df = spark.createDataFrame([(i, bytearray(damaged(i))) for i in range(1200)], "key long, data binary").repartition(8)
    got = tiff.pages(df, "key", "data").collect()
    assert {r["key"] for r in got} <= set(range(1200))
    for r in got:
        assert (r["error"] is None) == (r["pixels"] is not None)
        if r["error"] is None:
            assert len(r["pixels"]) == r["width"] * r["height"] * r["samples"]
    assert len({r["key"] for r in got}) > 1150  # a chain whose first offset became 0 has no page
    assert 0.2 < np.mean([r["error"] is None for r in got]) < 0.95


def test_pages_before_a_cut_are_whole(spark):
    rows, want = [], {}
    for seed in range(60):
        pixels, data = sample(seed % 40)
        cut = int(np.random.default_rng(seed).integers(8, len(data)))
        rows.append((seed, bytearray(data[:cut])))
        order, chain = tiff.directories(data)
        tags = list(chain)
        reach = []
        for t in tags:
            blocks = zip(t.get(324, t.get(273)), t.get(325, t.get(279)))
            reach.append(max(a + n for a, n in blocks))
        want[seed] = (pixels, reach, cut)
    got = {}
    for r in tiff.pages(spark.createDataFrame(rows, "key long, data binary"), "key", "data").collect():
        got.setdefault(r["key"], {})[r["page"]] = r
    for seed, (pixels, reach, cut) in want.items():
        for n, x in enumerate(pixels):
            r = got.get(seed, {}).get(n)
            if r is not None and r["error"] is None:
                assert r["pixels"] == x.astype(float).reshape(-1).tolist()
            if n + 1 < len(pixels) and cut > reach[n + 1]:  # the next page's blocks lie behind this one's directory
                assert r is not None and r["error"] is None, (seed, n)


@pytest.mark.parametrize("width,height", [(1 << 20, 1 << 20), (1 << 31, 1 << 31)])
def test_no_room_is_made_for_what_the_data_cant_hold(width, height):
    page = {256: (width,), 257: (height,), 258: (8,), 259: (8,), 273: (8,), 279: (4,), 278: (height,)}
    with pytest.raises(ValueError):
        tiff.page(b"II*\0" + bytes(100), "<", page)


def test_a_large_page_is_whole():
    x = np.arange(5000 * 4000, dtype=np.uint32).reshape(5000, 4000).astype(np.uint8)
    data = tiff.encode([{"pixels": x, "compression": 8, "rows": 1000}])
    order, chain = tiff.directories(data)
    about, got = tiff.page(data, order, next(chain))
    assert about["blocks"] == 5 and (got[:, :, 0] == x).all()
