"""Measures against plain loops over their published steps, and the queries that apply them against the measures."""

import math

import numpy as np
import pytest

from scorelake.functions import edit, signal
from scorelake.operators import corpus, pairing, scores, wer
from scorelake.plans import catalog

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(3)
    t = np.arange(16_000) / 16_000
    ref = np.sin(2 * np.pi * 440 * t) * (1 + 0.5 * np.sin(2 * np.pi * 4 * t)) + 0.2 * rng.normal(size=len(t)) * (np.sin(2 * np.pi * 3 * t) > 0)
    ref[6000:9000] *= 0.1
    return ref + 0.3 * rng.normal(size=len(t)), ref


@pytest.fixture(scope="module")
def long_signals(spark):
    """{key: (estimate, reference)} of the queries' stand-ins."""
    rows = catalog._longer(spark, TABLES).collect()
    return {r["key"]: (np.array(r["samples"]), np.array(r["ref_samples"])) for r in rows if r["key"] % 100 == 7}


def rows_of(spark, name):
    return {r["key"]: r for r in catalog.queries()[name](spark, TABLES).collect()}


# --- alignment -------------------------------------------------------------------------------


def plain_dtw(x, y, frame):
    n, m = len(x), len(y)
    t = [[math.inf] * (m + 1) for _ in range(n + 1)]
    t[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = frame(x[i - 1], y[j - 1]) + min(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1])
    i, j, steps = n, m, 0
    while i > 0 and j > 0:
        steps += 1
        least = min(t[i - 1][j - 1], t[i - 1][j], t[i][j - 1])
        if t[i - 1][j - 1] == least:
            i, j = i - 1, j - 1
        elif t[i - 1][j] == least:
            i -= 1
        else:
            j -= 1
    return t[n][m], steps


cosine = lambda a, b: 1 - float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-10)


def test_dtw_query(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in catalog.table(spark, TABLES, "embeddings").collect()}
    got = rows_of(spark, "dtw_alignment")
    assert len(got) == len(vectors)
    for key, v in vectors.items():
        cost, steps = plain_dtw(v.reshape(16, 4), v[::-1].reshape(16, 4), cosine)
        assert got[key]["distance"] == pytest.approx(cost / steps * 100, rel=1e-6), key


def test_chroma_query(spark, pair, long_signals):
    want = signal.chroma_distances(*pair, 16_000)
    for name, make, frame in (("stft_cosine", signal.chroma, cosine), ("cqt_euclidean", signal.chroma_cqt, lambda p, q: float(np.linalg.norm(p - q)))):
        cost, steps = plain_dtw(make(pair[0], 16_000), make(pair[1], 16_000), frame)
        assert want[f"chroma_{name}_dtw"] == pytest.approx(cost / steps * 100, rel=1e-6)
        if name == "stft_cosine":
            assert want["chroma_stft_cosine_dtw_raw"] == pytest.approx(cost / steps * 1000, rel=1e-6)
            assert want["chroma_stft_cosine_dtw_log"] == pytest.approx(-10 * math.log10(cost / steps + 1e-10), rel=1e-6)
    got = rows_of(spark, "chroma_alignment")
    assert len(got) == 500
    for key, (est, ref) in long_signals.items():
        want = signal.chroma_distances(est, ref, 16_000)
        assert {n: got[key][n] for n in want} == pytest.approx(want)


def test_subsequence_cost_is_the_cheapest_of_all_paths():
    rng = np.random.default_rng(1)
    part, whole = rng.normal(size=(3, 2)), rng.normal(size=(7, 2))
    d = np.linalg.norm(part[:, None] - whole[None], axis=2)

    def best(i, j):
        if i < 0 or j < 0:
            return math.inf
        ways = [best(i - r, j - c) for r, c in ((1, 0), (0, 3), (1, 3))]
        return d[i, j] + (0 if i == 0 else min(ways)) if i else d[0, j] + min(0.0, best(0, j - 3))

    assert signal.subsequence_cost(part, whole) == pytest.approx(min(best(2, j) for j in range(7)) / 3)


def test_warped_vocoder_frames():
    rng = np.random.default_rng(2)
    frames, f0, power = rng.normal(size=(30, 5)), np.where(np.arange(30) % 3, 100.0 + np.arange(30), 0), np.zeros(30)
    slow = np.repeat(np.arange(30), 2)
    assert signal.mcd_f0_warped(frames, f0, power, frames[slow], f0[slow], power[slow]) == pytest.approx([0, 0, 1], abs=1e-6)
    assert math.isnan(signal.mcd_f0_warped(frames, f0 * 0, power, frames, f0, power)[1])


# --- speech measures -------------------------------------------------------------------------


def test_resampling_is_zero_stuffing_and_filtering():
    rng = np.random.default_rng(4)
    for n, rate, target in ((300, 16_000, 10_000), (211, 44_100, 16_000), (90, 8000, 16_000), (5, 16_000, 32), (64, 64, 32)):
        x = rng.normal(size=n)
        g = math.gcd(rate, target)
        up, down = target // g, rate // g
        half = 10 * max(up, down)
        k = np.arange(-half, half + 1)
        taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        stuffed = np.zeros(n * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, taps * up / taps.sum())[half:][: n * up : down][: -(-n * up // down)]
        got = signal.resample(x, rate, target)
        assert np.allclose(got[: len(want)], want, atol=1e-9) and len(got) == -(-n * up // down)


def test_distortion_ratios_by_least_squares(spark, long_signals):
    rng = np.random.default_rng(5)
    ref, est = rng.normal(size=400), rng.normal(size=400)
    est += np.convolve(ref, [0.5, -0.2, 0.1])[:400]
    shifted = np.stack([np.concatenate([np.zeros(k), ref, np.zeros(7 - k)]) for k in range(8)], axis=1)
    padded = np.concatenate([est, np.zeros(7)])
    target = shifted @ np.linalg.lstsq(shifted, padded, rcond=None)[0]
    want = 10 * np.log10((target**2).sum() / ((padded - target) ** 2).sum())
    assert signal.ci_sdr(est, ref, 8) == pytest.approx(want, abs=1e-4)
    got = rows_of(spark, "signal_metrics")
    for key, (e, r) in long_signals.items():
        assert got[key]["sdr"] == got[key]["sar"] == got[key]["ci_sdr"] == pytest.approx(signal.ci_sdr(e, r)) and got[key]["sir"] == math.inf
        e, r = e - e.mean(), r - r.mean()
        t = (e @ r) / (r @ r) * r
        assert got[key]["si_snr"] == pytest.approx(10 * math.log10((t @ t) / ((e - t) @ (e - t))), abs=1e-6)


def plain_stoi(x, y, extended):
    size, hop = 256, 128
    w = np.hanning(258)[1:-1]
    kept = []
    cuts = [(x[i : i + size] * w, y[i : i + size] * w) for i in range(0, len(x) - size + 1, hop)]
    loudest = max(20 * math.log10(np.linalg.norm(a) + signal.EPS) for a, _ in cuts)
    kept = [(a, b) for a, b in cuts if 20 * math.log10(np.linalg.norm(a) + signal.EPS) > loudest - 40]
    joined = [np.zeros((len(kept) - 1) * hop + size) for _ in range(2)]
    for n, one in enumerate(kept):
        for side in range(2):
            joined[side][n * hop : n * hop + size] += one[side]
    f = np.arange(257) * 10_000 / 512
    bands = []
    for k in range(15):
        lo, hi = (int(np.argmin((f - 150 * 2 ** ((2 * k + d) / 6)) ** 2)) for d in (-1, 1))
        bands.append((lo, hi))
    sides = []
    for s in joined:
        spectra = [np.abs(np.fft.rfft(s[i : i + size] * w, 512)) ** 2 for i in range(0, len(s) - size + 1, hop)]
        sides.append(np.array([[math.sqrt(p[lo:hi].sum()) for p in spectra] for lo, hi in bands]))
    a, b = sides
    total, count = 0.0, 0
    for m in range(a.shape[1] - 29):
        p, q = a[:, m : m + 30], b[:, m : m + 30]
        unit = lambda v: (v - v.mean()) / (np.linalg.norm(v - v.mean()) + signal.EPS)
        if extended:
            p, q = (np.array([unit(r) for r in v]) for v in (p, q))
            p, q = (np.array([unit(c) for c in v.T]) for v in (p, q))
            total, count = total + (p * q).sum() / 30, count + 1
            continue
        for r in range(15):
            scaled = q[r] * np.linalg.norm(p[r]) / (np.linalg.norm(q[r]) + signal.EPS)
            total, count = total + unit(p[r]) @ unit(np.minimum(scaled, p[r] * (1 + 10 ** (15 / 20)))), count + 1
    return total / count


def test_intelligibility(spark, pair, long_signals):
    est, ref = (signal.resample(x, 16_000, 10_000) for x in pair)
    for extended in (False, True):
        assert signal.stoi(*pair, 16_000, extended) == pytest.approx(plain_stoi(ref, est, extended), rel=1e-6)
    got = rows_of(spark, "intelligibility")
    for key, (e, r) in long_signals.items():
        e, r = signal.resample(e, 16_000, 10_000), signal.resample(r, 16_000, 10_000)
        assert got[key]["stoi"] == pytest.approx(plain_stoi(r, e, False), rel=1e-6)
        assert got[key]["estoi"] == pytest.approx(plain_stoi(r, e, True), rel=1e-6)


def plain_ncm(est, ref, rate):
    """With the filters as recursions, the envelopes by the definition of the analytic signal."""
    place = lambda f: 35 / 2.1 * math.log10(f / 165 + 1)
    step = (place(rate / 2 - 600) - place(300)) / 20
    edges = [165 * (10 ** (2.1 * (place(300) + k * step) / 35) - 1) for k in range(21)]
    f = [150, 250, 350, 450, 570, 700, 840, 1000, 1170, 1370, 1600, 1850, 2150, 2500, 2900, 3400, 4000, 4800, 5800, 7000, 8500]
    importance = [0.0192, 0.0312, 0.0926, 0.1031, 0.0735, 0.0611, 0.0495, 0.044, 0.044, 0.049, 0.0486, 0.0493, 0.049, 0.0547, 0.0555, 0.0493, 0.0359, 0.0387, 0.0256, 0.0219, 0.0043]
    top = low = 0.0
    for lo, hi in zip(edges, edges[1:]):
        warp = [2 * rate * math.tan(math.pi * e / rate) for e in (lo, hi)]
        width, middle = warp[1] - warp[0], warp[0] * warp[1]
        poles = []
        for k in range(4):
            p = np.exp(1j * math.pi * (2 * k + 5) / 8) * width / 2
            root = np.sqrt(p**2 - middle + 0j)
            poles += [p + root, p - root]
        digital = [(2 * rate + p) / (2 * rate - p) for p in poles]
        gain = width**4 * np.prod([2 * rate] * 4) / np.prod([2 * rate - p for p in poles])
        b, a = np.real(gain * np.poly([1] * 4 + [-1] * 4)), np.real(np.poly(digital))
        both = []
        for x in (ref, est):
            y = np.zeros(len(x))
            for i in range(len(x)):
                y[i] = sum(b[k] * x[i - k] for k in range(min(i, 8) + 1)) - sum(a[k] * y[i - k] for k in range(1, min(i, 8) + 1))
            spectrum = np.fft.fft(y)
            n = len(y)
            spectrum[1 : (n + 1) // 2] *= 2
            spectrum[n // 2 + 1 :] = 0
            envelope = signal.resample(np.abs(np.fft.ifft(spectrum)), rate, 32)
            both.append(envelope - envelope.mean())
        r2 = (both[0] @ both[1]) ** 2 / ((both[0] @ both[0]) * (both[1] @ both[1]))
        snr = min(15, max(-15, 10 * math.log10((r2 + 1e-20) / (1 - r2 + 1e-20))))
        weight = np.interp((lo + hi) / 2, f, importance)
        top, low = top + weight * (snr + 15) / 30, low + weight
    return top / low


def test_normalised_covariance(pair):
    est, ref = (signal.resample(x, 16_000, 8000)[:2500] for x in pair)
    assert signal.ncm(est, ref, 8000) == pytest.approx(plain_ncm(est, ref, 8000), abs=1e-5)
    with pytest.raises(ValueError):
        signal.ncm(est, ref, 11_025)


def plain_csii(est, ref, rate):
    size, hop = round(0.03 * rate), int(0.25 * 0.03 * rate)
    count = int(len(ref) / hop - size / hop)
    fft = 2 ** math.ceil(math.log2(2 * size))
    window = [0.5 * (1 - math.cos(2 * math.pi * k / (size + 1))) for k in range(1, size + 1)]
    centre = [150, 250, 350, 450, 570, 700, 840, 1000, 1170, 1370, 1600, 1850, 2150, 2500, 2900, 3400]
    width = [100, 100, 100, 110, 120, 140, 150, 160, 190, 210, 240, 280, 320, 380, 450, 550]
    weight = [0.0192, 0.0312, 0.0926, 0.1031, 0.0735, 0.0611, 0.0495, 0.044, 0.044, 0.049, 0.0486, 0.0493, 0.049, 0.0547, 0.0555, 0.0493]
    groups = {"high": [], "mid": [], "low": []}
    for n in range(count):
        a, b = ref[n * hop : n * hop + size], est[n * hop : n * hop + size]
        level = 20 * math.log10(math.sqrt((a**2).mean()) / math.sqrt((ref**2).mean()))
        groups["high" if level >= 0 else "mid" if level >= -10 else "low"].append((np.fft.fft(a * window, fft)[: fft // 2], np.fft.fft(b * window, fft)[: fft // 2]))
    out = []
    for frames in groups.values():
        if not frames:
            out.append(math.nan)
            continue
        coherence = []
        for j in range(fft // 2):
            cross = sum(a[j] * b[j].conjugate() for a, b in frames)
            coherence.append(abs(cross) ** 2 / (sum(abs(a[j]) ** 2 for a, _ in frames) * sum(abs(b[j]) ** 2 for _, b in frames)))
        values = []
        for _, b in frames:
            heard = 0.0
            for c, w, v in zip(centre, width, weight):
                z = 4 * c / w * np.abs(1 - np.arange(fft // 2) * rate / fft / c)
                shape = (1 + z) * np.exp(-z)
                power, part = np.abs(b) ** 2, np.array(coherence)
                ratio = 10 * math.log10((shape * power * part).sum() / (shape * power * (1 - part)).sum())
                heard += v * (min(15, max(-15, ratio)) + 15) / 30
            values.append(heard / sum(weight))
        out.append(np.mean(values))
    return out


def test_coherence_index(pair):
    assert signal.csii(*pair, 16_000) == pytest.approx(plain_csii(*pair, 16_000), rel=1e-6)
    high, mid, low = signal.csii(np.ones(4000) + pair[0][:4000], np.ones(4000) * 3 + pair[1][:4000], 16_000)
    assert math.isnan(low) and 0 <= mid <= 1 and 0 <= high <= 1


def test_enhancement_query(spark, pair, long_signals):
    est, ref = pair
    size, hop, p = 480, 120, 16
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(1, size + 1) / (size + 1)))
    ratios, cepstra, slope = [], [], []
    for i in range(0, len(ref) - size + 1, hop):
        lpc = []
        for x in (ref, est):
            f = x[i : i + size] * window
            r = np.array([f[: size - k] @ f[k:] for k in range(p + 1)])
            gram = np.array([[r[abs(j - k)] for k in range(p)] for j in range(p)])
            lpc.append((np.concatenate([[1], -np.linalg.solve(gram, r[1:])]), np.array([[r[abs(j - k)] for k in range(p + 1)] for j in range(p + 1)])))
        (a, gram), (b, _) = lpc
        ratios.append(math.log((b @ gram @ b) / (a @ gram @ a)))
        c = []
        for v in (a, b):
            one = [0.0] * (p + 1)
            for n in range(1, p + 1):
                one[n] = -v[n] - sum(k / n * one[k] * v[n - k] for k in range(1, n))
            c.append(np.array(one[1:]))
        cepstra.append(min(10, 10 / math.log(10) * math.sqrt(2 * ((c[0] - c[1]) ** 2).sum())))
        f, g = ref[i : i + size] * window, est[i : i + size] * window
        slope.append(min(35, max(-10, 10 * math.log10((f @ f) / ((f - g) @ (f - g))))))
    share = round(len(ratios) * 0.95)
    assert signal.llr(est, ref, 16_000) == pytest.approx(np.mean(sorted(min(2, x) for x in ratios)[:share]), rel=1e-5)
    assert signal.llr(est, ref, 16_000, cut=False) == pytest.approx(np.mean(sorted(ratios)[:share]), rel=1e-4)
    assert signal.cepstral_distance(est, ref, 16_000) == pytest.approx(np.mean(sorted(cepstra)[:share]), rel=1e-5)
    assert signal.segmental_snr(est, ref, 16_000) == pytest.approx(np.mean(slope), rel=1e-6)
    assert signal.wss(ref, ref, 16_000) == 0 and signal.wss(est, ref, 16_000) > 1
    got = rows_of(spark, "enhancement_metrics")
    for key, (e, r) in long_signals.items():
        assert got[key]["error"] is None
        assert got[key]["pysepm_llr"] == pytest.approx(signal.llr(e, r, 16_000)) and got[key]["pysepm_ncm"] == pytest.approx(signal.ncm(e, r, 16_000))
        assert got[key]["pysepm_fwsegsnr"] == pytest.approx(signal.fwsegsnr(e, r, 16_000)) and got[key]["pysepm_wss"] == pytest.approx(signal.wss(e, r, 16_000))


def test_reverberation_and_warping_grow_with_the_distortion(pair):
    est, ref = pair
    rng = np.random.default_rng(6)
    tail = rng.normal(size=6000) * np.exp(-np.arange(6000) / 1500)
    wet = np.convolve(ref, tail)[: len(ref)]
    assert signal.srmr(ref, 16_000) > signal.srmr(wet, 16_000) > 0
    assert signal.warpq(ref + 0.05 * (est - ref), ref, 16_000) < signal.warpq(est, ref, 16_000)
    for f in (lambda: signal.srmr(ref[:100], 16_000), lambda: signal.warpq(ref[:20], ref, 16_000), lambda: signal.csii(ref[:90], ref[:90], 16_000)):
        with pytest.raises(ValueError):
            f()


def test_a_signal_that_cant_be_scored_says_why(spark):
    rows = [("a", 16_000, [0.0, 1.0], [1.0, 0.0]), ("b", None, [1.0], [1.0]), ("c", 16_000, None, [1.0])]
    df = spark.createDataFrame(rows, "key string, rate int, samples array<double>, ref_samples array<double>")
    got = df.select(signal.intelligibility("samples", "ref_samples", "rate").alias("m")).collect()
    assert [r["m"]["stoi"] for r in got] == [None] * 3 and [r["m"]["error"] for r in got] == ["ValueError: too short", "ValueError: an input is null", "ValueError: an input is null"]


# --- corpora and tables ----------------------------------------------------------------------


def test_frechet_query(spark):
    rows = catalog.table(spark, TABLES, "embeddings").collect()
    a, b = (np.array([r["embedding"] for r in rows if (r["label"] < 5) == side], float) for side in (True, False))

    def distance(x, y):
        c1, c2 = np.cov(x.T), np.cov(y.T)
        roots = np.sqrt(np.maximum(np.linalg.eigvals(c1 @ c2).real, 0)).sum()
        return ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * roots

    e = catalog.table(spark, TABLES, "embeddings")
    got = catalog.queries()["frechet_distance"](spark, TABLES).first()
    assert got["fad_overall"] == pytest.approx(distance(a, b), rel=1e-6)
    import pyspark.sql.functions as F

    places = {r["vec_id"]: r["h"] for r in e.select("vec_id", F.pmod(F.xxhash64(F.col("embedding").cast("array<double>")), F.lit(1_000_000)).alias("h")).collect()}
    thin = [np.array([r["embedding"] for r in rows if r["label"] >= 5 and places[r["vec_id"]] < int((0.5 + 0.5 * (k + 1) / 15) * 1_000_000)], float) for k in range(15)]
    x, y = [1 / len(t) for t in thin], [distance(a, t) for t in thin]
    slope, cut = np.polyfit(x, y, 1)
    fit = slope * np.array(x) + cut
    assert corpus.fad(e.filter("label < 5"), e.filter("label >= 5"), 64, infinite=True)["fad_overall"] == pytest.approx(cut, rel=1e-6)
    assert got["fad_r2"] == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - np.mean(y)) ** 2).sum(), abs=1e-5)


def test_kernel_distance_by_moments_is_that_by_pairs(spark):
    rng = np.random.default_rng(7)
    side = lambda n, shift: spark.createDataFrame([(i, (rng.normal(size=3) + shift).tolist()) for i in range(n)], "key int, embedding array<double>")
    a, b = side(40, 0.0), side(25, 0.5)
    assert corpus.kernel_distance(a, b, 3).first()[0] == pytest.approx(corpus._kernel_by_pairs(a, b, 3, "key", "embedding").first()[0])
    assert corpus.kernel_distance(a.limit(1), b, 3).first()[0] is None
    assert corpus.kernel_distance(a.limit(0), b, 3).first()[0] is None


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=999).tolist(), "b": [1.0] * 500 + [2.0, 3.0], "c": [5.0], "d": [], "e": [0.0, -0.0, 4.0]}
    rows = [(m, v) for m, vs in data.items() for v in vs] + [("a", math.inf), ("a", math.nan), ("a", None), ("d", math.nan), (None, 1.0), (None, 3.0)]
    got = {r["metric"]: r["q"] for r in scores.quantiles(spark.createDataFrame(rows, "metric string, value double"), [0.0, 0.1, 0.5, 1.0]).collect()}
    for m, vs in data.items():
        assert (m in got) == bool(vs)
        if vs:
            assert got[m] == pytest.approx(np.quantile(vs, [0.0, 0.1, 0.5, 1.0]).tolist()), m
    assert got[None][2] == 2.0
    assert scores.quantiles(spark.createDataFrame([], "metric string, value double"), [0.5]).count() == 0


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "n int, ord_of string").repartition(5)
    got = pairing.numbered(df, "n").collect()
    assert sorted((r["n"], r["ord"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert pairing.numbered(df.limit(0), "n").count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_error_counts_of_turns(spark):
    for r in wer.count_errors(catalog.turns(spark, TABLES)).collect():
        for kind, split in (("wer", str.split), ("cer", lambda t: list(t.strip(" ")))):
            ref, hyp = split(r["ref_text"]), split(r["hyp_text"])
            d, i, s, e = (r[f"whisper_{kind}_{p}"] for p in wer.PARTS)
            assert (d + s + e, i + s + e) == (len(ref), len(hyp))
            if kind == "wer":
                assert d + i + s == plain_distance(ref, hyp)


def test_long_pairs_are_split_and_stay_cheapest(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(edit, "TRACE_BITS", 64)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(2))
        d, i, s, e = edit.edit_counts(a, b)
        assert d + i + s == plain_distance(a, b) and d + s + e == len(a) and i + s + e == len(b) and min(d, i, s, e) >= 0
