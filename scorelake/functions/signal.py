"""Array signal processing in numpy, and the pandas UDFs that apply it.

The functions follow published definitions; each names its measure. UDFs isolate errors: a row
whose signal can't be scored has nulls, and the others go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = np.finfo(float).eps


def _pair(est, ref) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(est), len(ref))
    return np.asarray(est[:n], float), np.asarray(ref[:n], float)


def _fast(n: int) -> int:
    """The least length from ``n`` on with no other prime factors than 2, 3 and 5, which transforms are fast at."""
    return min(two << max(0, (-(-n // two) - 1).bit_length()) for k in range(16) for j in range(16) if (two := 3**k * 5**j) < 2 * max(n, 1))


@lru_cache(8)
def _taps(up: int, down: int) -> np.ndarray:
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / most) / most * np.kaiser(2 * half + 1, 5.0)
    return taps * (up / taps.sum())


#: Numbers of a matrix that resamples at once; longer signals go by pieces.
MOST_RESAMPLED = 1 << 18


@lru_cache(8)
def _resampling(count: int, up: int, down: int) -> np.ndarray:
    """Resampling of ``count`` samples as a matrix."""
    taps = _taps(up, down)
    at = np.arange(-(-count * up // down))[:, None] * down + len(taps) // 2 - up * np.arange(count)[None]
    return np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling with a Kaiser window (beta 5, 10 zero crossings a side); the same array for equal rates.

    Of an array of several columns each is a signal. Outputs of one phase share their taps, so each
    phase is one product of windows and taps.
    """
    x = np.asarray(x, float)
    if rate == target or not len(x):
        return x
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    n = -(-len(x) * up // down)
    if n * len(x) <= MOST_RESAMPLED:
        return _resampling(len(x), up, down) @ x
    taps = _taps(up, down)
    half = len(taps) // 2
    reach = 2 * half // up + 1
    last, phase = np.divmod(np.arange(min(n, up)) * down + half, up)
    end = ((n - 1) * down + half) // up
    padded = np.concatenate([np.zeros((reach, *x.shape[1:])), x, np.zeros((max(0, end - len(x) + 1), *x.shape[1:]))])
    out = np.zeros((n, *x.shape[1:]))
    for row in range(min(n, up)):  # every up-th output has the phase of this one and lies down samples on
        t = taps[phase[row] :: up][::-1]
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(t), axis=0)[last[row] + reach - len(t) + 1 :: down]
        for lo in range(0, len(range(row, n, up)), 1024):
            part = range(row, n, up)[lo : lo + 1024]
            out[part.start : part.stop : up] = np.tensordot(windows[lo : lo + len(part)], t, axes=(-1, 0))
    return out


def low_cut(x: np.ndarray, rate: int, cutoff: float = 70.0, taps: int = 255) -> np.ndarray:
    """High-pass FIR by a Hann-windowed sinc."""
    n = np.arange(taps) - (taps - 1) / 2
    h = -np.sinc(2 * cutoff / rate * n) * 2 * cutoff / rate * np.hanning(taps)
    h[(taps - 1) // 2] += 1.0
    return np.convolve(np.asarray(x, float), h)[: len(x)]


def si_snr(est, ref) -> float:
    e, t = _pair(est, ref)
    e, t = e - e.mean(), t - t.mean()
    scale = e @ t / max(t @ t, EPS)
    target = scale * t
    noise = e - target
    return float(10 * np.log10(max(target @ target, EPS) / max(noise @ noise, EPS)))


def _shift(a: np.ndarray, b: np.ndarray, size: int, back: bool = False) -> np.ndarray:
    """Products of the triangular Toeplitz matrices with first columns ``a``, or of their transposes, with ``b``; rows are systems."""
    f = np.fft.rfft(a, size)
    return np.fft.irfft((f.conj() if back else f) * np.fft.rfft(b, size), size)[:, : b.shape[1]]


def _toeplitz(auto: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric positive definite Toeplitz systems, a row each, from their first columns and right sides.

    Durbin's recursion over all rows at once gives the inverses (as products of triangular matrices),
    which are applied again to what is left until that is rounding. A row where it stays more goes through elimination.
    """
    n = auto.shape[1]
    size = _fast(2 * n - 1)
    with np.errstate(all="ignore"):
        backwards = np.ascontiguousarray(auto[:, ::-1])
        a, error = np.zeros_like(auto), auto[:, 0].copy()
        a[:, 0] = 1
        for i in range(1, n):
            k = -np.einsum("bi,bi->b", a[:, :i], backwards[:, n - 1 - i : n - 1]) / error
            a[:, 1 : i + 1] += k[:, None] * a[:, :i][:, ::-1]
            error *= 1 - k**2
        b = np.zeros_like(a)
        b[:, 1:] = a[:, :0:-1]
        inverse = lambda v: (_shift(a, _shift(a, v, size, True), size) - _shift(b, _shift(b, v, size, True), size)) / error[:, None]
        ring = np.zeros((len(auto), size))
        ring[:, :n] = auto
        ring[:, size - n + 1 :] = auto[:, :0:-1]
        ring = np.fft.rfft(ring)
        left = lambda x: right - np.fft.irfft(ring * np.fft.rfft(x, size), size)[:, :n]
        norm = lambda v: np.sqrt(np.einsum("bi,bi->b", v, v))
        x = inverse(right)
        for _ in range(3):
            x = x + inverse(left(x))
        bad = np.flatnonzero(~(norm(left(x)) <= 1e-13 * (auto[:, 0] * norm(x) + norm(right))) & np.isfinite(norm(auto) + norm(right)))
    idx = np.abs(np.arange(n)[:, None] - np.arange(n)[None])
    for i in bad:
        x[i] = np.linalg.solve(auto[i][idx], right[i])
    return x


def _ci_sdrs(est: np.ndarray, ref: np.ndarray, taps: int) -> np.ndarray:
    """``ci_sdr`` of rows of signals of one length: the least-squares filter of the reference with ``taps`` coefficients, as long as the sum of both."""
    n = ref.shape[1] + taps - 1
    size = _fast(n + taps - 1)
    rf, ef = np.fft.rfft(ref, size), np.fft.rfft(est, size)
    auto = np.fft.irfft(_power(rf), size)[:, :taps]
    cross = np.fft.irfft(rf.conj() * ef, size)[:, :taps]
    auto[:, 0] += 1e-10 * np.maximum(auto[:, 0], EPS)
    target = np.fft.irfft(np.fft.rfft(_toeplitz(auto, cross), size) * rf, size)[:, :n]
    noise = -target
    noise[:, : est.shape[1]] += est
    power = lambda v: np.maximum(np.einsum("bi,bi->b", v, v), EPS)
    return 10 * np.log10(power(target) / power(noise))


def ci_sdr(est, ref, taps: int = 512) -> float:
    """Signal-to-distortion ratio that allows any filter of ``taps`` coefficients."""
    e, t = _pair(est, ref)
    return float(_ci_sdrs(e[None], t[None], taps)[0])


def bss_eval(est, ref, taps: int = 512) -> tuple[float, float, float]:
    """(sdr, sir, sar) of one source: no other source interferes, so sir is infinite and sar equals sdr."""
    sdr = ci_sdr(est, ref, taps)
    return sdr, float("inf"), sdr


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


@lru_cache(8)
def _third_octaves(rate: int, fft: int, bands: int = 15, lowest: float = 150.0) -> np.ndarray:
    f = np.linspace(0, rate, fft + 1)[: fft // 2 + 1]
    k = np.arange(bands)
    low, high = lowest * 2.0 ** ((2 * k - 1) / 6), lowest * 2.0 ** ((2 * k + 1) / 6)
    out = np.zeros((bands, len(f)))
    for i in range(bands):
        a, b = int(np.argmin((f - low[i]) ** 2)), int(np.argmin((f - high[i]) ** 2))
        out[i, a:b] = 1
    return out


def stoi(est, ref, rate: int, extended: bool = False) -> float:
    """Short-time objective intelligibility (10 kHz, 256-sample frames, 15 third octaves, 30-frame segments)."""
    e, t = _pair(est, ref)
    return _stois(e, t, rate)[extended]


def _stois(est: np.ndarray, ref: np.ndarray, rate: int) -> list[float]:
    """[stoi, estoi] of signals of one length, from the same bands."""
    both = np.ascontiguousarray(resample(np.stack([ref, est], axis=1), rate, 10_000).T)
    size, hop, fft, span = 256, 128, 512, 30
    w = np.hanning(size + 2)[1:-1]
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, size, axis=1)[:, ::hop] * w
    if both.shape[1] < size:
        raise ValueError("too short")
    frames = cut(both)
    level = 20 * np.log10(np.linalg.norm(frames[0], axis=1) + EPS)
    frames = frames[:, level > level.max() - 40]
    # a frame is two hops, so the sum of overlapping frames is that of their halves
    joined = np.zeros((2, frames.shape[1] + 1, hop))
    joined[:, :-1] = frames[:, :, :hop]
    joined[:, 1:] += frames[:, :, hop:]
    bands = np.sqrt(_power(np.fft.rfft(cut(joined.reshape(2, -1)), fft)) @ _third_octaves(10_000, fft).T).transpose(0, 2, 1)
    if bands.shape[2] < span:
        return [1e-5, 1e-5]
    xs, ys = np.lib.stride_tricks.sliding_window_view(bands, span, axis=2).transpose(0, 2, 1, 3)

    def unit(v: np.ndarray, axis: int) -> np.ndarray:
        v = v - v.mean(axis=axis, keepdims=True)
        return v / (np.linalg.norm(v, axis=axis, keepdims=True) + EPS)

    ux = unit(xs, 2)
    scaled = ys * (np.linalg.norm(xs, axis=2, keepdims=True) / (np.linalg.norm(ys, axis=2, keepdims=True) + EPS))
    clipped = np.minimum(scaled, xs * (1 + 10 ** (15 / 20)))
    plain = float((ux * unit(clipped, 2)).sum() / (xs.shape[0] * xs.shape[1]))
    return [plain, float((unit(ux, 1) * unit(unit(ys, 2), 1)).sum() / (span * len(xs)))]


def dtw(x: np.ndarray, y: np.ndarray, metric: str = "cosine", scale: float = 100.0, by_path: bool = True) -> float:
    """Dynamic time warping of two frame sequences: the cost of the best path over its length, times ``scale``.

    Rows of the table are filled by anti-diagonals, whole diagonals at a time. The path goes back
    diagonally on ties, then by the first sequence.
    """
    x, y = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(y, float))
    return float(_dtws(x[None], y[None], metric, scale, by_path)[0])


def _dtws(x: np.ndarray, y: np.ndarray, metric: str, scale: float, by_path: bool = True) -> np.ndarray:
    """``dtw`` of many pairs of sequences (pairs x frames x features)."""
    inner = x @ y.transpose(0, 2, 1)
    if metric == "cosine":
        d = 1 - inner / np.maximum(np.linalg.norm(x, axis=2)[:, :, None] * np.linalg.norm(y, axis=2)[:, None], 1e-10)
    else:
        d = np.sqrt(np.maximum((x**2).sum(2)[:, :, None] + (y**2).sum(2)[:, None] - 2 * inner, 0))
    # pairs last, so that a diagonal is rows in one piece
    t = _table(np.ascontiguousarray(d.transpose(1, 2, 0)))
    steps = np.zeros(len(x), int)
    if by_path:
        pairs, i, j = np.arange(len(x)), np.full(len(x), d.shape[1]), np.full(len(x), d.shape[2])
        while len(on := np.flatnonzero((i > 0) & (j > 0))):
            a, b, p = i[on], j[on], pairs[on]
            steps[on] += 1
            diagonal, first, second = t[a - 1, b - 1, p], t[a - 1, b, p], t[a, b - 1, p]
            best = np.where(second < np.where(first < diagonal, first, diagonal), 2, np.where(first < diagonal, 1, 0))
            i[on] -= best < 2
            j[on] -= best != 1
    return t[-1, -1] / np.maximum(steps, 1) * scale


def _table(d: np.ndarray) -> np.ndarray:
    """Least costs of the paths through tables of distances (first x second x pairs), with an edge before each."""
    n, m = d.shape[:2]
    t = np.full((n + 1, m + 1, *d.shape[2:]), np.inf)
    t[0, 0] = 0
    for k in range(2, n + m + 1):
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        t[i, j] = d[i - 1, j - 1] + np.minimum(np.minimum(t[i - 1, j], t[i, j - 1]), t[i - 1, j - 1])
    return t


def _warped(d: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(cost, places in the first, in the second sequence) of the cheapest path through a table of distances."""
    n, m = d.shape
    t = _table(d)
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: t[p])  # the first of equals: the diagonal
    one, two = zip(*reversed(path)) if path else ((), ())
    return float(t[n, m]), np.array(one, int), np.array(two, int)


CHROMA_FEATURES, CHROMA_METRICS = ("stft", "cqt", "cens"), ("cosine", "euclidean")


def chroma(x: np.ndarray, rate: int, fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Twelve pitch classes a frame, from the power spectrum, each frame scaled to a maximum of 1."""
    x = np.pad(np.asarray(x, float), fft // 2)
    power = np.abs(np.fft.rfft(_frames(x, fft, hop) * np.hanning(fft), axis=1)) ** 2
    f = np.fft.rfftfreq(fft, 1 / rate)[1:]
    pitch = np.round(12 * np.log2(np.maximum(f, 1e-9) / 440.0) + 69).astype(int) % 12
    out = np.stack([power[:, 1:][:, (pitch == c) & (f >= 27.5)].sum(axis=1) for c in range(12)], axis=1)
    return out / np.maximum(out.max(axis=1, keepdims=True), 1e-10)


def constant_q(x: np.ndarray, rate: int, hop: int = 512, bins: int = 36, octaves: int = 7) -> np.ndarray:
    """Magnitudes as frames x bins from C1 (A4 at 440 Hz) on: Hann kernels of one quality, scaled by the root of their length.

    Kernels are their closed-form spectrum within 16 bins of their own resolution; bins beyond half the rate are left out.
    Of a matrix each row is a signal.
    """
    x = np.asarray(x, float)
    size = rate / (2 ** (1 / bins) - 1) / (440.0 * 2.0 ** (-45 / 12 + np.arange(bins * octaves) / bins))
    frames = 1 + x.shape[-1] // hop
    count = frames + -(-int(size[0]) // hop)
    n = count * hop
    spectrum = np.fft.fft(x, n)[..., : n // 2]
    out = np.zeros((*x.shape[:-1], frames, bins * octaves))
    for k, lo, kernel in _kernels(rate, n, bins, octaves):
        # every hop-th sample of the filtered signal: its spectrum folded to as many bins
        part = np.zeros((*x.shape[:-1], -(-(lo % count + len(kernel)) // count) * count), complex)
        part[..., lo % count : lo % count + len(kernel)] = spectrum[..., lo : lo + len(kernel)] * kernel
        out[..., k] = np.abs(np.fft.ifft(part.reshape(*x.shape[:-1], -1, count).sum(axis=-2)))[..., :frames] / hop * math.sqrt(size[k])
    return out


@lru_cache(8)
def _kernels(rate: int, n: int, bins: int, octaves: int) -> list[tuple[int, int, np.ndarray]]:
    """(bin, first place in a spectrum of ``n``, kernel) of the constant-Q bins under half the rate."""
    f = 440.0 * 2.0 ** (-45 / 12 + np.arange(bins * octaves) / bins)
    size = rate / (2 ** (1 / bins) - 1) / f
    out = []
    for k in np.flatnonzero(f < rate / 2):
        lo, hi = max(0, math.ceil((f[k] - 16 * rate / size[k]) * n / rate)), min(n // 2, math.floor((f[k] + 16 * rate / size[k]) * n / rate) + 1)
        g = (np.arange(lo, hi) * rate / n - f[k]) * size[k] / rate
        edge = np.abs(np.abs(g) - 1) < 1e-9
        out.append((int(k), lo, np.where(edge, 0.5, np.sinc(g) / np.where(edge, 1, 1 - g**2))))
    return out


def chroma_cqt(x: np.ndarray, rate: int, hop: int = 512, bins: int = 36) -> np.ndarray:
    """Twelve pitch classes a frame from C on, from constant-Q magnitudes, each frame scaled to a maximum of 1."""
    return _pitches(constant_q(x, rate, hop, bins), bins)


def _pitches(q: np.ndarray, bins: int = 36) -> np.ndarray:
    pitch = (np.arange(q.shape[1]) + bins // 24) // (bins // 12) % 12
    out = np.stack([q[:, pitch == c].sum(axis=1) for c in range(12)], axis=1)
    return out / np.maximum(out.max(axis=1, keepdims=True), 1e-10)


def chroma_cens(x: np.ndarray, rate: int, hop: int = 512, smooth: int = 41) -> np.ndarray:
    """Energy-normalised statistics: shares of constant-Q chroma in four steps, smoothed over frames by a Hann window, scaled to a maximum of 1."""
    return _cens(chroma_cqt(x, rate, hop), smooth)


def _cens(q: np.ndarray, smooth: int = 41) -> np.ndarray:
    share = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-10)
    steps = sum(0.25 * (share > t) for t in (0.4, 0.2, 0.1, 0.05))
    kernel = np.hanning(smooth + 2)
    pad = np.pad(steps, ((len(kernel) // 2, len(kernel) // 2), (0, 0)))
    out = np.stack([np.convolve(pad[:, c], kernel / kernel.sum(), "valid") for c in range(12)], axis=1)
    return out / np.maximum(out.max(axis=1, keepdims=True), 1e-10)


def chroma_fields(features=CHROMA_FEATURES, metrics=CHROMA_METRICS) -> list[str]:
    if not set(features) <= set(CHROMA_FEATURES) or not set(metrics) <= set(CHROMA_METRICS):
        raise ValueError(f"chroma features {list(features)} by {list(metrics)}: there are {CHROMA_FEATURES} by {CHROMA_METRICS}")
    return [*(f"chroma_{n}_{m}_dtw" for n in features for m in metrics), "chroma_stft_cosine_dtw_raw", "chroma_stft_cosine_dtw_log"]


def chroma_distances(est, ref, rate: int = 22_050, scale: float = 100.0, features=CHROMA_FEATURES, metrics=CHROMA_METRICS, by_path: bool = True) -> dict[str, float]:
    """DTW distances of chroma sequences under cosine and Euclidean frame distances, raw and in logarithm."""
    return dict(zip(chroma_fields(features, metrics), _chroma_distances([[est], [ref]], rate, scale, features, metrics, by_path)[0]))


def _chroma_distances(sides, rate: int, scale: float, features, metrics, by_path: bool) -> list[list[float]]:
    """Distances of many pairs, a pair a row of the two matrices of signals in ``sides``.

    Sequences of equal frames tie but for rounding, and the paths' lengths hang on ties: so what is
    done to a frame is done in the same order whether rows come alone or together.
    """
    made: dict[str, list[np.ndarray]] = {"stft": [np.stack([chroma(v, rate) for v in x]) for x in sides]}
    if set(features) & {"cqt", "cens"}:
        made["cqt"] = [np.stack([_pitches(q) for q in constant_q(x, rate)]) for x in sides]
    if "cens" in features:
        made["cens"] = [np.stack([_cens(q) for q in x]) for x in made["cqt"]]
    values = [_dtws(*made[name], metric, scale, by_path) for name in features for metric in metrics]
    base = _dtws(*made["stft"], "cosine", 1.0)
    return np.stack([*values, base * 1000.0, -10 * np.log10(base + 1e-10)], axis=1).tolist()


def alignment(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the frames that the cheapest warping pairs, by Euclidean distance, first to last."""
    return _warped(np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)))[1:]


def mcd_f0_warped(frames, f0, power, ref_frames, ref_f0, ref_power, threshold: float = -20.0) -> list[float]:
    """[mcd, f0rmse, f0corr] of a vocoder's frames: loud frames warped for the distortion, voiced ones for the pitch; NaN without a voiced frame."""
    a, b = frames[power > threshold], ref_frames[ref_power > threshold]
    if not len(a) or not len(b):
        raise ValueError("no loud frame")
    i, j = alignment(a, b)
    mcd = float((10 / np.log(10) * np.sqrt(2 * ((a[i] - b[j]) ** 2).sum(axis=1))).mean())
    va, vb = f0 > 0, ref_f0 > 0
    if not va.any() or not vb.any():
        return [mcd, math.nan, math.nan]
    i, j = alignment(frames[va], ref_frames[vb])
    p, q = f0[va][i], ref_f0[vb][j]
    return [mcd, float(np.sqrt(((p - q) ** 2).mean())), float(np.corrcoef(p, q)[0, 1]) if p.std() * q.std() else math.nan]


def warped_mcd_f0(threshold: float = -20.0) -> Callable[..., Column]:
    """A UDF of (mcep, f0, npow) of an item and of its reference."""
    schema = T.StructType([*(T.StructField(f, T.DoubleType()) for f in ("mcd", "f0rmse", "f0corr")), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(a, b, c, d, e, f):
            try:
                x = [np.stack([np.asarray(v, float) for v in part]) if k % 3 == 0 else np.asarray(part, float) for k, part in enumerate(row)]
                out.append([*mcd_f0_warped(*x, threshold), None])
            except UNFIT as why:
                out.append([None, None, None, f"{type(why).__name__}: {why}"])
        return pd.DataFrame(out, columns=["mcd", "f0rmse", "f0corr", "error"]).astype(dict.fromkeys(("mcd", "f0rmse", "f0corr"), float))

    return run


@lru_cache(8)
def _bark_bands(rate: int, fft: int) -> np.ndarray:
    """25 critical bands with Gaussian-shaped edges, as used by frequency-weighted measures."""
    centre = np.array([50, 120, 190, 260, 330, 400, 470, 540, 617.372, 703.378, 798.717, 904.128, 1020.38, 1148.3, 1288.72, 1442.54, 1610.7, 1794.16, 1993.93, 2211.08, 2446.71, 2701.97, 2978.04, 3276.17, 3597.63])
    width = np.array([70, 70, 70, 70, 70, 70, 70, 77.3724, 86.0056, 95.3398, 105.411, 116.256, 127.914, 140.423, 153.823, 168.154, 183.457, 199.776, 217.153, 235.631, 255.255, 276.072, 298.126, 321.465, 346.136])
    half = fft // 2
    j = np.arange(half)
    f0, bw = centre / (rate / 2) * half, width / (rate / 2) * half
    shape = np.exp(-11 * ((j[None] - np.floor(f0)[:, None]) / bw[:, None]) ** 2 + np.log(70.0) - np.log(width)[:, None])
    return shape * (shape > math.exp(-30 / (2 * 2.303)))


def _windowed(x: np.ndarray, rate: int, seconds: float, overlap: float) -> np.ndarray:
    size = int(round(seconds * rate))
    hop = max(1, int(size * (1 - overlap)))
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(1, size + 1) / (size + 1)))
    return _frames(x, size, hop) * w


def _spectra(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> np.ndarray:
    """Spectra of the windowed frames of the reference and of the estimate (2 x frames x bins)."""
    e, t = _pair(est, ref)
    frames = np.stack([_windowed(x, rate, seconds, overlap) for x in (t, e)])
    return np.fft.rfft(frames, 1 << (2 * frames.shape[2] - 1).bit_length())


def _power(spectra: np.ndarray) -> np.ndarray:
    return spectra.real**2 + spectra.imag**2


def fwsegsnr(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> float:
    """Frequency-weighted segmental SNR, frames cut to [-10, 35] dB."""
    return _fwsegsnr(_power(_spectra(est, ref, rate, seconds, overlap)), rate)


def _fwsegsnr(power: np.ndarray, rate: int) -> float:
    half = power.shape[2] - 1
    size = np.sqrt(power[:, :, :half])
    x, y = size @ _bark_bands(rate, 2 * half).T / np.maximum(size.sum(axis=2, keepdims=True), EPS)
    weight = x**0.2
    snr = 10 * np.log10(np.maximum(x**2, EPS) / np.maximum((x - y) ** 2, EPS))
    return float(np.clip((weight * snr).sum(axis=1) / np.maximum(weight.sum(axis=1), EPS), -10, 35).mean())


def _lpc(power: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with a leading 1, autocorrelations) of each frame's power spectrum, by Levinson-Durbin over all frames at once."""
    r = np.fft.irfft(power, 2 * (power.shape[1] - 1))[:, : order + 1]
    a = np.zeros((len(power), order + 1))
    a[:, 0] = 1
    error = r[:, 0] + EPS
    for i in range(1, order + 1):
        k = -(r[:, i] + (a[:, 1:i] * r[:, i - 1 : 0 : -1]).sum(axis=1)) / error
        new = a.copy()
        new[:, 1:i] += k[:, None] * a[:, i - 1 : 0 : -1]
        new[:, i] = k
        a, error = new, error * (1 - k**2) + EPS
    return a, r


def _predictors(power: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients of the reference, of the estimate, autocorrelations of the reference)."""
    n = power.shape[1]
    a, r = _lpc(power.reshape(2 * n, power.shape[2]), _order(rate))
    return a[:n], a[n:], r[:n]


def _lowest(value: np.ndarray) -> float:
    """Mean of the lowest 95 %."""
    return float(np.sort(value)[: max(1, round(len(value) * 0.95))].mean())


def _order(rate: int) -> int:
    return 10 if rate < 10_000 else 16


def llr(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75, cut: bool = True) -> float:
    """Log-likelihood ratio of linear prediction, mean of the lowest 95 % of frames, each cut at 2."""
    value = _likelihoods(*_predictors(_power(_spectra(est, ref, rate, seconds, overlap)), rate))
    return _lowest(np.minimum(value, 2.0) if cut else value)


def _likelihoods(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    p = a.shape[1] - 1
    gram = r[:, np.abs(np.arange(p + 1)[:, None] - np.arange(p + 1)[None])]
    top, low = np.einsum("ni,nij,nj->n", b, gram, b), np.einsum("ni,nij,nj->n", a, gram, a)
    return np.log(np.maximum(top, EPS) / np.maximum(low, EPS))


def wss(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> float:
    """Weighted spectral slope, mean of the lowest 95 % of frames."""
    return _wss(_power(_spectra(est, ref, rate, seconds, overlap)), rate)


def _wss(power: np.ndarray, rate: int) -> float:
    half = power.shape[2] - 1
    energy = 10 * np.log10(np.maximum(power[:, :, :half] @ _bark_bands(rate, 2 * half).T, 1e-10))
    slope = np.diff(energy)
    last, place = slope.shape[2], np.arange(slope.shape[2])
    # of a rise the peak is where it next falls, of a fall the band after the last rise
    falls = np.minimum.accumulate(np.where(slope <= 0, place, last)[:, :, ::-1], axis=2)[:, :, ::-1]
    rises = np.maximum.accumulate(np.where(slope > 0, place + 1, 0), axis=2)
    peak = np.take_along_axis(energy, np.where(slope > 0, falls, rises), axis=2)
    weight = (20 / (20 + energy.max(axis=2, keepdims=True) - energy[:, :, :-1])) * (1 / (1 + peak - energy[:, :, :-1]))
    w = (weight[0] + weight[1]) / 2
    return _lowest((w * (slope[0] - slope[1]) ** 2).sum(axis=1) / np.where(np.abs(w.sum(axis=1)) < EPS, EPS, w.sum(axis=1)))


def cepstral_distance(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> float:
    """Distance of linear-prediction cepstra in dB, frames cut to [0, 10], mean of the lowest 95 %."""
    return _cepstral_distance(*_predictors(_power(_spectra(est, ref, rate, seconds, overlap)), rate)[:2])


def _cepstral_distance(a: np.ndarray, b: np.ndarray) -> float:
    n, p = len(a), a.shape[1] - 1
    both = np.concatenate([a, b])
    c = np.zeros((2 * n, p + 1))
    for i in range(1, p + 1):
        c[:, i] = -both[:, i] - (np.arange(1, i) / i * c[:, 1:i] * both[:, i - 1 : 0 : -1]).sum(axis=1)
    d = c[:n, 1:] - c[n:, 1:]
    return _lowest(np.clip(10 / np.log(10) * np.sqrt(2 * (d**2).sum(axis=1)), 0, 10))


#: Centres and widths of the critical bands of the coherence index, and the importance of these and higher bands.
_CRITICAL = np.array([150, 250, 350, 450, 570, 700, 840, 1000, 1170, 1370, 1600, 1850, 2150, 2500, 2900, 3400], float)
_WIDTHS = np.array([100, 100, 100, 110, 120, 140, 150, 160, 190, 210, 240, 280, 320, 380, 450, 550], float)
_IMPORTANCE = np.array([192, 312, 926, 1031, 735, 611, 495, 440, 440, 490, 486, 493, 490, 547, 555, 493, 359, 387, 256, 219, 43]) / 1e4
_IMPORTANT = np.concatenate([_CRITICAL, [4000, 4800, 5800, 7000, 8500]])


def csii(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> tuple[float, float, float]:
    """Coherence speech intelligibility index (high, mid, low): coherence as the ratio of speech to distortion.

    A frame's group goes by its level without a window over that of the whole reference: at or over it
    high, down to 10 dB under it mid, the rest low. A group without a frame is NaN. Coherence is cut to
    [0, 1], which equal signals would leave by rounding.
    """
    return _csii(est, ref, rate, seconds, overlap)


@lru_cache(8)
def _roex(rate: int, fft: int) -> np.ndarray:
    """Critical bands of the coherence index as rounded exponentials (bins x bands)."""
    z = (4 * _CRITICAL / _WIDTHS)[:, None] * np.abs(1 - np.arange(fft // 2) * rate / fft / _CRITICAL[:, None])
    return ((1 + z) * np.exp(-z)).T


def _csii(est, ref, rate: int, seconds: float, overlap: float, spectra: np.ndarray | None = None) -> tuple[float, float, float]:
    """``spectra``: those of the same frames, where they are known."""
    e, t = _pair(est, ref)
    size, hop = round(seconds * rate), int((1 - overlap) * seconds * rate)
    count = int(len(t) / hop - size / hop)
    if count < 1:
        raise ValueError("too short")
    plain = _frames(t, size, hop)[:count]
    fft = 1 << math.ceil(math.log2(2 * size))
    if spectra is None or hop != max(1, int(size * (1 - overlap))):
        window = np.hanning(size + 2)[1:-1]
        spectra = np.stack([np.fft.rfft(_frames(f, size, hop)[:count] * window, fft) for f in (t, e)])
    x, y = spectra[:, :count, : fft // 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        level = 20 * np.log10(np.sqrt((plain**2).mean(axis=1)) / np.sqrt((t**2).mean()))
        shape = _roex(rate, fft)
        weight = _IMPORTANCE[: len(_CRITICAL)] / _IMPORTANCE[: len(_CRITICAL)].sum()
        out = []
        for group in (level >= 0, (level >= -10) & (level < 0), level < -10):
            a, b = x[group], y[group]
            both = np.abs((a * b.conj()).sum(axis=0)) ** 2
            power = _power(b)
            coherence = np.clip(both / (_power(a).sum(axis=0) * power.sum(axis=0)), 0, 1)
            ratio = 10 * np.log10((power * coherence) @ shape / ((power * (1 - coherence)) @ shape))
            heard = ((np.clip(ratio, -15, 15) + 15) / 30) @ weight
            out.append(float(heard.mean()) if len(heard) else math.nan)
    return out[0], out[1], out[2]


@lru_cache(8)
def butterworth(low: tuple[float, ...], high: tuple[float, ...], rate: int, size: int, order: int = 4) -> np.ndarray:
    """Frequency responses (bands x size / 2 + 1) of digital Butterworth band-pass filters, by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * np.asarray(f, float) / rate)
    lo, hi = warp(low)[:, None], warp(high)[:, None]
    z = np.exp(1j * 2 * np.pi * np.arange(size // 2 + 1) / size)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = 2 * rate * (z - 1) / (z + 1)
        p = (s**2 + lo * hi) / (s * (hi - lo))
        poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
        out = 1 / np.prod([p - q for q in poles], axis=0)
    out[~np.isfinite(out)] = 0
    return out


def _envelope(x: np.ndarray) -> np.ndarray:
    """Magnitudes of the analytic signals of the rows."""
    n = x.shape[1]
    turned = np.fft.rfft(x, axis=1) * -1j
    turned[:, 0] = 0
    if n % 2 == 0:
        turned[:, -1] = 0
    out = np.fft.irfft(turned, n, axis=1)
    out *= out
    out += x * x
    return np.sqrt(out, out=out)


def ncm(est, ref, rate: int, bands: int = 20, envelope: int = 32) -> float:
    """Normalised covariance: correlations of 20 band envelopes as ratios of speech to noise, by importance of the bands.

    Bands lie evenly along the basilar membrane from 300 Hz to 600 Hz under half the rate; signals pass
    Butterworth filters of order 4, their Hilbert envelopes are resampled to 32 Hz. There are 8 and 16 kHz only.
    """
    if rate not in (8000, 16_000):
        raise ValueError("the rate has to be 8 or 16 kHz")
    e, t = _pair(est, ref)
    place = lambda f: np.log10(f / 165 + 1)
    step = (place(rate / 2 - 600) - place(300)) / bands
    edges = 165 * (10 ** (place(300) + step * np.arange(bands + 1)) - 1)
    weight = np.interp((edges[:-1] + edges[1:]) / 2, _IMPORTANT, _IMPORTANCE)
    # half a second for the filters to die away, to 1e-13, so that the product of spectra is their convolution
    size = _fast(len(t) + rate // 2)
    response = butterworth(tuple(edges[:-1]), tuple(edges[1:]), rate, size)
    envelopes = []
    for x in (t, e):
        spectrum = np.fft.rfft(x, size)
        # a few bands at a time, which stay in the processor's cache
        parts = (np.fft.irfft(spectrum * response[lo : lo + 2], size, axis=1)[:, : len(t)] for lo in range(0, bands, 2))
        envelopes.append(np.concatenate([resample(_envelope(p).T, rate, envelope) for p in parts], axis=1))
    a, b = (v - v.mean(axis=0) for v in envelopes)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = (a * b).sum(axis=0) ** 2 / ((a**2).sum(axis=0) * (b**2).sum(axis=0))
        ratio = 10 * np.log10((r2 + 1e-20) / (1 - r2 + 1e-20))
    return float(((np.clip(ratio, -15, 15) + 15) / 30) @ weight / weight.sum())


def segmental_snr(est, ref, rate: int, seconds: float = 0.03, overlap: float = 0.75) -> float:
    """Segmental SNR, frames cut to [-10, 35] dB."""
    e, t = _pair(est, ref)
    a, b = _windowed(t, rate, seconds, overlap), _windowed(e, rate, seconds, overlap)
    snr = 10 * np.log10((a**2).sum(axis=1) / (((a - b) ** 2).sum(axis=1) + EPS) + EPS)
    return float(np.clip(snr, -10, 35).mean())


def composites(pesq: Column, likelihood: Column, slope: Column, snr: Column) -> dict[str, Column]:
    """Signal, background and overall quality from 1 to 5, as published; null without a PESQ score."""
    cut = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(5.0), c))
    known = lambda c: F.when(pesq.isNotNull() & slope.isNotNull(), cut(c))
    return {
        "pysepm_c_sig": known(3.093 - 1.029 * likelihood + 0.603 * pesq - 0.009 * slope),
        "pysepm_c_bak": known(1.634 + 0.478 * pesq - 0.007 * slope + 0.063 * snr),
        "pysepm_c_ovl": known(1.594 + 0.805 * pesq - 0.512 * likelihood - 0.007 * slope),
    }


def mel_cepstra(x: np.ndarray, rate: int, count: int = 13, top: float = 4000.0, size: int = 256, hop: int = 32, bands: int = 128, lifter: int = 3) -> np.ndarray:
    """Liftered mel-frequency cepstra, frames x coefficients: Slaney mel bands of equal area, decibels over the peak less 80, orthonormal cosine transform."""
    x = np.pad(np.asarray(x, float), size // 2)
    power = np.abs(np.fft.rfft(_frames(x, size, hop) * np.hanning(size + 1)[:-1])) ** 2
    mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) / np.log(6.4) * 27)
    hertz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edge = hertz(np.linspace(mel(np.array(0.0)), mel(np.array(float(top))), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    rise, fall = (f - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f) / np.diff(edge)[1:, None]
    shape = np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]
    level = 10 * np.log10(np.maximum(power @ shape.T, 1e-10))
    level = np.maximum(level, level.max(initial=-100) - 80)
    n = np.arange(bands)
    basis = np.cos(np.pi / bands * (n + 0.5)[None] * np.arange(count)[:, None]) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    lift = 1 + lifter / 2 * np.sin(np.pi * np.arange(1, count + 1) / lifter) if lifter else 1
    return level @ basis.T * lift


def _normalised(x: np.ndarray, width: int = 201) -> np.ndarray:
    """Each coefficient less its mean and over its deviation in a window of frames, ends mirrored."""
    half = width // 2
    mirrored = np.pad(x, ((half, half), (0, 0)), mode="symmetric" if len(x) >= half else "edge")
    centred = x - np.lib.stride_tricks.sliding_window_view(mirrored, width, axis=0).mean(axis=2)
    mirrored = np.pad(centred, ((half, half), (0, 0)), mode="symmetric" if len(x) >= half else "edge")
    return centred / (np.lib.stride_tricks.sliding_window_view(mirrored, width, axis=0).std(axis=2) + 2.0**-30)


def subsequence_cost(part: np.ndarray, whole: np.ndarray, steps: tuple[tuple[int, int], ...] = ((1, 0), (0, 3), (1, 3))) -> float:
    """Least cost at which warping by ``steps`` (frames of the part, of the whole) finds the part in the whole, a frame of the part."""
    d = np.sqrt(np.maximum((part**2).sum(1)[:, None] + (whole**2).sum(1)[None] - 2 * part @ whole.T, 0))
    n, m = d.shape
    t = np.full((n, m), np.inf)
    t[0] = d[0]
    across = max((c for r, c in steps if r == 0), default=0)
    for i in range(n):
        if i:
            best = np.full(m, np.inf)
            for r, c in steps:
                if 0 < r <= i:
                    best[c:] = np.minimum(best[c:], t[i - r, : m - c])
            t[i] = best + d[i]
            if across:
                for j in range(across, m):
                    t[i, j] = min(t[i, j], t[i, j - across] + d[i, j])
    return float(t[-1].min() / n)


def warpq(est, ref, rate: int, target: int = 8000, count: int = 13, top: float = 4000.0, patch: float = 0.5, steps=((1, 0), (0, 3), (1, 3))) -> float:
    """WARP-Q: median over half-overlapping patches of the estimate of their subsequence warping cost in the reference.

    Cepstra of 32 ms frames each 4 ms, mean and variance normalised in a sliding window. It follows the
    published description; no speech detection, no mapping to a rating.
    """
    e, t = resample(est, rate, target), resample(ref, rate, target)
    size, hop = int(0.032 * target), int(0.004 * target)
    a, b = (_normalised(mel_cepstra(x, target, count, top, size, hop)) for x in (e, t))
    wide = min(int(patch * target / hop), len(a))
    if wide < 2 or not len(b):
        raise ValueError("too short")
    costs = [subsequence_cost(a[lo : lo + wide], b, tuple(map(tuple, steps))) for lo in range(0, len(a) - wide + 1, max(1, wide // 2))]
    return float(np.median(costs))


def srmr(x, rate: int, channels: int = 23, lowest: float = 125.0, slow: float = 4.0, quick: float = 128.0) -> float:
    """Ratio of speech to reverberation modulation energy: four slow modulation bands over the quicker ones up to the auditory bandwidth.

    Gammatone filters at equal steps of auditory bandwidth, Hilbert envelopes, eight modulation bands
    of quality 2, energies in 256 ms windows each 64 ms. Filters are applied as spectra; it follows the
    published description.
    """
    x = np.asarray(x, float)
    if len(x) < int(0.256 * rate):
        raise ValueError("too short")
    ear, least = 9.26449, 24.7
    centre = -ear * least + np.exp(np.arange(1, channels + 1) * (np.log(lowest + ear * least) - np.log(rate / 2 + ear * least)) / channels) * (rate / 2 + ear * least)
    width = centre / ear + least
    size = 1 << (len(x) + rate).bit_length()
    f = np.fft.rfftfreq(size, 1 / rate)
    tone = 1 / (1 + 1j * (f[None] - centre[:, None]) / (1.019 * width[:, None])) ** 4
    band = np.fft.irfft(np.fft.rfft(x, size) * tone, size, axis=1)[:, : len(x)]
    envelope = _envelope(band)
    middle = slow * (quick / slow) ** (np.arange(8) / 7)
    w = np.tan(np.pi * middle / rate)
    z = np.exp(-2j * np.pi * f / rate)
    q = 2.0
    gain = w / q
    modulation = gain[:, None] * (1 - z**2) / ((1 + gain + w**2)[:, None] + (2 * w**2 - 2)[:, None] * z + (1 - gain + w**2)[:, None] * z**2)
    span, hop = int(np.ceil(0.256 * rate)), int(np.ceil(0.064 * rate))
    window = np.hanning(span + 2)[1:-1] ** 2
    energy = np.zeros((channels, 8))
    for c in range(channels):
        out = np.fft.irfft(np.fft.rfft(envelope[c], size) * modulation, size, axis=1)[:, : len(x)]
        frames = np.lib.stride_tricks.sliding_window_view(out**2, span, axis=1)[:, ::hop]
        energy[c] = (frames @ window).mean(axis=1)
    total = energy.sum()
    share = np.cumsum(energy.sum(axis=1)[::-1]) / total  # from the lowest channel up
    reach = width[::-1][int(np.argmax(share > 0.9))]
    edge = middle * (np.sqrt(1 + 1 / (2 * q) ** 2) - 1 / (2 * q))
    last = max(5, int((edge <= reach).sum()))
    return float(energy[:, :4].sum() / energy[:, 4:last].sum())


#: What a signal that can't be scored raises; anything else is a fault of the program.
UNFIT = (ValueError, TypeError, ArithmeticError, IndexError, np.linalg.LinAlgError)


#: Samples of a side that are scored together.
MOST_TOGETHER = 1 << 18


def _together(score: Callable, signals: list[list[np.ndarray]], rates: list[int], cut: bool = True) -> list:
    """Scores of pairs, those of one length and rate together, 32 at most at a time; in place of scores a row's error. With ``cut`` both sides of a pair are cut to the shorter."""
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (pair, rate) in enumerate(zip(signals, rates)):
        n, m = map(len, pair)
        groups.setdefault((min(n, m), min(n, m), rate) if cut else (n, m, rate), []).append(i)
    out: list = [None] * len(rates)
    for (*lengths, rate), places in groups.items():
        rows = max(1, min(32, MOST_TOGETHER // max(1, *lengths)))
        for lo in range(0, len(places), rows):
            todo = [places[lo : lo + rows]]
            while todo:
                some = todo.pop()
                try:
                    found = score(*(np.stack([signals[i][side][: lengths[side]] for i in some]) for side in (0, 1)), rate)
                except UNFIT as e:
                    found = [e] if len(some) == 1 else None
                    todo += [] if found else [[i] for i in some]
                for i, one in zip(some, found or ()):
                    out[i] = one
    return out


def _scored(fields: list[str], score: Callable, inputs: int = 2, together: bool = False, cut: bool = True) -> Callable[..., Column]:
    """A UDF of signals and their rate to a struct of scores; a row that can't be scored has nulls, and why in ``error``.

    With ``together`` the score takes the signals of many rows as two matrices, and returns a list a row.
    """
    schema = T.StructType([*(T.StructField(f, T.DoubleType()) for f in fields), T.StructField("error", T.StringType())])

    def failed(e: Exception) -> list:
        return [*[None] * len(fields), f"{type(e).__name__}: {e}"]

    def many(est: pd.Series, ref: pd.Series, rate: pd.Series) -> pd.DataFrame:
        fit = [i for i, x in enumerate(zip(est, ref, rate)) if not any(v is None for v in x[:2]) and not pd.isna(x[2])]
        out = [failed(ValueError("an input is null"))] * len(rate)
        pairs = [[np.asarray(x.iloc[i], float) for x in (est, ref)] for i in fit]
        for i, one in zip(fit, _together(score, pairs, [int(rate.iloc[i]) for i in fit], cut)):
            out[i] = failed(one) if isinstance(one, Exception) else [*one, None]
        return pd.DataFrame(out, columns=[*fields, "error"]).astype(dict.fromkeys(fields, float))

    def rows(*columns: pd.Series) -> pd.DataFrame:
        if together:
            return many(*columns)
        out = []
        for *signals, s in zip(*columns):
            try:
                if any(x is None for x in signals) or pd.isna(s):
                    raise ValueError("an input is null")
                out.append([*score(*(np.asarray(x, float) for x in signals), int(s)), None])
            except UNFIT as e:
                out.append(failed(e))
        return pd.DataFrame(out, columns=[*fields, "error"]).astype(dict.fromkeys(fields, float))

    if inputs == 1:

        @F.pandas_udf(schema)
        def alone(est: pd.Series, rate: pd.Series) -> pd.DataFrame:
            return rows(est, rate)

        return alone

    @F.pandas_udf(schema)
    def run(est: pd.Series, ref: pd.Series, rate: pd.Series) -> pd.DataFrame:
        return rows(est, ref, rate)

    return run


def _signals(e, r, s):
    sdr = _ci_sdrs(e, r, 512)
    return [[x, math.inf, x, si_snr(p, q), x] for x, p, q in zip(sdr.tolist(), e, r)]


def _sepm(e, r, s, seconds=0.03, overlap=0.75):
    """The last three are what composite measures join with a PESQ score: llr without its cut, wss and segmental SNR, at 8 or 16 kHz.

    Measures over the same frames share their spectra.
    """
    fit = s if s in (8000, 16_000) else 8000 if s < 16_000 else 16_000
    a, b = resample(e, s, fit), resample(r, s, fit)
    usual = _spectra(e, r, s)
    power = _power(usual)
    own, whole = power if (seconds, overlap) == (0.03, 0.75) else _power(_spectra(e, r, s, seconds, overlap)), power if fit == s else _power(_spectra(a, b, fit))
    usual_lpc = _predictors(power, s)
    ratio, ratio_whole = (_likelihoods(*(usual_lpc if p is power else _predictors(p, k))) for p, k in ((own, s), (whole, fit)))
    slope = _wss(own, s)
    return [_fwsegsnr(own, s), _lowest(np.minimum(ratio, 2.0)), slope, _cepstral_distance(*usual_lpc[:2]), *_csii(e, r, s, 0.03, 0.75, usual), ncm(a, b, fit), _lowest(ratio_whole), slope if whole is own else _wss(whole, fit), segmental_snr(a, b, fit)]


#: UDFs of (estimate, reference, rate) that return a struct of scores.
signal_metric = _scored(["sdr", "sir", "sar", "si_snr", "ci_sdr"], _signals, together=True)
intelligibility = _scored(["stoi", "estoi"], lambda e, r, s: _stois(*_pair(e, r), s))


def sepm_scores(seconds: float = 0.03, overlap: float = 0.75) -> Callable[..., Column]:
    """Frame length and overlap hold for fwsegsnr, llr and wss, as in the reference."""
    return _scored([*(f"pysepm_{k}" for k in ("fwsegsnr", "llr", "wss", "cd", "csii_high", "csii_mid", "csii_low", "ncm")), "llr_whole", "wss_whole", "snr_whole"], lambda e, r, s: _sepm(e, r, s, seconds, overlap))


def chroma_scores(scale: float = 100.0, features=CHROMA_FEATURES, metrics=CHROMA_METRICS, by_path: bool = True) -> Callable[..., Column]:
    return _scored(chroma_fields(features, metrics), lambda e, r, s: _chroma_distances((e, r), s, scale, features, metrics, by_path), together=True, cut=False)


def warpq_scores(target: int = 8000, count: int = 13, top: float = 4000.0, patch: float = 0.5, steps=((1, 0), (0, 3), (1, 3))) -> Callable[..., Column]:
    return _scored(["warpq"], lambda e, r, s: [warpq(e, r, s, target, count, top, patch, steps)])


def srmr_scores(channels: int = 23, lowest: float = 125.0, slow: float = 4.0, quick: float = 128.0) -> Callable[..., Column]:
    """A UDF of (signal, rate)."""
    return _scored(["srmr"], lambda x, s: [srmr(x, s, channels, lowest, slow, quick)], inputs=1)


sepm, chroma_metric = sepm_scores(), chroma_scores()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or a is None or b is None else resample(np.asarray(x, float), int(a), int(b)) for x, a, b in zip(samples, rate, target)])


@F.pandas_udf(T.DoubleType())
def dtw_distance(x: pd.Series, y: pd.Series) -> pd.Series:
    """Cosine DTW of two arrays of frames, scaled by 100."""
    return pd.Series([None if a is None or b is None or not len(a) or not len(b) else dtw(np.stack([np.asarray(f, float) for f in a]), np.stack([np.asarray(f, float) for f in b])) for a, b in zip(x, y)], dtype=float)
