"""Native column expressions: no Python at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def contains_any(name: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def is_count_metric(name: Column | str) -> Column:
    """Names that are summed, not averaged: error counts, by substring."""
    return contains_any(col(name), ("_wer", "_cer", "_per"))


def sample_std(count: Column, low: Column, high: Column, std: Column) -> Column:
    """Sample standard deviation; 0.0 for one value or a spread under 1e-10."""
    return F.when((count <= 1) | (high - low < 1e-10), F.lit(0.0)).otherwise(std)


def words(text: Column | str) -> Column:
    """White-space tokens; none for an empty text."""
    return F.filter(F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " "), lambda w: w != "")


def clean_transcript(text: Column | str) -> Column:
    """Upper case on one line with single spaces."""
    return F.upper(F.trim(F.regexp_replace(col(text), r"\s+", " ")))


def cleaned_text(text: Column | str, cleaner: str | None = "whisper_basic") -> Column:
    """A text as a recogniser's scoring sees it; without a cleaner as it is.

    ``whisper_basic`` is our own: lower case, no bracketed remarks, marks, symbols and punctuation as
    spaces, single spaces. Compatibility forms of characters stay as they are.
    """
    c = col(text)
    if cleaner is None:
        return c
    if cleaner != "whisper_basic":
        raise ValueError(f"unknown text cleaner: {cleaner}")
    spoken = F.regexp_replace(F.regexp_replace(F.lower(c), r"[<\[][^>\]]*[>\]]", ""), r"\([^)]+\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(spoken, r"[\p{M}\p{S}\p{P}]", " "), r"\s+", " "))


def sentence_case(text: Column | str) -> Column:
    """All lower case but for the first letter."""
    low = F.lower(col(text))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))


def timestamp(seconds: Column | str, always_hours: bool = False, mark: str = ".") -> Column:
    """[hh:]mm:ss.mmm; hours appear when there are any, or always."""
    ms = F.bround(col(seconds) * 1000).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")  # noqa: E731 - cuts what is longer
    hours = F.floor(ms / 3600000).cast("long")
    rest = F.concat(pad(F.floor(ms / 60000).cast("long") % 60, 2), F.lit(":"), pad(F.floor(ms / 1000).cast("long") % 60, 2), F.lit(mark), pad(ms % 1000, 3))
    long = F.concat(F.when(hours < 100, pad(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), rest)
    return long if always_hours else F.when(hours > 0, long).otherwise(rest)


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NaN where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), norm))


def frame_cosine(a: Column | str, b: Column | str, eps: float = 1e-5) -> Column:
    """Mean over frames of the cosine, ``eps`` added to each norm; frames are arrays of arrays."""
    one = F.zip_with(col(a), col(b), lambda x, y: dot(x, y) / ((F.sqrt(dot(x, x)) + eps) * (F.sqrt(dot(y, y)) + eps)))
    return F.try_divide(F.aggregate(one, F.lit(0.0), lambda s, x: s + x), F.size(one).cast("double"))


def total(values: Column | str) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(values: Column | str) -> Column:
    return F.try_divide(total(values), F.size(col(values)).cast("double"))


def normalise_pcm(samples: Column | str) -> Column:
    """16-bit samples to [-1, 1] by 32767."""
    return F.transform(col(samples), lambda x: x.cast("double") / F.lit(32767.0))


def repeat_to(samples: Column | str, length: Column | int) -> Column:
    """The signal repeated to at least ``length`` samples, then cut to it; an empty signal stays empty."""
    c = col(samples)
    n = F.lit(length) if isinstance(length, int) else length
    times = F.ceil(n / F.greatest(F.size(c), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(c, times)), F.lit(1), n)


def si_snr(estimate: Column | str, target: Column | str) -> Column:
    """Scale-invariant signal-to-noise ratio in dB of two signals, cut to the shorter, means removed."""
    n = F.least(F.size(col(estimate)), F.size(col(target)))
    cut = lambda c: F.transform(F.slice(col(c), F.lit(1), n), lambda x: x.cast("double"))
    centre = lambda c: F.transform(cut(c), lambda x: x - mean(cut(c)))
    return si_snr_of(centre(estimate), centre(target))


def si_snr_of(e: Column, t: Column) -> Column:
    """As ``si_snr`` for signals already centred and of one length."""
    scale = F.try_divide(dot(e, t), dot(t, t))
    signal = scale * scale * dot(t, t)
    noise = dot(e, e) - scale * dot(e, t)
    return F.when(signal > 0, F.when(noise > 0, 10 * F.log10(signal / noise)).otherwise(F.lit(INF))).otherwise(F.lit(-INF))


def mel_cepstral_distortion(a: Column | str, b: Column | str) -> Column:
    """Mean over aligned frames of 10 / ln 10 * sqrt(2 * sum of squared differences), all coefficients."""
    frame = F.zip_with(col(a), col(b), lambda x, y: F.sqrt(2 * F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)))
    return F.lit(10.0) / F.log(F.lit(10.0)) * mean(frame)


def rmse(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(mean(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two arrays of one length; null where one is constant."""
    n = F.size(col(a)).cast("double")
    sx, sy, sxy, sxx, syy = total(a), total(b), dot(a, b), dot(a, a), dot(b, b)
    return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))


def loud_frames(frames: Column | str, threshold: float = -20.0) -> Column:
    """Frames whose power over the mean frame power is above the threshold in dB."""
    power = F.transform(col(frames), lambda f: dot(f, f))
    level = mean(power)
    return F.filter(col(frames), lambda f: 10 * F.log10(F.try_divide(dot(f, f), level)) > threshold)


def unfenced(text: Column | str) -> Column:
    """An answer without its code fence."""
    c = F.trim(col(text))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
