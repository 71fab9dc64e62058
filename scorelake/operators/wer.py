"""Error rates: counts of alignments, rates per row and corpus, filters and key selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import edit
from scorelake.functions.columns import words

PARTS = ("delete", "insert", "replace", "equal")


def count_errors(df: DataFrame, ref: str = "ref_text", hyp: str = "hyp_text", prefix: str = "whisper", strip_chars: bool = True) -> DataFrame:
    """``df`` with word and character counts as <prefix>_wer_<part> and <prefix>_cer_<part>."""
    trim = F.trim if strip_chars else (lambda c: c)
    both = df.withColumns({"__w": edit.counts(words(ref), words(hyp)), "__c": edit.character_counts(trim(F.col(ref)), trim(F.col(hyp)))})
    named = {f"{prefix}_{kind}_{p}": F.col(f"{c}.{p}") for kind, c in (("wer", "__w"), ("cer", "__c")) for p in PARTS}
    return both.withColumns(named).drop("__w", "__c")


def count_phoneme_errors(df: DataFrame, ref: str, hyp: str, prefix: str = "whisper") -> DataFrame:
    """``df`` with counts over phoneme token arrays as <prefix>_per_<part>."""
    both = df.withColumn("__p", edit.counts(edit.phonemes(F.col(ref)), edit.phonemes(F.col(hyp))))
    return both.withColumns({f"{prefix}_per_{p}": F.col(f"__p.{p}") for p in PARTS}).drop("__p")


def rates(delete: Column, insert: Column, replace: Column, equal: Column) -> dict[str, Column]:
    """wer, insertion, deletion and substitution rates over the reference's words; all 0 without words."""
    n = (equal + delete + replace).cast("double")
    over = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(c.cast("double"), n))
    return {"wer": over(delete + insert + replace), "insertion_error": over(insert), "deletion_error": over(delete), "substitution_error": over(replace)}


def with_rates(df: DataFrame, prefix: str = "whisper") -> DataFrame:
    return df.withColumns(rates(*(F.col(f"{prefix}_wer_{p}") for p in PARTS)))


def flags(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Rows with rates, marked by the four filters in one pass."""
    low = lambda c: F.col(c) < threshold
    return df.withColumns({"low_wer": low("wer"), "low_insertion": low("insertion_error"), "low_deletion": low("deletion_error"), "low_both": low("insertion_error") & low("deletion_error")})


def filtered(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(flag)


def filter_summary(flagged: DataFrame) -> DataFrame:
    """One row: means of the rows' rates, least and greatest wer, and how many rows each filter keeps."""
    kept = ("low_wer", "low_insertion", "low_deletion", "low_both")
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("rows"), *(F.avg(c).alias("mean_" + c) for c in ("wer", "insertion_error", "deletion_error", "substitution_error")),
        F.min("wer").alias("min_wer"), F.max("wer").alias("max_wer"), *(F.count_if(c).alias(c) for c in kept), *((F.try_divide(F.count_if(c) * 100.0, n)).alias(c + "_percent") for c in kept),
    )


def corpus_wer(df: DataFrame, families: tuple[str, ...] = ("whisper", "espnet")) -> DataFrame:
    """(errors, words, wer) over all rows with a reference, of the first family that a row has; wer is null without words."""
    have = [f for f in families if all(f"{f}_wer_{p}" in df.columns for p in PARTS)]
    if not have:
        raise ValueError(f"no counts of {families}")
    pick = lambda p: F.coalesce(*(F.when(F.col(f"{f}_wer_equal").isNotNull(), F.col(f"{f}_wer_{p}")) for f in have))
    d, i, r, e = (pick(p) for p in PARTS)
    rows = df.select((d + i + r).alias("errors"), (e + d + r).alias("words")).filter("words > 0")
    return rows.agg(F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("wer", F.try_divide(F.col("errors").cast("double"), "words"))


def mismatch_rate(delete: Column, insert: Column, replace: Column, ref_length: Column) -> Column:
    """Characters in error over the reference's; 1.0 for an empty reference."""
    return F.when(ref_length == 0, F.lit(1.0)).otherwise(F.try_divide((delete + insert + replace).cast("double"), ref_length))


def speaking_rate(text: Column, seconds: Column, characters: bool = False) -> Column:
    """Words, or characters, a second; null for no duration."""
    size = F.length(text) if characters else F.size(words(text))
    return F.try_divide(size.cast("double"), seconds)


def select_keys(df: DataFrame, text: str = "ref_text", key: str = "key", least_words: int = 16, shortest: float = 10.0, longest: float = 30.0) -> DataFrame:
    """Keys of rows with enough reference words whose key ends in _start_end of a fit duration; other keys are left out."""
    parts = F.split(key, "_")
    span = F.element_at(parts, -1).try_cast("double") - F.try_element_at(parts, F.lit(-2)).try_cast("double")
    return df.filter((F.size(words(text)) >= least_words) & span.between(shortest, longest)).select(key)
