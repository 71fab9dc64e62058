"""Signals: validity filters, chunks and paired chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col

#: Shortest signal in seconds that a metric takes, by the configured name.
MINIMUM = {"stoi": 0.3, "pesq": 0.25, "visqol": 1.0, "sheet": 0.065, "squim_ref": 0.1, "squim_no_ref": 0.1}


#: Chunks of a scoring run, and of the chunking script: seconds, hop, and the least that a last one lasts.
SCORING = {"seconds": 0.5, "hop": 0.2, "least": 0.1}
STANDALONE = {"seconds": 3.0, "hop": 3.0, "least": 0.0}


def minimum_seconds(metrics: Iterable[str]) -> float:
    """The strictest minimum of the configured metrics; aliases and other names have none."""
    return max((MINIMUM.get(m, 0.0) for m in metrics), default=0.0)


def long_enough(samples: Column | int | str, rate: Column | str, metrics: Iterable[str]) -> Column:
    return F.try_divide(col(samples), col(rate)) >= F.lit(minimum_seconds(metrics))


def varies(samples: Column | str) -> Column:
    """False for a signal of one value, and for an empty one; a NaN is like nothing else."""
    c = col(samples)
    return (F.size(c) > 0) & ((F.size(F.array_distinct(c)) > 1) | ((F.size(c) > 1) & F.exists(c, F.isnan)))


def valid(df: DataFrame, metrics: Iterable[str], samples: str = "samples", rate: str = "rate") -> tuple[DataFrame, DataFrame]:
    """(rows fit to score, rejected rows with ``reason``)."""
    reason = F.when(~F.coalesce(long_enough(F.size(samples), rate, list(metrics)), F.lit(False)), "too short").when(~varies(samples), "constant")
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def common_rate(rate: Column | str, other: Column | str) -> Column:
    """The rate both sides are brought to: the lower one; a side without a partner keeps its own."""
    return F.coalesce(F.least(col(rate), col(other)), col(rate))


def bounds(samples: Column, rate: Column, seconds: float = 0.5, hop: float = 0.2, least: float = 0.1) -> Column:
    """Array of (start, stop) in samples: a start each hop, a last chunk that is cut short stays if it lasts ``least`` seconds.

    Lengths are rounded half to even. An empty signal has none.
    """
    size, step, tail = (F.bround(F.lit(x) * rate).cast("long") for x in (seconds, hop, least))
    starts = F.when(samples > 0, F.sequence(F.lit(0).cast("long"), samples.cast("long") - 1, F.greatest(step, F.lit(1).cast("long"))))
    each = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, samples.cast("long")).alias("stop")))
    return F.filter(each, lambda c: (c["start"] + size <= samples) | (c["stop"] - c["start"] >= tail))


def chunk_key(key: Column, start: Column, stop: Column, rate: Column) -> Column:
    """key@t0-t1 in seconds with three decimals."""
    clock = lambda s: F.format_string("%.3f", s / rate)
    return F.concat(key.cast("string"), F.lit("@"), clock(start), F.lit("-"), clock(stop))


def chunks(df: DataFrame, key: str = "key", samples: str = "samples", rate: str = "rate", **size: float) -> DataFrame:
    """One row a chunk: (key, source, start, stop, the samples of the chunk, other columns as they were)."""
    n = F.size(samples)
    cut = df.withColumn("__c", F.explode(bounds(n, F.col(rate), **size)))
    start, stop = F.col("__c.start"), F.col("__c.stop")
    others = [c for c in df.columns if c not in (key, samples)]
    return cut.select(chunk_key(F.col(key), start, stop, F.col(rate)).alias(key), F.col(key).alias("source"), start.alias("start"), stop.alias("stop"), F.slice(samples, (start + 1).cast("int"), (stop - start).cast("int")).alias(samples), *others)


def paired_chunks(gen: DataFrame, ref: DataFrame, key: str = "key", samples: str = "samples", rate: str = "rate", **size: float) -> DataFrame:
    """Chunks of both sides at the same bounds, both cut to the shorter.

    A pair whose rates differ is dropped. Columns: key, source, start, stop, samples, ref_samples, rate, others of ``gen``.
    """
    other = ref.select(key, F.col(samples).alias("ref_" + samples), F.col(rate).alias("__rate"))
    both = gen.join(other, key).filter(F.col(rate) == F.col("__rate")).drop("__rate")
    n = F.least(F.size(samples), F.size("ref_" + samples))
    cut = both.withColumn("__c", F.explode(bounds(n, F.col(rate), **size)))
    start, stop = F.col("__c.start"), F.col("__c.stop")
    part = lambda c: F.slice(c, (start + 1).cast("int"), (stop - start).cast("int")).alias(c)
    others = [c for c in gen.columns if c not in (key, samples, rate)]
    return cut.select(chunk_key(F.col(key), start, stop, F.col(rate)).alias(key), F.col(key).alias("source"), start.alias("start"), stop.alias("stop"), part(samples), part("ref_" + samples), rate, *others)


def merged_segments(segments: DataFrame, gap: float = 0.1, least: float = 0.25, pad: float = 0.03, key: str = "key") -> DataFrame:
    """Speech segments (key, start, end) joined over short gaps, short ones dropped, the rest padded at both ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = segments.withColumn("__new", F.when(reach.isNull() | (F.col("start") - reach >= gap), 1).otherwise(0))
    grouped = opened.withColumn("__g", F.sum("__new").over(w)).groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return grouped.filter(F.col("end") - F.col("start") >= least).select(key, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))


def segments_of(df: DataFrame, segments: str = "vad_info", key: str = "key") -> DataFrame:
    """(key, start, end) of an array of segments a row; a row without any has none."""
    return df.select(key, F.explode(segments).alias("s")).select(key, "s.start", "s.end")


def likeliest(languages: Column | str) -> Column:
    """The language of the highest probability in an array of (lang, prob); of equals the first, null without any."""
    best = F.aggregate(col(languages), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob")), lambda a, x: F.when(a["prob"].isNull() | (x["prob"] > a["prob"]), F.struct(x["lang"].alias("lang"), x["prob"].cast("double").alias("prob"))).otherwise(a))
    return best["lang"]
