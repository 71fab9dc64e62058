"""Scoring runs: validate, pair, align, score, flatten; by item or by metric; resumed, chunked or of a corpus; kept as JSON lines."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.signal import resampled
from scorelake.operators import chunking, pairing
from scorelake.operators.scores import summary, to_long
from scorelake.plans.session import exists, staged
from scorelake.registry import DISTRIBUTIONAL, Registry, Suite, suite
from scorelake.sources import scores as files

log = logging.getLogger(__name__)


def prepared(gen: DataFrame, ref: DataFrame | None, text: DataFrame | None, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, rate, samples, ref_samples, text, others of ``gen``) of items fit to score, and the rejected ones with a reason.

    Cheap tests come before joins and joins before resampling, so rejected rows carry no further
    cost. Both sides are brought to the lower rate.
    """
    others = [c for c in gen.columns if c not in ("key", "rate", "samples", "ref_samples", "text")]
    good, bad = chunking.valid(gen.select("key", "rate", "samples", *others), metrics)
    if ref is not None:
        fine, worse = chunking.valid(ref.select("key", "rate", "samples"), metrics)
        bad = bad.select("key", "reason").unionByName(worse.join(good.select("key"), "key", "left_semi").select("key", F.concat(F.lit("reference "), F.col("reason")).alias("reason")))
        other = fine.select("key", F.col("rate").alias("__rate"), F.col("samples").alias("ref_samples"))
        both = pairing.pair(good, other, check=False)
        target = chunking.common_rate("rate", "__rate")
        align = lambda c, r: F.when(F.col(r) == target, F.col(c).cast("array<double>")).otherwise(resampled(F.when(F.col(r) != target, F.col(c).cast("array<double>")), F.col(r), target))
        good = both.select("key", target.alias("rate"), align("samples", "rate").alias("samples"), align("ref_samples", "__rate").alias("ref_samples"), *others)
    return pairing.with_text(good, text), bad.select("key", "reason")


def score(gen: DataFrame, config: list[dict], registry: Registry, ref: DataFrame | None = None, text: DataFrame | None = None, done: DataFrame | None = None, errors: bool = False) -> DataFrame:
    """One row an item with all metrics. The strictest minimum length of all configured metrics applies to every item.

    With ``errors`` there is a column <name>_error for each metric that gives its reasons.
    ``done`` holds earlier rows: their items aren't scored again, and their rows come along.
    """
    chosen = _usable(config, registry, ref, text)
    todo = gen if done is None else pairing.to_do(gen, done)
    items, _ = prepared(todo, ref, text, [c["name"] for c in config])
    new = chosen.apply(items, errors=errors)
    return new if done is None else pairing.resumed(gen, done, new)


def score_by_metric(gen: DataFrame, config: list[dict], registry: Registry, ref: DataFrame | None = None, text: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """One row for every item listed, merged from a run of each metric, each with its own minimum length.

    Earlier values stay where a metric has no new one.
    """
    frames = [] if done is None else [done]
    for entry in config:
        one = suite(registry, [entry], ref is not None, text is not None).without(DISTRIBUTIONAL)
        if len(one):
            items, _ = prepared(gen, ref, text, [entry["name"]])
            frames.append(one.apply(items))
    if not frames:
        raise ValueError("no metric can run")
    return pairing.merge_metrics(gen, frames)


def _usable(config: list[dict], registry: Registry, ref: DataFrame | None, text: DataFrame | None) -> Suite:
    chosen = suite(registry, config, ref is not None, text is not None).without(DISTRIBUTIONAL)
    if not len(chosen):
        raise ValueError("no metric can run")
    return chosen


def summarise(scores: DataFrame) -> DataFrame:
    """(metric, value) over the rows of a run."""
    return summary(to_long(scores))


def score_chunks(gen: DataFrame, config: list[dict], registry: Registry, ref: DataFrame | None = None, **size: float) -> DataFrame:
    """One row a chunk; both sides are cut at the same bounds."""
    if ref is None:
        return score(chunking.chunks(gen, **size).select("key", "rate", "samples"), config, registry)
    cut = chunking.paired_chunks(gen, ref, **size)
    return score(cut.select("key", "rate", "samples"), config, registry, cut.select("key", "rate", F.col("ref_samples").alias("samples")))


def score_to_jsonl(gen: DataFrame, config: list[dict], registry: Registry, path: str, ref: DataFrame | None = None, text: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """Score into JSON lines at ``path`` and return (key, line) of the items listed.

    With ``resume`` items that have a line there aren't scored again and new lines are added; lines of
    items no longer listed stay on disk. A run that was cut off in the middle of a file left a bad
    line at most, which readers skip.
    """
    spark = gen.sparkSession
    going_on = resume and exists(spark, path)
    todo = pairing.to_do(gen, files.read_done(spark, path)) if going_on else gen
    files.write_jsonl(score(todo, config, registry, ref, text), path, append=going_on)
    return files.read_done(spark, path).join(gen.select(F.col("key").cast("string").alias("key")), "key", "left_semi")


def score_metrics_to_jsonl(gen: DataFrame, config: list[dict], registry: Registry, path: str, ref: DataFrame | None = None, text: DataFrame | None = None) -> DataFrame:
    """Score metric by metric; the whole table takes the place of what is at ``path`` after each, and is returned."""
    spark = gen.sparkSession
    done = None
    for entry in config:
        try:
            merged = staged(score_by_metric(gen, [entry], registry, ref, text, done), "metric")
        except ValueError as e:
            log.warning("%s: %s", entry["name"], e)
            continue
        files.replace_jsonl(merged, path)
        done = merged
    if done is None:
        raise ValueError("no metric can run")
    return spark.read.schema(done.schema).json(path)


def score_corpus(gen: DataFrame, config: list[dict], registry: Registry, base: DataFrame | None = None, text: DataFrame | None = None, path: str | None = None) -> dict[str, float | None]:
    """Names and values of the configured metrics of a whole corpus over (key, embedding) tables; one that fails is logged and left out.

    ``path`` names a YAML file for them.
    """
    out: dict[str, float | None] = {}
    for name, (m, options) in suite(registry, config, base is not None, text is not None).of(DISTRIBUTIONAL).metrics.items():
        try:
            out |= m.corpus(gen, base, text, options)
        except Exception as e:  # noqa: BLE001 - one metric's failure isn't the others'
            log.error("%s fails: %s", name, e)
    if path:
        files.write_corpus(out, path)
    return out
