"""The functions of a plain scoring script: modules from a configuration, scores of lists of items and of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelake.plans import scoring
from scorelake.registry import DISTRIBUTIONAL, Suite, default_registry, suite
from scorelake.sources import scores as files


def load_score_modules(config: list[dict], use_gt: bool = True, use_gt_text: bool = False) -> Suite:
    """The configured metrics of items that can run; an empty configuration is an error."""
    if not config:
        raise ValueError("no metric is configured")
    return suite(default_registry(), config, use_gt, use_gt_text).without(DISTRIBUTIONAL)


def list_scoring(gen: DataFrame, modules: Suite, gt: DataFrame | None = None, text: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """One row an item with the modules' scores, written as JSON lines where ``path`` says so."""
    items, _ = scoring.prepared(gen, gt, text, list(modules.metrics))
    out = modules.apply(items)
    if path:
        files.write_jsonl(out, path)
    return out


def load_summary(scores: DataFrame) -> dict[str, float]:
    """Sums of error counts and means of the other scores."""
    return {r["metric"]: r["value"] for r in scoring.summarise(scores).collect()}  # a row a metric


def load_corpus_modules(config: list[dict]) -> Suite:
    """The configured metrics of whole corpora; others are left out."""
    if not config:
        raise ValueError("no metric is configured")
    return suite(default_registry(), config, True, True).of(DISTRIBUTIONAL)


def corpus_scoring(gen: DataFrame, modules: Suite, baseline: DataFrame | None = None, text: DataFrame | None = None, path: str | None = None) -> dict[str, float | None]:
    """Scores of a corpus of embeddings by the modules."""
    config = [{"name": n, **options} for n, (_, options) in modules.metrics.items()]
    return scoring.score_corpus(gen, config, default_registry(), baseline, text, path)
