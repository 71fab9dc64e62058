"""Decided quirks and expected values of the engine's contract."""

import math

import pytest
from pyspark.sql import functions as F

from scorelake.operators import chunking, pairing, scores, standardize, wer
from scorelake.sources import scores as files

LONG = "key string, metric string, value double"


def test_expected_summary_of_ragged_rows(spark):
    lines = spark.createDataFrame([('{"key": "a", "espnet_wer_insert": 1, "pesq": 1.5, "espnet_hyp_text": "x", "match": {"n": 4}}',), ('{"key": "b", "espnet_wer_insert": 2, "pesq": 2.5, "flag": true}',)], "value string")
    got = {r["metric"]: r["value"] for r in scores.summary(files.long_scores(lines, booleans=False)).collect()}
    assert got == {"espnet_wer_insert": 3.0, "pesq": 2.0}


def test_expected_corpus_wer_of_mixed_lines(spark):
    lines = spark.createDataFrame(
        [('{"key": "a", "whisper_wer_delete": 1, "whisper_wer_insert": 0, "whisper_wer_replace": 2, "whisper_wer_equal": 7}',), ("{'key': 'b', 'espnet_wer_delete': 0, 'espnet_wer_insert': 1, 'espnet_wer_replace': 1, 'espnet_wer_equal': 8}",)], "value string"
    )
    v = files.variant(F.col("value"))
    columns = [f"{m}_wer_{p}" for m in ("whisper", "espnet") for p in wer.PARTS]
    rows = files.literal_lines(lines).select(*(F.try_variant_get(v, f"$.{c}", "long").alias(c) for c in columns))
    got = wer.corpus_wer(rows).first()
    assert (got["errors"], got["words"]) == (5, 19) and got["wer"] == pytest.approx(0.2631578947368421)
    assert wer.corpus_wer(rows.limit(0)).first()["wer"] is None


def test_names_that_hold_a_count_are_summed_and_booleans_are_metrics_to_discovery_only(spark):
    rows = [("a", "x_percent", 2.0), ("b", "x_percent", 4.0), ("a", "pesq", 2.0), ("b", "pesq", 4.0), ("a", "a_cer_equal", 1.0), ("b", "a_cer_equal", 1.0)]
    got = {r["metric"]: r["value"] for r in scores.summary(spark.createDataFrame(rows, LONG)).collect()}
    assert got == {"x_percent": 6.0, "pesq": 3.0, "a_cer_equal": 2.0}
    wide = spark.createDataFrame([("a", 1.0, True, "t")], "key string, x double, flag boolean, s string")
    assert scores.numeric_columns(wide) == ["x"] and scores.numeric_columns(wide, booleans=True) == ["flag", "x"]


def test_a_metric_without_a_finite_value_keeps_its_row(spark):
    rows = [("a", "bad", math.inf), ("b", "bad", math.nan), ("a", "good", 1.0), ("a", "one_mos", 9.0)]
    got = {r["metric_name"]: r for r in scores.analysis(spark.createDataFrame(rows, LONG)).collect()}
    assert got["bad"]["count"] == 0 and got["bad"]["variability"] == "invalid" and got["bad"]["mean"] is None
    assert got["good"]["std"] == 0.0 and got["one_mos"]["higher_is_better"] is True
    nodes = {r["name"]: r["parent"] for r in scores.tree(scores.analysis(spark.createDataFrame(rows, LONG))).collect()}
    assert nodes["Metrics"] == "" and set(nodes) >= {"bad", "good", "one_mos"}
    assert [tuple(r) for r in scores.tree(scores.analysis(spark.createDataFrame([], LONG))).collect()] == [("Metrics", "", 0, None, None)]


def test_minimum_lengths_go_by_the_configured_name():
    assert chunking.minimum_seconds(["estoi", "STOI", "sheet_ssqa"]) == 0.0
    assert chunking.minimum_seconds(["sheet", "stoi", "visqol"]) == 1.0


def test_numbers_in_free_text(spark):
    text = spark.createDataFrame([("x {'a': -1.5, 'b': 2e1, 'c': 3, 'd': inf, 'e': 4}",)], "value string")
    assert {(r["metric"], r["value"]) for r in files.regex_scores(text).collect()} == {("a", -1.5), ("b", 20.0), ("c", 3.0), ("e", 4.0)}
    assert {(r["metric"], r["value"]) for r in files.regex_scores(text, compat=True).collect()} == {("c", 3.0), ("e", 4.0)}


def test_number_words_stand_alone(spark):
    df = spark.createDataFrame([("someone else",)], "t string")
    assert df.select(standardize.standardize("speaker_count", F.col("t"))).first()[0] == "1"
    two = spark.createDataFrame([("a networked room",)], "t string")
    assert two.select(standardize.standardize("speaker_count", F.col("t")), standardize.standardize("speaker_count", F.col("t"), compat=True)).first()[:] == ("1", "2")


def test_resumed_and_paired_rows(spark):
    gen = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    done = spark.createDataFrame([("a", 1.0), ("x", 9.0)], "key string, m double")
    new = spark.createDataFrame([("b", 2)], "key string, n int")
    assert {tuple(r) for r in pairing.resumed(gen, done, new).collect()} == {("a", 1.0, None), ("b", None, 2)}
    assert sorted(r["key"] for r in pairing.to_do(gen, done).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        pairing.pair(gen, done)
    with pytest.raises(ValueError, match="a"):
        pairing.require_text(gen, done.limit(0).withColumnRenamed("m", "text"))
    assert pairing.with_text(gen, done.limit(0).select("key", F.lit("t").alias("text"))).filter("text is null").count() == 3


def test_strict_means_refuse_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", 3.0, 4)], "key string, x double, y int")
    assert scores.strict_means(df).first()[:] == (2.0, 3.0)
    with pytest.raises(TypeError):
        scores.strict_means(df.withColumn("s", F.lit("t")))
    with pytest.raises(Exception, match="a row has no x"):
        scores.strict_means(df.withColumn("x", F.when(F.col("key") == "a", F.col("x")))).collect()


def test_all_pairs_over_blocks(spark):
    df = spark.createDataFrame([(f"k{i}", [float(i % 4), 1.0, float(i)]) for i in range(25)] + [("zero", [0.0] * 3)], "key string, embedding array<double>")
    whole, cut = ({(r["a"], r["b"]): r["similarity"] for r in pairing.all_pairs(df, rows=n).collect()} for n in (2048, 6))
    assert len(whole) == 26 * 25 // 2 and all(a < b for a, b in whole)
    assert set(whole) == set(cut) and all(whole[p] == pytest.approx(cut[p], nan_ok=True) for p in whole)
    assert math.isnan(whole[("k1", "zero")])
