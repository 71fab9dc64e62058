import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import edit, signal
from scorelake.operators import chunking, scores, standardize
from scorelake.sources import audio


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_edit_counts_are_a_shortest_script(a, b):
    delete, insert, replace, equal = edit.edit_counts(list(a), list(b))
    assert delete + insert + replace == _distance(a, b)
    assert delete + replace + equal == len(a)
    assert insert + replace + equal == len(b)


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("speaker_gender", "Female", "Female"),
        ("speaker_gender", "女", "Female"),
        ("speech_rate", " 很慢 ", "Very slow"),
        ("speaker_count", "there are 14 people", "10"),
        ("speaker_count", "two", "2"),
        ("speaker_count", "nobody", "1"),
        ("overlapping_speech", "unclear", "No overlap"),
        ("language", "The language is Dutch", "Dutch"),
        ("speaker_gender", None, None),
    ],
)
def test_standardize(spark, kind, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(standardize.standardize(kind, F.col("t"))).first()[0] == want


def test_compat_matches_inside_words(spark):
    df = spark.createDataFrame([("Female",)], "t string")
    assert df.select(standardize.standardize("speaker_gender", F.col("t"), compat=True)).first()[0] == "Male"


def test_clean_answer(spark):
    df = spark.createDataFrame([("  The category is Answer: x.y ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(standardize.clean_answer(F.col("t"))).collect()] == ["x.y", "", None]


def test_statistics_of_odd_values(spark):
    inf = math.inf
    rows = [("a", "one", 3.0), ("a", "two", inf), ("b", "two", -inf), ("a", "three", 1.0), ("b", "three", math.nan), ("c", "three", None), ("d", "three", 3.0)]
    got = {r["metric"]: r for r in scores.statistics(spark.createDataFrame(rows, "key string, metric string, value double")).collect()}
    assert got["one"]["std"] == 0.0
    assert got["three"]["count"] == 2 and got["three"]["mean"] == 2.0
    empty = spark.createDataFrame([], "key string, metric string, value double")
    assert scores.statistics(empty).count() == 0


def test_chunk_bounds(spark):
    df = spark.createDataFrame([(20,), (14,), (10,), (3,), (0,)], "n int")
    got = [[(c["start"], c["stop"]) for c in r[0] or []] for r in df.select(chunking.bounds(F.col("n"), F.lit(10), 1.0, 0.5, 0.6)).collect()]
    assert got[0] == [(0, 10), (5, 15), (10, 20)]
    assert got[3] == [] and got[4] == []


def test_wav_round_trip():
    x = np.sin(np.arange(800) / 5) * 0.5
    rate, y = audio.decode_wav(audio.encode_wav(8000, x))
    assert rate == 8000 and np.abs(np.asarray(y, float).reshape(-1)[:800] - x).max() < 1e-3


def test_si_snr_grows_with_quality():
    rng = np.random.default_rng(1)
    ref = rng.standard_normal(4000)
    noise = rng.standard_normal(4000)
    assert signal.si_snr(ref + 0.01 * noise, ref) > signal.si_snr(ref + noise, ref)
    assert abs(signal.stoi(ref, ref, 10_000) - 1) < 1e-6 or math.isnan(signal.stoi(ref, ref, 10_000))
