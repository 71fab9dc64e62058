"""What the second round of findings asked for."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.functions import columns as C
from scorelake.functions import edit, signal
from scorelake.operators import pairing, standardize, wer
from scorelake.plans import catalog
from scorelake.sources import scores as files

TABLES = "/root/testdata/sf0.001"


def test_clock_times_of_a_hundred_hours_and_more(spark):
    seconds = [0.0, 3599.999, 359_999.999, 360_000.0, 712_492.875, 36_000_000.0, None]
    df = spark.createDataFrame([(s,) for s in seconds], "s double")
    want = ["00:00.000", "59:59.999", "99:59:59.999", "100:00:00.000", "197:54:52.875", "10000:00:00.000", None]
    assert [r[0] for r in df.select(C.timestamp("s")).collect()] == want


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(8)
    ref = np.convolve(rng.normal(size=8000), [1, 0.8, 0.5, 0.2], "same")
    return ref + 0.3 * rng.normal(size=8000), ref


def test_enhancement_measures_share_their_frames(pair, monkeypatch):
    """A row's spectra are taken once, and its envelopes aren't copied for each of their samples."""
    est, ref = pair
    parts = [signal.fwsegsnr(est, ref, 16_000), signal.llr(est, ref, 16_000), signal.wss(est, ref, 16_000), signal.cepstral_distance(est, ref, 16_000), *signal.csii(est, ref, 16_000), signal.ncm(est, ref, 16_000)]
    parts += [signal.llr(est, ref, 16_000, cut=False), parts[2], signal.segmental_snr(est, ref, 16_000)]
    frames, real = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, n=None, *a, **k: (frames.append(np.size(x) // 480) if n == 1024 else None, real(x, n, *a, **k))[1])
    assert np.allclose(signal._sepm(est, ref, 16_000), parts, rtol=1e-6, equal_nan=True)
    assert sum(frames) == 2 * 63
    tracemalloc.start()
    signal.ncm(est, ref, 16_000)
    assert tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()


@pytest.mark.parametrize(("count", "rate", "target"), [(9000, 16_000, 10_000), (5, 16_000, 10_000), (40_000, 16_000, 32), (3000, 44_100, 16_000), (2000, 8000, 44_100)])
def test_resampling_by_pieces_is_that_of_a_matrix(count, rate, target):
    x = np.random.default_rng(1).normal(size=(count, 2))
    g = math.gcd(rate, target)
    want = signal._resampling.__wrapped__(count, target // g, rate // g) @ x
    got = signal.resample(x, rate, target)
    assert np.allclose(got, want, atol=1e-12) and np.allclose(signal.resample(x[:, 1], rate, target), want[:, 1], atol=1e-12)


def test_distortion_ratios_of_many_rows_are_solved_together(monkeypatch, spark):
    """By one recursion over the rows, to what elimination gives; a row that can't be scored leaves the others alone."""
    rng = np.random.default_rng(4)
    ref = np.stack([np.resize(rng.normal(size=64), 2000), np.convolve(rng.normal(size=2000), [1, 0.9, 0.5], "same"), np.zeros(2000), rng.normal(size=2000)])
    est = ref + 0.2 * rng.normal(size=ref.shape) * [[1], [1], [1], [0]]
    want = []
    for e, t in zip(est, ref):
        auto = np.correlate(np.pad(t, (0, 511)), t, "valid")
        gram = auto[np.abs(np.subtract.outer(np.arange(512), np.arange(512)))] + 1e-10 * max(auto[0], signal.EPS) * np.eye(512)
        target = np.convolve(np.linalg.solve(gram, np.correlate(np.pad(e, (0, 511)), t, "valid")), t)
        noise = np.pad(e, (0, 511)) - target
        want.append(10 * math.log10(max(target @ target, signal.EPS) / max(noise @ noise, signal.EPS)))
    monkeypatch.setattr(np.linalg, "solve", lambda *a: pytest.fail("a row was solved alone"))
    assert signal._ci_sdrs(est[:3], ref[:3], 512) == pytest.approx(want[:3], abs=1e-6)
    assert want[3] > 80 and signal._ci_sdrs(est, ref, 512)[3] > 80
    rows = [("a", 8, [1.0, 2.0, 4.0], [1.0, 3.0]), ("b", 8, [], [1.0]), ("c", None, [1.0], [1.0]), ("d", 8, [5.0, 1.0], [1.0, 3.0]), ("e", 8, None, [1.0])]
    df = spark.createDataFrame(rows, "key string, rate int, samples array<double>, ref_samples array<double>")
    got = {r["key"]: r["m"] for r in df.select("key", signal.signal_metric("samples", "ref_samples", "rate").alias("m")).collect()}
    assert got["a"]["sdr"] == pytest.approx(signal.ci_sdr([1, 2], [1, 3])) and got["d"]["sar"] == pytest.approx(signal.ci_sdr([5, 1], [1, 3]))
    assert got["c"]["error"] == got["e"]["error"] == "ValueError: an input is null" and got["b"]["sdr"] == 0


def test_enhanced_items_are_scored_on_all_cores(spark):
    assert catalog.queries()["enhanced_metrics"](spark, TABLES).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_chroma_of_many_rows_is_made_once_a_signal(monkeypatch):
    """Of all rows of one length together, to the last bit as alone: paths hang on ties."""
    rng = np.random.default_rng(9)
    est, ref = (np.stack([np.resize(rng.normal(size=64), 4000) for _ in range(5)]) for _ in range(2))
    pairs = [[e, r] for e, r in zip(est, ref)] + [[est[0], ref[1][:2000]]]
    want = [list(signal.chroma_distances(e, r, 16_000).values()) for e, r in pairs]
    calls, real = [], signal.constant_q
    monkeypatch.setattr(signal, "constant_q", lambda x, *a: (calls.append(len(x)), real(x, *a))[1])
    score = lambda e, r, s: signal._chroma_distances((e, r), s, 100.0, signal.CHROMA_FEATURES, signal.CHROMA_METRICS, True)
    assert signal._together(score, pairs, [16_000] * 6, cut=False) == want and sorted(calls) == [1, 1, 5, 5]


def test_both_intelligibilities_come_from_one_resampling(pair, monkeypatch, spark):
    calls, real = [], signal.resample
    want = [signal.stoi(*pair, 16_000), signal.stoi(*pair, 16_000, True)]
    monkeypatch.setattr(signal, "resample", lambda *a: (calls.append(1), real(*a))[1])
    got = signal.intelligibility.func(*(pd.Series([x]) for x in (*pair, 16_000))).iloc[0]
    assert [got["stoi"], got["estoi"]] == want and len(calls) == 1


def test_answers_are_standardized_on_all_cores(spark):
    """Whole words only, foreign terms too; a file of answers isn't one task."""
    rows = [("a", "It is Fast"), ("b", "breakfast"), ("c", "很快"), ("d", " 慢 "), ("e", "说 快 吧"), ("f", ""), ("g", None), ("h", "x very slow, not fast")]
    df = spark.createDataFrame(rows, "key string, qwen_speech_rate string")
    got = {r["key"]: r["qwen_speech_rate"] for r in standardize.standardize_row(df).collect()}
    assert got == {"a": "Fast", "b": "Very slow", "c": "Fast", "d": "Slow", "e": "Fast", "f": "Very slow", "g": None, "h": "Very slow"} | {"c": got["c"]} and got["c"] in ("Fast", "Very fast")
    assert catalog.queries()["standardized_answers"](spark, TABLES).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_characters_are_counted_in_texts(spark, monkeypatch):
    """Texts go to Python as they are, not as arrays of characters; code points count, and nulls stay."""
    rows = [("a", "kitten", "sitting"), ("b", "", "äß"), ("c", None, "x"), ("d", "a\U0001f600b", "ab"), ("e", "", "")]
    df = spark.createDataFrame(rows, "key string, ref string, hyp string")
    both = df.select("key", edit.character_counts(F.col("ref"), F.col("hyp")).alias("t"), edit.counts(edit.characters(F.col("ref")), edit.characters(F.col("hyp"))).alias("c")).collect()
    assert all(r["t"] == r["c"] for r in both) and {r["key"]: r["t"]["delete"] for r in both} == {"a": 0, "b": 0, "c": None, "d": 1, "e": 0}
    assert "split(" not in catalog.edit_counts(spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()


def test_a_transcript_line_is_parsed_once(spark):
    lines = ['{"segment_index": 2, "local_scene": " a\\n b "}', '{"segment_index": 10, "local_scene": "straße", "x": NaN}', '{"segment_index": "", "local_scene": "c"}', '{"segment_index": 3, "local_scene": " "}', '{"local_scene": "d"}', '{"segment_index": 4}', "no json", None]
    out = files.json_to_transcript(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in out.collect()] == [("10", "STRASSE"), ("2", "A B")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parse") == 1


def test_all_pairs_move_their_vectors_once(spark):
    """Blocks are read where they lie: no copies of vectors are shuffled, whatever the number of blocks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[7] = 0
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "key string, embedding array<float>")
    out = pairing.all_pairs(df, rows=5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 60 * 59 // 2 and all(r["a"] < r["b"] for r in got)
    for r in got:
        a, b = (x[int(r[s][1:])].astype(float) for s in "ab")
        want = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else math.nan
        assert r["similarity"] == pytest.approx(want, abs=1e-12, nan_ok=True)
    assert pairing.all_pairs(df.limit(0)).count() == 0
