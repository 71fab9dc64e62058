"""Readers, writers, registry and runs on the odd cases of their contracts."""

import logging
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import columns as C
from scorelake.plans import facade, scoring
from scorelake.registry import Metric, Registry, column_plugin, create, default_registry, isolated, suite
from scorelake.sources import audio, listings
from scorelake.sources import scores as files


def lines(folder, name, *text):
    (folder / name).write_text("\n".join(text) + "\n")
    return str(folder / name)


def test_listings(spark, tmp_path):
    good = lines(tmp_path, "wav.scp", "a  /x/one file.wav", "b\t/y.wav  ", "a /z.wav")
    assert {r["key"]: r["path"] for r in listings.read_scp(spark, good).collect()} == {"a": "/z.wav", "b": "/y.wav"}
    for i, bad in enumerate(("a sox x |", "alone", "")):
        with pytest.raises(Exception, match="commands aren't run|needs a key"):
            listings.read_scp(spark, lines(tmp_path, f"bad{i}.scp", bad)).collect()
    assert listings.read_text(spark, lines(tmp_path, "text", "a what is | this")).first()["text"] == "what is | this"
    with pytest.raises(ValueError):
        listings.read_audio_listing(spark, good, "other")
    with pytest.raises(ValueError):
        listings.read_csv_list(spark, lines(tmp_path, "a.csv", "x,y", "1,2"))


def test_wav_files_of_all_sorts(spark, tmp_path):
    t = np.arange(800)
    sound = {"sine8": (8000, np.sin(t / 5)), "sine16": (16_000, np.sin(t / 9)), "zero": (8000, np.zeros(100)), "click": (8000, np.eye(1, 400, 7)[0]), "none": (8000, np.zeros(0))}
    for k, (rate, x) in sound.items():
        (tmp_path / f"{k}.wav").write_bytes(audio.encode_wav(rate, x))
    import wave

    with wave.open(str(tmp_path / "stereo.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, -5], [200, -6]], "<i2").tobytes())
    (tmp_path / "junk.wav").write_bytes(b"RIFFjunk")
    listing = spark.createDataFrame([(k, str(tmp_path / f"{k}.wav")) for k in (*sound, "stereo", "junk", "absent")] + [("uri", f"file://{tmp_path}/zero.wav")], "key string, path string")
    got = {r["key"]: r for r in audio.load(listing).collect()}
    for k, (rate, x) in sound.items():
        assert got[k]["rate"] == rate and np.allclose(got[k]["samples"], x, atol=1e-4), k
    assert got["stereo"]["samples"] == pytest.approx([100 / 32767, 200 / 32767])
    assert got["junk"]["error"] and got["absent"]["error"] and got["junk"]["samples"] is None and got["uri"]["error"] is None


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for d in ("speaker1", "speaker2"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "test.wav").write_bytes(audio.encode_wav(8000, np.zeros(4)))
    assert sorted(r["key"] for r in listings.read_directory(spark, str(tmp_path)).collect()) == ["speaker1/test.wav", "speaker2/test.wav"]
    assert [r["key"] for r in listings.directory_to_scp(spark, str(tmp_path)).collect()] == ["test", "test"]


def test_one_transcript_a_file(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("two\n lines ")
    assert [tuple(r) for r in listings.transcripts_from_folder(spark, str(tmp_path)).collect()] == [("a.b", "two lines")]


def test_score_lines_of_all_sorts(spark, tmp_path):
    path = lines(tmp_path, "r.jsonl", '{"key": "a", "x": 1, "y": null, "z": NaN, "s": "t", "n": {"q": 1}, "b": true}', "", '{"key": "b", "x": -Infinity}', "{broken", '{"x": 2}', '{"key": "a", "x": 3}')
    got = sorted((r["key"] or "", r["metric"], r["value"]) for r in files.read_scores(spark, path).filter("not isnan(value)").collect())
    assert got == [("", "x", 2.0), ("a", "b", 1.0), ("a", "x", 1.0), ("a", "x", 3.0), ("b", "x", -math.inf)]
    assert {r["key"]: r["line"] for r in files.read_done(spark, path).collect()} == {"a": '{"key": "a", "x": 3}', "b": '{"key": "b", "x": -Infinity}'}
    assert files.bad_lines(spark.read.text(path)).count() == 2


def test_configurations(tmp_path):
    assert files.read_config(lines(tmp_path, "a.yaml", "- name: stoi", "- {name: pesq, x: 1}")) == [{"name": "stoi"}, {"name": "pesq", "x": 1}]
    for text in ("name: stoi", "- stoi", "- {x: 1}"):
        with pytest.raises(ValueError):
            files.read_config(lines(tmp_path, "b.yaml", text))


def test_text_cleaner(spark):
    df = spark.createDataFrame([("Hello, <noise> WORLD! (laughs)  it's [x] fine…",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(C.cleaned_text("t")).collect()] == ["hello world it s fine", None, ""]
    assert df.select(C.cleaned_text("t", None)).first()[0].startswith("Hello, <noise>")
    with pytest.raises(ValueError):
        C.cleaned_text("t", "other")


ITEMS = "key string, rate int, samples array<double>"


@pytest.fixture(scope="module")
def gen(spark):
    return spark.createDataFrame([("a", 10, [1.0, 2.0] * 10), ("b", 10, [3.0] * 20), ("c", 10, [1.0]), ("d", 10, [-1.0, 4.0] * 10), ("e", 10, []), ("f", 10, None)], ITEMS)


def test_rejected_items_have_a_reason(gen):
    good, bad = scoring.prepared(gen, None, None, ["stoi"])
    assert [r["key"] for r in good.collect()] == ["a", "d"]
    assert {r["key"]: r["reason"] for r in bad.collect()} == {"b": "constant", "c": "too short", "e": "too short", "f": "too short"}


def test_registry_contract(spark, gen, caplog):
    r = Registry()
    first = lambda df, config: F.struct((F.col("samples")[0] * config.get("by", 1)).alias("value"))
    r.register(Metric("one", "independent", "float", ("value",), aliases=("uno",), score=first, dependencies=("no_such_package", "math")))
    r.register(Metric("two", "independent", "float", ("value",)))
    with caplog.at_level(logging.WARNING):
        chosen = suite(r, [{"name": "uno", "by": 2}, {"name": "two"}, {"name": "three"}])
        r.discover([lambda x: 1 / 0, lambda x: x.register(Metric("four", "independent", "float", ("v",)))])
    assert list(chosen.metrics) == ["uno"] and "four" in r.metrics
    said = " ".join(caplog.messages)
    assert all(x in said for x in ("no_such_package", "two has no plug-in", "unknown metric: three", "division by zero")) and "math" not in said
    assert {x["key"]: x["uno"] for x in scoring.score(gen, [{"name": "uno", "by": 2}], r).collect()} == {"a": 2.0, "d": -2.0}
    with pytest.raises(ValueError):
        create(r, "nobody")
    r.bind("two", isolated(lambda x: 1 / x[0] if x[0] > 0 else float("x"), "samples"))
    got = {x["key"]: (x["two"], x["two_error"]) for x in scoring.score(gen, [{"name": "two"}], r, errors=True).collect()}
    assert got["a"] == (1.0, None) and got["d"][0] is None and got["d"][1].startswith("ValueError")
    r.bind("two", column_plugin("two"), inputs=("two",))
    assert scoring.score(gen.withColumn("two", F.lit(7.0)), [{"name": "two"}], r).first()["two"] == 7.0


def test_hooks(gen):
    r = Registry()
    total = lambda df, config: F.struct(C.total("samples").alias("value"))
    r.register(Metric("sum", "independent", "float", ("value",), score=total, preprocess=lambda df: df.withColumn("samples", F.transform("samples", lambda x: x * 10))))
    r.register(Metric("plain", "independent", "float", ("value",), score=total))
    r.bind("sum", validate=lambda df: F.col("key") != "d", postprocess=lambda m: F.struct((m["value"] + 1).alias("value")))
    got = scoring.score(gen, [{"name": "sum"}, {"name": "plain"}], r).collect()
    assert {x["key"]: (x["sum"], x["plain"]) for x in got} == {"a": (301.0, 30.0), "d": (None, 30.0)}


def test_utterance_and_metric_mode_differ_in_minimum_lengths(spark):
    half = spark.createDataFrame([("half", 64, [0.1, 0.2] * 16, 3.0, 4.0)], ITEMS + ", pesq double, visqol double")
    config, r = [{"name": "pesq"}, {"name": "visqol"}], default_registry()
    assert scoring.score(half, config, r, half.select("key", "rate", "samples")).count() == 0
    row = scoring.score_by_metric(half, config, r, half.select("key", "rate", "samples")).first().asDict()
    assert row["pesq"] == 3.0 and row.get("visqol") is None


def test_plain_functions(spark, gen, tmp_path):
    config = [{"name": "swr"}, {"name": "kid"}, {"name": "stoi"}]
    modules = facade.load_score_modules(config, use_gt=False, use_gt_text=True)
    assert list(modules.metrics) == ["swr"]
    text = spark.createDataFrame([("a", "one two"), ("d", "three")], "key string, text string")
    got = facade.list_scoring(gen, modules, text=text, path=str(tmp_path / "out"))
    assert facade.load_summary(got) == {"speaking_rate": pytest.approx(0.75)}
    assert files.read_done(spark, str(tmp_path / "out")).count() == 2
    for empty in (facade.load_score_modules, facade.load_corpus_modules):
        with pytest.raises(ValueError):
            empty([])
    vectors = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(8)], "key int, embedding array<double>")
    path = str(tmp_path / "corpus.yaml")
    found = facade.corpus_scoring(vectors, facade.load_corpus_modules([{"name": "fad", "use_inf": False}, {"name": "kid"}, {"name": "clap"}]), vectors, path=path)
    assert sorted(found) == ["fad_overall", "kid"] and found == files.read_corpus(path) and abs(found["fad_overall"]) < 1e-6


def test_merged_tables_keep_the_last_row_over_several_runs(spark, tmp_path):
    from scorelake.streaming import incremental

    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "key long, n long, value string"
    assert incremental.latest(spark, target) is None
    want: dict[int, tuple] = {}
    for run in range(4):
        rows = [(k, 100 * run + k % 7, f"{run}-{k}") for k in range(run * 10, run * 10 + 25)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.stream_table(spark, source, spark.createDataFrame([], schema).schema)
        incremental.merge_latest(stream, target, check, "n", buckets=4).awaitTermination()
        want |= {k: (k, n, v) for k, n, v in rows}
        got = incremental.latest(spark, target)
        assert got.columns == ["key", "n", "value"] and sorted(map(tuple, got.collect())) == sorted(want.values())
    held = incremental._bucket_paths(spark, target)
    assert sorted(held) == [0, 1, 2, 3] and max(map(len, held.values())) <= 2
