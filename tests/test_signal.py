"""Chroma and enhancement scores: all features, and the configuration reaches them."""

import numpy as np
import pytest

from scorelake.functions import signal
from scorelake.plans import catalog
from scorelake.registry import default_registry, suite


def tone(*hertz, rate=22_050, seconds=1.0):
    t = np.arange(int(rate * seconds)) / rate
    return sum(np.sin(2 * np.pi * f * t) for f in hertz)


def test_constant_q_equals_kernels_in_time():
    x, rate, hop = np.random.default_rng(1).normal(size=9000), 22_050, 512
    got = signal.constant_q(x, rate, hop)
    for k in (60, 130, 250):
        f = 440 * 2 ** (-45 / 12 + k / 36)
        size = rate / (2 ** (1 / 36) - 1) / f
        u = np.arange(-int(size / 2), int(size / 2) + 1)
        kernel = (1 + np.cos(2 * np.pi * u / size)) / size * np.exp(2j * np.pi * f * u / rate)
        pad = np.pad(x, len(u))
        want = [abs(pad[i * hop + len(u) + u] @ kernel.conj()) * size**0.5 for i in range(len(got))]
        assert np.allclose(got[:, k], want, rtol=0.01, atol=0.01 * max(want)), k


@pytest.mark.parametrize("hertz,pitch", [(261.63, 0), (440.0, 9), (1046.5, 0), (92.5, 6)])
def test_pitch_classes(hertz, pitch):
    assert (signal.chroma_cqt(tone(hertz), 22_050)[8:-8].argmax(axis=1) == pitch).all()
    cens = signal.chroma_cens(tone(hertz), 22_050)
    assert cens.shape == (1 + 22_050 // 512, 12) and (cens.argmax(axis=1) == pitch).all()


def test_all_features_and_their_distances():
    a, b = tone(261.63, 329.63), tone(277.18, 440.0)
    got = signal.chroma_distances(a, b)
    assert list(got)[:6] == [f"chroma_{n}_{m}_dtw" for n in ("stft", "cqt", "cens") for m in ("cosine", "euclidean")] and len(got) == 8
    assert min(list(got.values())[:6]) > 1
    assert max(list(signal.chroma_distances(a, a).values())[:6]) < 1e-3


def test_configuration_reaches_the_scores(spark):
    a, b = (tone(f, rate=16_000, seconds=0.5).tolist() for f in (261.63, 300.0))
    df = spark.createDataFrame([("k", 16_000, a, b)], "key string, rate int, samples array<double>, ref_samples array<double>")
    run = lambda **c: suite(default_registry(), [c]).apply(df).first().asDict()
    whole, part = run(name="chroma_alignment"), run(name="chroma_alignment", feature_types=["cqt"], scale_factor=1.0)
    assert "chroma_cqt_cosine_dtw" in whole and sorted(part) == sorted(["key", *signal.chroma_fields(["cqt"])])
    assert abs(part["chroma_cqt_cosine_dtw"] * 100 - whole["chroma_cqt_cosine_dtw"]) < 1e-6
    assert run(name="chroma_alignment", normalize_by_path=False)["chroma_cqt_cosine_dtw"] > whole["chroma_cqt_cosine_dtw"]
    with pytest.raises(ValueError):
        signal.chroma_fields(["vqt"])
    one, two = run(name="pysepm"), run(name="pysepm", frame_len=0.06, overlap=0.5)
    assert one["pysepm_llr"] != two["pysepm_llr"] and one["pysepm_ncm"] == two["pysepm_ncm"]
