"""WAV files, models in a registry, factorisation over blocks: against bytes, kernels and whole matrices."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import factors, ml, models
from tidewave.sources import signals, wav

Y = np.random.default_rng(0).uniform(-1, 1, 1000)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_pcm_against_the_library(spark, tmp_path, bits):
    stereo = np.stack([Y, -Y], axis=1)
    scale = float(1 << (bits - 1))
    ints = np.clip(np.round(stereo * scale), -scale, scale - 1).astype(np.int64)
    raw = (ints + 128).astype(np.uint8).tobytes() if bits == 8 else b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in ints.ravel())
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, bits // 8, 8000, 0, "NONE", ""))
        w.writeframes(raw)
    (tmp_path / "notes.txt").write_text("none")
    rows = sorted(wav.read_blocks(spark, str(tmp_path), blockFrames=300, mono="false").collect(), key=lambda r: r.block)
    assert [len(r.samples) for r in rows] == [600, 600, 600, 200] and {(r.sr, r.channels, r.frames) for r in rows} == {(8000.0, 2, 1000)}
    assert np.allclose(np.concatenate([r.samples for r in rows]).reshape(-1, 2), ints / scale)
    mono = wav.read_blocks(spark, str(tmp_path)).first().samples
    assert np.allclose(mono, ints.mean(axis=1) / scale)
    assert np.allclose(signals.load(spark, str(tmp_path), sr=None).first().samples, mono)


def test_ranges_excerpts_headers_and_filters(spark, tmp_path):
    s = spark.createDataFrame([(k, 100.0, (Y * g).tolist()) for k, g in (("a", 1.0), ("b", 0.5))] + [("none", 100.0, [])], "signal_id string, sr double, samples array<double>")
    assert wav.write(s, str(tmp_path), "float32") == wav.write(s, str(tmp_path), "float32") == 3
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.wav", "b.wav", "none.wav"]
    # ranges that are shorter than a block, and cut it
    for step in (64, 1000, 1 << 20):
        rows = wav.read_blocks(spark, str(tmp_path), blockFrames=90, rangeBytes=step).where("path like '%b.wav'").orderBy("block").collect()
        assert [r.block for r in rows] == list(range(12)) and np.allclose(np.concatenate([r.samples for r in rows]), np.float32(Y * 0.5))
    part = wav.read_blocks(spark, f"{tmp_path}/a.wav", offset=1.5, duration=3, blockFrames=200).orderBy("block").collect()
    assert np.allclose(np.concatenate([r.samples for r in part]), np.float32(Y[150:450])) and {r.frames for r in part} == {300}
    assert wav.read_blocks(spark, f"{tmp_path}/a.wav", offset=50).count() == 0
    heads = {r.path.split("/")[-1]: r.duration for r in wav.read_blocks(spark, str(tmp_path), "path string, duration double").collect()}
    assert heads == {"a.wav": 10.0, "b.wav": 10.0, "none.wav": 0.0}
    df = wav.read_blocks(spark, str(tmp_path), blockFrames=90).where("block >= 3 and block < 5")
    assert sorted((r.path[-5:], r.block) for r in df.collect()) == [("a.wav", 3), ("a.wav", 4), ("b.wav", 3), ("b.wav", 4)]
    one = wav.read_blocks(spark, str(tmp_path), blockFrames=90).where(F.col("path") == f"{tmp_path}/a.wav").where("block = 11")
    assert [len(r.samples) for r in one.collect()] == [10]


def test_not_wav(tmp_path):
    import io

    for raw in (b"RIFF\0\0\0\0WAVX", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + b"\x02\0\x01\0" + b"\0" * 12 + b"data\0\0\0\0"):
        with pytest.raises(ValueError):
            wav.header(io.BytesIO(raw))


def network(rng):
    return [models.Layer("dense", rng.normal(size=(5, 4)), rng.normal(size=4), "tanh"), models.Layer("norm", np.abs(rng.normal(size=(4, 4))) + 0.1, np.zeros(0)), models.Layer("dense", rng.normal(size=(4, 2)), rng.normal(size=2), "softmax")]


def test_registry(spark, tmp_path):
    rng = np.random.default_rng(1)
    layers, folder = network(rng), str(tmp_path / "models")
    models.save(spark, folder, "one", layers[:1])
    models.save(spark, folder, "two", layers)
    models.save(spark, folder, "one", layers[2:])  # takes the place of the first
    assert sorted(map(tuple, models.available(spark, folder).collect())) == [("one", 1, 10), ("two", 3, 24 + 16 + 10)]
    x = rng.normal(size=(30, 5))
    frames = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "signal_id string, i long, v array<double>")
    got = models.predict(frames, models.load(spark, folder, "two")).orderBy("i").collect()
    assert np.allclose([r.v for r in got], models._graph(layers, x))
    assert models.predict(frames.limit(0), layers).count() == 0
    with pytest.raises(KeyError):
        models.load(spark, folder, "three")
    with pytest.raises(ValueError):
        models.load(spark, folder, "two", max_bytes=100)
    with pytest.raises(ValueError):
        models.predict(frames, [models.Layer("center", np.zeros(0), np.zeros(0))])


@pytest.mark.parametrize("merge", ["average", "max", "overlap"])
@pytest.mark.parametrize("size, hop", [(8, 4), (8, 3), (6, 2), (5, 5)])
def test_chunks_of_a_recurrent_model(spark, merge, size, hop):
    rng = np.random.default_rng(size)
    layers = [models.Layer("gru", rng.normal(size=(3 + 2, 6)), np.zeros(6)), models.Layer("dense", rng.normal(size=(2, 2)), np.zeros(2))]
    parts = {k: rng.normal(size=(n, 3)) for k, n in {"a": 1, "b": 8, "c": 22, "d": 23, "e": 40}.items()}
    frames = spark.createDataFrame([(k, i, v.tolist()) for k, m in parts.items() for i, v in enumerate(m)], "signal_id string, i long, v array<double>")
    got = {}
    for r in models.predict_chunks(frames, layers, size, hop, merge).orderBy("signal_id", "i").collect():
        got.setdefault(r.signal_id, []).append(r.v)
    for k, m in parts.items():
        assert np.allclose(got[k], ml.chunked(lambda x: models._graph(layers, x), m, size, hop, merge))


@pytest.mark.parametrize("block", [4, 1000])
def test_factors(spark, block):
    rng = np.random.default_rng(2)
    parts = {"a": rng.random((30, 3)) @ rng.random((3, 7)), "b": rng.random((5, 4))}
    rows = spark.createDataFrame([(k, i, v.tolist()) for k, m in parts.items() for i, v in enumerate(m)], "signal_id string, i long, v array<double>")
    made = factors.Factors(rows, 3, 4, block)
    errors = {r.signal_id: r.error for r in made.error().collect()}
    ws = {(r.signal_id, r.i): r.w for r in made.factors().collect()}
    for key, v in parts.items():
        scale = np.sqrt(v.mean() / 3)
        w, h = factors.started(np.arange(len(v)), 3) * scale + 1e-10, factors.started(np.arange(3) + (1 << 40), v.shape[1]) * scale + 1e-10
        for _ in range(4):
            h = h * (w.T @ v) / (w.T @ w @ h + 1e-10)
            w = w * (v @ h.T) / (w @ h @ h.T + 1e-10)
        assert np.allclose(made.h[key], h) and np.allclose([ws[key, i] for i in range(len(v))], w)
        assert np.isclose(errors[key], np.linalg.norm(v - w @ h) / np.linalg.norm(v), atol=1e-8)
