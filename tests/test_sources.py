import wave

import numpy as np
from pyspark.sql import functions as F

from tidewave.functions import units
from tidewave.sources import signals


def test_wav(spark, tmp_path):
    y = (np.sin(np.arange(8000) * 0.1) * 30000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(np.stack([y, np.zeros_like(y)], axis=1).tobytes())
    row = signals.load(spark, str(tmp_path), None).first()
    assert row.sr == 8000 and np.allclose(row.samples, y / 65536)
    assert np.allclose(signals.load(spark, str(tmp_path), None, mono=False).first().samples, y / 32768)
    assert len(signals.load(spark, str(tmp_path), 4000).first().samples) == 4000
    assert signals.load(spark, str(tmp_path), None, offset=5.0).first().samples == []
    assert signals.info(spark, str(tmp_path)).first().duration == 1.0


def test_blocks(spark):
    s = spark.createDataFrame([("a", 1.0, [1.0, 2.0, 3.0]), ("b", 1.0, [])], "signal_id string, sr double, samples array<double>")
    got = {(r.signal_id, r.block): r.samples for r in signals.blocks(s, 2).collect()}
    assert got == {("a", 0): [1.0, 2.0], ("a", 1): [3.0], ("b", 0): []}
    assert signals.blocks(s, 2, 9.0).where("signal_id = 'a' and block = 1").first().samples == [3.0, 9.0]


def test_notes(spark):
    d = spark.createDataFrame([("C4",), ("A#3",), ("B♭2",), ("Cb4",), ("x",), (None,), ("G",)], "s string").select("s", units.note_to_midi(F.col("s")).alias("m"))
    assert {r.s: r.m for r in d.collect()} == {"C4": 60, "A#3": 58, "B♭2": 46, "Cb4": 59, "x": None, None: None, "G": 19}


def test_hours_outside_january(spark, tmp_path):
    rows = [("a", 97.317, -3), ("a", 97.317, 800), ("b", 97.317, 10), ("b", None, 10)]
    spark.createDataFrame(rows, "event_type string, value double, h int").select("event_type", "value", F.timestamp_seconds(1704067200 + 3600 * F.col("h")).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = signals.hourly_events(spark, str(tmp_path)).collect()
    assert len(got) == 2 * 804 and {(r.signal_id, r.idx) for r in got if r.y} == {("a", 0), ("a", 803), ("b", 13)}
    assert {r.signal_id: len(r.samples) for r in signals.event_signals(spark, str(tmp_path)).collect()} == {"a": 804, "b": 804}
