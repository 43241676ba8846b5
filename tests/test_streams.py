"""Streams of blocks against whole signals: out of order, missing, late."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import rhythm
from tidewave.sources import wav
from tidewave.streaming import blocks as sb

SCHEMA = "signal_id string, block bigint, ts timestamp, samples array<double>"
LENGTH = 50


def signal(n, seed):
    return np.random.default_rng(seed).random(n) * 4


def run(spark, folder, batches, processor, output, late="1 hour"):
    """Batches of (signal, block) pairs, one after another; a block's time is 100 s a number."""
    ys = {"a": signal(520, 1), "b": signal(300, 2)}
    os.makedirs(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    out = sb.in_turn(source, processor, output, late)
    q = out.writeStream.outputMode("append").format("memory").queryName("got_" + os.path.basename(folder)).option("checkpointLocation", f"{folder}/log").start()
    try:
        for batch in batches:
            rows = [(k, b, 1_700_000_000 + 100 * b, ys[k][b * LENGTH : (b + 1) * LENGTH].tolist()) for k, b in batch]
            df = spark.createDataFrame(rows, "signal_id string, block bigint, t bigint, samples array<double>")
            df.select("signal_id", "block", F.timestamp_seconds("t").alias("ts"), "samples").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            q.processAllAvailable()
        return ys, spark.table(q.name).collect()
    finally:
        q.stop()


ALL = [("a", b) for b in range(11)] + [("b", b) for b in range(6)]


def test_comb_filter_out_of_order(spark, tmp_path):
    order = [[("a", 1), ("a", 2), ("b", 0)], [("a", 0), ("b", 3)], [("b", 1), ("b", 2), ("a", 5), ("a", 4)], [("a", 3), ("b", 5), ("b", 4)], [("a", b) for b in range(10, 5, -1)]]
    ys, got = run(spark, str(tmp_path / "comb"), order, sb.CombFilter(LENGTH, 24, 0.9), "block bigint, samples array<double>")
    for k, y in ys.items():
        mine = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.block) if r.signal_id == k])
        assert np.allclose(mine, rhythm.comb_forward(y, 24, 0.9))


def test_peaks_over_block_ends(spark, tmp_path):
    order = [[("a", 0), ("b", 1)], [("a", 2), ("b", 0)], [("a", 1), ("a", 3), ("b", 2)], [*ALL[4:11], *ALL[14:]]]
    ys, got = run(spark, str(tmp_path / "peaks"), order, sb.PeakPicker(LENGTH, wait=7), "idx bigint")
    for k, y in ys.items():
        assert sorted(r.idx for r in got if r.signal_id == k) == rhythm.peak_pick(y, wait=7).tolist()


def test_missing_block_is_silence_once_the_watermark_has_passed(spark, tmp_path):
    # block 1 of a is late by more than 150 s when blocks 4 and more have been seen
    order = [[("a", 0)], [("a", 2), ("a", 3)], [("a", 4), ("a", 5)], [("a", 6)], [("a", 1)], [("a", 7)], [("b", 0)]]
    ys, got = run(spark, str(tmp_path / "late"), order, sb.CombFilter(LENGTH, 10, 0.5), "block bigint, samples array<double>", late="150 seconds")
    y = ys["a"][: 8 * LENGTH].copy()
    y[LENGTH : 2 * LENGTH] = 0
    mine = {r.block: r.samples for r in got if r.signal_id == "a"}
    want = rhythm.comb_forward(y, 10, 0.5)
    assert set(mine) == set(range(8))
    assert all(np.allclose(mine[b], want[b * LENGTH : (b + 1) * LENGTH]) for b in mine)


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_wav_stream(spark, tmp_path, per_trigger):
    ys = {"a": signal(520, 1) / 4, "b": signal(300, 2) / 4}
    s = spark.createDataFrame([(k, 100.0, y.tolist()) for k, y in ys.items()], "signal_id string, sr double, samples array<double>")
    wav.write(s, str(tmp_path / "files"), "float32")
    df = sb.read_wav(spark, str(tmp_path / "files"), blockFrames=LENGTH, blocksPerTrigger=per_trigger, rangeBytes=300)
    q = df.writeStream.format("memory").queryName(f"wav_{per_trigger}").option("checkpointLocation", str(tmp_path / "log")).start()
    try:
        q.processAllAvailable()
        got = spark.table(q.name).collect()
    finally:
        q.stop()
    for k, y in ys.items():
        mine = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.block) if r.path.endswith(f"{k}.wav")])
        assert np.array_equal(mine, np.float32(y))
