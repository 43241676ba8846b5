"""Signals from tables, files and formulas.

A signals table has a row for each signal: signal_id, sr, samples (array of double).
"""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lift import lift


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id (event type), idx (hour from the table's first one on, to its last), y (sum of value / 97.317, which leaves no round numbers, 0 where there are no events)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    sums = e.where("hour is not null").groupBy(F.col("event_type").alias("signal_id"), "hour").agg((F.sum("value") / 97.317).alias("y"))
    hours = sums.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))  # one row
    grid = sums.select("signal_id").distinct().join(F.broadcast(hours)).select("signal_id", "first", F.explode(F.sequence("first", "last").cast("array<bigint>")).alias("hour"))
    return grid.join(sums, ["signal_id", "hour"], "left").select("signal_id", (F.col("hour") - F.col("first")).alias("idx"), F.coalesce("y", F.lit(0.0)).alias("y"))


def packed_signals(tidy: DataFrame, sr: float = 1.0) -> DataFrame:
    """signals from (signal_id, idx, y)."""
    return tidy.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "y"))), lambda x: x["y"]).alias("samples")).select("signal_id", F.lit(sr).cast("double").alias("sr"), "samples")


def event_signals(spark: SparkSession, sf_dir: str, sr: float = 1.0) -> DataFrame:
    return packed_signals(hourly_events(spark, sf_dir), sr)


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame (vec_id), v (array of double), label: each embedding as a frame of 64 bins."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("label"))


# --- files ----------------------------------------------------------------------


def _wav(content: bytes):
    with wave.open(io.BytesIO(bytes(content))) as w:
        n, width, channels, sr = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return sr, x.reshape(-1, channels)


def load(spark: SparkSession, path: str, sr: float | None = 22050, mono: bool = True, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """signals from PCM WAV files: seeked, cut, mixed down and resampled. Past the end: no samples. Not mono: the first channel. sr None keeps the file's rate."""
    from ..operators.spectral import resample

    def read(content):
        rate, x = _wav(content)
        a = int(offset * rate)
        x = x[a : a + int(duration * rate)] if duration is not None else x[a:]
        y = x.mean(axis=1) if mono else x[:, 0]
        yield float(sr or rate), resample(y, rate, sr) if sr and sr != rate else y

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return lift(files.select(F.col("path").alias("signal_id"), "content"), read, ["content"], "sr double, samples array<double>")


def info(spark: SparkSession, path: str) -> DataFrame:
    """signal_id, sr, duration of WAV files, from their headers."""

    def read(content):
        with wave.open(io.BytesIO(bytes(content))) as w:
            yield float(w.getframerate()), w.getnframes() / w.getframerate()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return lift(files.select(F.col("path").alias("signal_id"), "content"), read, ["content"], "sr double, duration double")


def get_duration(signals: DataFrame) -> DataFrame:
    return signals.select("signal_id", (F.size("samples") / F.col("sr")).alias("duration"))


def blocks(signals: DataFrame, length: int, fill: float | None = None) -> DataFrame:
    """signal_id, block, samples: cut into blocks; the last is short, or filled."""
    cut = signals.select("signal_id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("samples") / length) - 1, F.lit(0)).cast("int"))).alias("block"), "samples")
    part = F.slice("samples", F.col("block") * length + 1, length)
    if fill is not None:
        part = F.concat(part, F.array_repeat(F.lit(float(fill)), length - F.size(part)))
    return cut.select("signal_id", F.col("block").cast("bigint").alias("block"), part.alias("samples"))


def write(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").parquet(path)


# --- generators -----------------------------------------------------------------


def _grid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "idx")


def _length(sr: float, length: int | None, duration: float | None) -> int:
    return int(duration * sr) if duration is not None else int(length if length is not None else sr)


def tone(spark: SparkSession, frequency: float, sr: float = 22050.0, length: int | None = None, duration: float | None = None, phi: float = 0.0) -> DataFrame:
    """idx, y of a sine; a duration outweighs a length, and the default is one second."""
    return _grid(spark, _length(sr, length, duration)).select("idx", F.sin(F.col("idx") * (2 * np.pi * frequency) / sr + phi).alias("y"))


def chirp(spark: SparkSession, fmin: float, fmax: float, sr: float = 22050.0, length: int | None = None, duration: float | None = None, linear: bool = True) -> DataFrame:
    """idx, y of a sweep; an exponential one of a bound that isn't positive is silent."""
    n = _length(sr, length, duration)
    t, total = F.col("idx") / sr, n / sr
    if linear:
        phase: Column = fmin * t + (fmax - fmin) / (2 * total) * t * t
    elif fmin <= 0 or fmax <= 0:
        phase = F.lit(0.0)
    else:
        k = np.log(fmax / fmin) / total
        phase = fmin * F.expm1(k * t) / k
    return _grid(spark, n).select("idx", F.sin(2 * np.pi * phase).alias("y"))


def clicks(times: DataFrame, sr: float = 22050.0, length: int | None = None, freq: float = 1000.0, duration: float = 0.1) -> DataFrame:
    """signal_id, idx, y: sines that fall to e^-5 over `duration`, added at each (signal_id, time), cut to whole samples, or (signal_id, frame). Samples without a click are left out."""
    n = int(duration * sr)
    begin = F.col("frame").cast("bigint") if "frame" in times.columns else (F.col("time") * sr).cast("bigint")
    each = times.select("signal_id", begin.alias("at")).where("at >= 0").select("signal_id", "at", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("k"))
    t = F.col("k") / sr
    out = each.select("signal_id", (F.col("at") + F.col("k")).alias("idx"), (F.sin(2 * np.pi * freq * t) * F.exp(-5 / duration * t)).alias("y"))
    out = out.where(F.col("idx") < length) if length is not None else out
    return out.groupBy("signal_id", "idx").agg(F.sum("y").alias("y"))


def default_clicks(spark: SparkSession, sr: float = 22050.0, length: int | None = None) -> DataFrame:
    """signal_id, time of a click every half second of `length` samples, or of 5 seconds."""
    seconds = length / sr if length is not None else 5.0
    return spark.range(int(seconds / 0.5)).select(F.lit("clicks").alias("signal_id"), (F.col("id") * 0.5).alias("time"))
