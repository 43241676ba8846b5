"""Operators over blocks of the event signals: what the queries of the other modules are made of where state runs through a signal, and queries of halo frames and as-of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, halo, scans
from ..sources import signals as src

#: samples of a block; signals of events are short, and should still have several
LENGTH = 240
FRAMES = 16


def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halo.blocks_of(src.hourly_events(spark, sf_dir), LENGTH)


def recurrence(r: scans.Recurrence, columns: int = 1):
    """A query of a recurrence over the samples."""
    return lambda s, d: halo.samples_of(scans.filtered(sample_blocks(s, d), r, columns, span=2), LENGTH)


def frames(spark: SparkSession, sf_dir: str, size: int, hop: int, center: bool = False) -> DataFrame:
    return halo.stft(sample_blocks(spark, sf_dir), LENGTH, size, hop, center)


def magnitude(re: str = "re", im: str = "im"):
    return F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b))


def frame_blocks(frames: DataFrame, per_block: int = FRAMES) -> DataFrame:
    """signal_id, block, x (the values of its frames, one after another) from (signal_id, frame, v)."""
    each = frames.groupBy("signal_id", F.floor(F.col("frame") / per_block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("f"))
    return each.select("signal_id", "block", F.flatten(F.transform("f", lambda f: f["v"])).alias("x"))


def pcen(spark: SparkSession, sf_dir: str, size: int, hop: int, sr: float, time_constant: float, gain: float = 0.98, bias: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """signal_id, frame, bin, v: each bin over its running mean, which begins with the first frame."""
    t = sr / (hop * 2 * np.pi * time_constant)
    b = float((np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t))
    bins = size // 2 + 1
    x = frame_blocks(frames(spark, sf_dir, size, hop).select("signal_id", "frame", magnitude().alias("v")))
    mean = scans.filtered(x, scans.one_pole(1 - b, b), bins, start=lambda row: row, span=2)
    both = x.join(mean, ["signal_id", "block"]).select("signal_id", "block", F.posexplode(F.arrays_zip("x", "y")).alias("at", "p"))
    level = F.sqrt(F.col("p.x") / F.pow(F.col("p.y") + eps, F.lit(gain)) + bias) - float(np.sqrt(bias))
    return both.select("signal_id", (F.col("block") * FRAMES + F.floor(F.col("at") / bins)).alias("frame"), F.pmod("at", F.lit(bins)).cast("bigint").alias("bin"), level.alias("v"))


def istft(spark: SparkSession, sf_dir: str, size: int, hop: int) -> DataFrame:
    """signal_id, idx, v: the signal from its centred frames."""
    samples = src.hourly_events(spark, sf_dir)
    lengths = samples.groupBy("signal_id").agg((F.max("idx") + 1).alias("n"))
    back = halo.istft(frames(spark, sf_dir, size, hop, True), lengths, LENGTH, hop)
    return halo.samples_of(back, LENGTH, "x")


def two_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of log scores of the states off and on, whose probability is a quarter of the sample, cut to 0.001 and 0.999."""
    p = lambda y: F.least(F.greatest(y / 4, F.lit(0.001)), F.lit(0.999))
    return sample_blocks(spark, sf_dir).select("signal_id", "block", F.flatten(F.transform("x", lambda y: F.array(F.log(1 - p(y)), F.log(p(y))))).alias("x"))


def chain(loop: float = 0.9) -> scans.Chain:
    """Two states that each keep to themselves with probability `loop`."""
    return scans.Chain(np.log([0.5, 0.5]), np.log([[loop, 1 - loop], [1 - loop, loop]]))


def states(spark: SparkSession, sf_dir: str, c: scans.Chain | None = None) -> DataFrame:
    """signal_id, idx, state of the likeliest path."""
    return halo.samples_of((c or chain()).viterbi(two_states(spark, sf_dir), span=2), LENGTH, name="state").withColumn("state", F.col("state").cast("bigint"))


def on_probability(spark: SparkSession, sf_dir: str, c: scans.Chain) -> DataFrame:
    """signal_id, idx, p of the state on."""
    out = c.posteriors(two_states(spark, sf_dir), span=2)
    ons = out.select("signal_id", "block", F.filter("y", lambda _, i: i % 2 == 1).alias("y"))
    return halo.samples_of(ons, LENGTH, name="p")


def timed(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(name), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def matched(direction: str, tolerance: float | None = None):
    """A query: each purchase with the user's click before, after or nearest it (-1 where there is none); gap in microseconds."""

    def run(spark, sf_dir):
        found = asof.asof(timed(spark, sf_dir, "purchase", "event_id"), timed(spark, sf_dir, "click", "click_id"), ["user_id"], "t", direction, tolerance, width=3600e6 * 24)
        return found.select("event_id", F.coalesce("click_id_right", F.lit(-1)).alias("click_id"), F.coalesce(F.col("t") - F.col("t_right"), F.lit(0)).alias("gap"))

    return run
