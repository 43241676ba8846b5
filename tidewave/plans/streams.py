"""Queries that run a stream over the event table to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import signals as src
from ..store import shared_dir
from ..streaming import blocks as sb
from ..streaming import signals as st
from . import events, stored
from .spectra import SIG, R

QUERIES, ORACLE_SQL = {}, {}


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark, stream, mode) -> DataFrame:
    at = _folder(spark)
    st.run_to_table(stream, f"{at}/out", f"{at}/log", mode)
    return spark.read.parquet(f"{at}/out")


def _epoch(c):
    return F.unix_timestamp(F.col(c)).alias(c)


def stream_tumbling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, st.windowed_rms(st.read_events(spark, sf_dir)), "complete")
    return out.select("event_type", _epoch("start"), (F.round("rms", 6) + 0.0).alias("rms"), "n")


def stream_sliding_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, st.windowed_rms(st.read_events(spark, sf_dir), "6 hours", "2 hours"), "complete")
    return out.select("event_type", _epoch("start"), (F.round("rms", 6) + 0.0).alias("rms"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, st.sessions(st.read_events(spark, sf_dir)), "complete")
    return out.select("event_type", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n", (F.round("total", 4) + 0.0).alias("total"))


def stream_preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    blocks = src.blocks(src.event_signals(spark, sf_dir), 100)
    blocks.write.parquet(f"{at}/in")
    out = _run(spark, st.filtered_blocks(spark.readStream.schema(blocks.schema).parquet(f"{at}/in")), "append")
    return out.select("signal_id", "block", F.posexplode("samples").alias("i", "v")).select("signal_id", (F.col("block") * 100 + F.col("i")).alias("idx"), (F.round("v", 6) + 0.0).alias("v"))


def _when(block: str):
    """A time for each block of 100 hours; what is at 1970-01-01 or before would be late from the start."""
    return F.timestamp_seconds(1704067200 + F.col(block) * 360000)


def stream_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comb filter over WAV files read as a stream, by keyed state."""
    heard = sb.read_wav(spark, stored.files(spark, sf_dir, "float32"), blockFrames=100, blocksPerTrigger=1 << 30)
    timed = heard.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("signal_id"), "block", _when("block").alias("ts"), "samples")
    out = _run(spark, sb.in_turn(timed, sb.CombFilter(100, 24, 0.9048374180359595), "block bigint, samples array<double>", "365 days"), "append")
    return out.select("signal_id", "block", F.posexplode("samples").alias("i", "v")).select("signal_id", (F.col("block") * 100 + F.col("i")).alias("idx"), (F.round("v", 6) + 0.0).alias("v"))


def stream_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks over blocks that arrive in several files, whatever their order."""
    at = _folder(spark)
    blocks = src.blocks(src.event_signals(spark, sf_dir), 100).withColumn("ts", _when("block"))
    blocks.repartition(4, "block").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return _run(spark, sb.in_turn(stream, sb.PeakPicker(100), "idx bigint", "365 days"), "append").select("signal_id", "idx")


QUERIES |= {f.__name__: f for f in (stream_tumbling_rms, stream_sliding_rms, stream_sessions, stream_preemphasis, stream_comb, stream_peaks)}
ORACLE_SQL |= {
    "stream_tumbling_rms": f"SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, {R('sqrt(avg(value * value))')} AS rms, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding_rms": f"SELECT event_type, (CAST(floor(epoch(ts) / 7200) AS BIGINT) - k) * 7200 AS start, {R('sqrt(avg(value * value))')} AS rms, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(0, 3)) AS k) GROUP BY 1, 2",
    "stream_sessions": f"""WITH e AS (SELECT event_type, value, epoch_us(ts) AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT event_type, min(t) AS start, max(t) + 7200000000 AS stop, count(*) AS n, {R('sum(value)', 4)} AS total FROM g GROUP BY event_type, g""",
    "stream_comb": f"WITH {stored.SCALED} SELECT a.signal_id, a.idx, {R('sum(pow(CAST(0.9048374180359595 AS DOUBLE), (a.idx - b.idx) // 24) * CAST(CAST(b.x AS FLOAT) AS DOUBLE))')} AS v FROM x a JOIN x b ON a.signal_id = b.signal_id AND b.idx <= a.idx AND (a.idx - b.idx) % 24 = 0 GROUP BY 1, 2",
    "stream_peaks": events.ORACLE_SQL["peak_pick"],
    "stream_preemphasis": f"WITH {SIG} SELECT signal_id, idx, {R('y - 0.97 * coalesce(lag(y) OVER (PARTITION BY signal_id ORDER BY idx), 0)')} AS v FROM sig",
}
