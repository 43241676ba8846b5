"""Queries of WAV files, of models in a registry, and of factorisation over blocks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors, models
from ..sources import wav
from ..store import shared_dir
from . import frames, spectra
from .spectra import SIG, SR, R, sig

QUERIES, ORACLE_SQL = {}, {}


def add(name, query, sql=None, digits=6):
    spectra.add(name, query, sql, digits)
    QUERIES[name] = spectra.QUERIES.pop(name)
    if sql:
        ORACLE_SQL[name] = spectra.ORACLE_SQL.pop(name)


def files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder with a WAV file for each event signal, divided by its greatest value."""
    folder = f"{shared_dir(spark)}/wav-{uuid.uuid4().hex}"
    top = F.greatest(F.array_max("samples"), F.lit(1e-9))
    wav.write(sig(spark, sf_dir).select("signal_id", "sr", F.transform("samples", lambda y: y / top).alias("samples")), folder, kind)
    return folder


def named(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("signal_id", F.regexp_extract("path", r"([^/]+)\.wav$", 1))


def samples(blocks: DataFrame, size: int) -> DataFrame:
    return named(blocks).select("signal_id", "block", F.posexplode("samples").alias("i", "v")).select("signal_id", (F.col("block") * size + F.col("i")).alias("idx"), "v")


SCALED = f"{SIG}, x AS (SELECT signal_id, idx, y / greatest(max(y) OVER (PARTITION BY signal_id), 1e-9) AS x FROM sig)"
add("load", lambda s, d: samples(wav.read_blocks(s, files(s, d, "pcm16"), blockFrames=100), 100), f"WITH {SCALED} SELECT signal_id, idx, {R('floor(x * 32767 + 0.5) / 32768')} AS v FROM x")
# from second 5 on for 10 seconds, at 32 samples a second
add("load_excerpt", lambda s, d: samples(wav.read_blocks(s, files(s, d, "float32"), blockFrames=64, offset=5, duration=10), 64), f"WITH {SCALED} SELECT signal_id, idx - 160 AS idx, {R('CAST(CAST(x AS FLOAT) AS DOUBLE)')} AS v FROM x WHERE idx BETWEEN 160 AND 479")
HEADERS = "path string, sr double, channels int, frames bigint, duration double"
add("info", lambda s, d: named(wav.read_blocks(s, files(s, d, "pcm16"), HEADERS)).select("signal_id", "sr", F.col("channels").cast("bigint").alias("channels"), "frames", "duration"), f"WITH {SIG} SELECT signal_id, 32.0 AS sr, CAST(1 AS BIGINT) AS channels, count(*) AS frames, {R('count(*) / 32.0')} AS duration FROM sig GROUP BY 1".replace("32.0 AS sr", f"CAST({SR} AS DOUBLE) AS sr"))
add("get_samplerate", lambda s, d: named(wav.read_blocks(s, files(s, d, "float32"), "path string, sr double")).select("signal_id", "sr"), f"WITH {SIG} SELECT DISTINCT signal_id, CAST({SR} AS DOUBLE) AS sr FROM sig")


def network() -> list[models.Layer]:
    """64 to 8 to 3, with weights by a formula."""
    i, j = np.indices((64, 8))
    k, m = np.indices((8, 3))
    return [models.Layer("dense", ((i * 7 + j * 3) % 11 - 5) / 10, (np.arange(8) - 3) / 10, "relu"), models.Layer("dense", ((k * 5 + m * 2) % 7 - 3) / 10, np.arange(3) / 10, "sigmoid")]


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's outputs, by way of a registry."""
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    models.save(spark, folder, "toy", network())
    out = models.predict(frames.numbered(spark, sf_dir), models.load(spark, folder, "toy"))
    return out.select("signal_id", "i", F.posexplode("v").alias("k", "v")).select("signal_id", "i", F.col("k").cast("bigint").alias("k"), "v")


add("predict_model", predicted, f"""WITH {frames.FR}, one AS (SELECT signal_id, i, j, greatest(0, sum(x * ((k * 7 + j * 3) % 11 - 5) / 10.0) + (j - 3) / 10.0) AS x FROM c CROSS JOIN (SELECT unnest(range(0, 8)) AS j) GROUP BY 1, 2, 3),
two AS (SELECT signal_id, i, m, sum(x * ((j * 5 + m * 2) % 7 - 3) / 10.0) + m / 10.0 AS x FROM one CROSS JOIN (SELECT unnest(range(0, 3)) AS m) GROUP BY 1, 2, 3) SELECT {frames.ID}, i, m AS k, {R('1 / (1 + exp(-x))')} AS v FROM two""")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.predict_chunks(frames.numbered(spark, sf_dir), [models.Layer("center", np.zeros(0), np.zeros(0))], 8, 4)
    return out.select("signal_id", "i", F.posexplode("v").alias("k", "v")).select("signal_id", "i", F.col("k").cast("bigint").alias("k"), "v")


# chunks of 8 begin every 4 rows; each is put 4 rows before the end of those before it, so the last one 4 rows before the end of all; what overlaps is averaged in turn
add("chunked_inference", chunked, f"""WITH {frames.FR}, {frames._N}, q AS (SELECT signal_id, n, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE n END, 4)) AS s FROM s),
p AS (SELECT signal_id, s, CASE WHEN s > 0 AND s + 4 >= n THEN n - 4 ELSE s END + i - s AS i, k, x - avg(x) OVER (PARTITION BY signal_id, s, k) AS v FROM c JOIN q USING (signal_id) WHERE i BETWEEN s AND s + 7)
SELECT {frames.ID}, i, k, {R('list_reduce(list(v ORDER BY s), lambda a, b: (a + b) / 2)')} AS v FROM p GROUP BY 1, 2, 3""")


def factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five rounds leave of the magnitudes of each label's embeddings."""
    rows = frames.numbered(spark, sf_dir).select("signal_id", "i", F.transform("v", F.abs).alias("v"))
    return factors.Factors(rows, 4, 5, block=64).error()


add("nmf_blocks", factored)
