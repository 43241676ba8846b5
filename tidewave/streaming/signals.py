"""Structured Streaming over event streams and sample blocks.

Event-time windows have a watermark; state that grows with a signal (filters, onset
detection) is kept by key and bounded by one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of files, with ts as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_rms(events: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """RMS and count of value by event type over tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n"))
    return out.select("event_type", F.col("w.start").alias("start"), "rms", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a type's events with gaps below `gap`, as split() has them for samples."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def filtered_blocks(blocks: DataFrame, coef: float = 0.97, mode: str = "append") -> DataFrame:
    """Pre-emphasis over a stream of (signal_id, block, samples): the last sample of a block is the next one's state.

    Blocks of a signal must come in order; those of one trigger are sorted by number.
    """

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for f in frames:
            for block, samples in f.sort_values("block")[["block", "samples"]].itertuples(index=False):
                y = np.asarray(samples, float)
                before = np.concatenate(([0.0 if last is None else last], y[:-1])) if len(y) else y
                last = float(y[-1]) if len(y) else last
                yield pd.DataFrame({"signal_id": [key[0]], "block": [block], "samples": [(y - coef * before).tolist()]})
        if last is not None:
            state.update((last,))

    return blocks.groupBy("signal_id").applyInPandasWithState(step, "signal_id string, block bigint, samples array<double>", "last double", mode, GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there. Append mode writes Parquet files exactly once; other modes replace the table by each batch's result."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("parquet").start(path) if mode == "append" else w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
