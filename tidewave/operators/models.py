"""Models as tables of weights, and inference over frames.

A registry is a folder of Parquet with a row for each layer of each model: kind, activation, shape and numbers. A model
whose numbers fit `max_bytes` is sent to the tasks, where a batch of frames runs through all its
layers at once. Layers that look at neighbouring frames need them in one place: frames are dealt to overlapping chunks, a
row each, and the chunks' outputs are merged frame by frame, as `ml.chunked` does it for one signal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ml

_SCHEMA = "model string, layer int, kind string, activation string, shape array<int>, w array<double>, bias array<double>"
MAX_BYTES = 256 << 20


@dataclass(frozen=True)
class Layer:
    """kind: dense (w: in x out), norm (w: mean, variance, scale and shift by rows), gru, lstm or rnn (w: wx above wh, gates side by side), and center (takes the mean over a chunk away)."""

    kind: str
    w: np.ndarray
    bias: np.ndarray
    activation: str = "linear"

    def run(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "dense":
            return ml.dense(x, self.w, self.bias, self.activation)
        if self.kind == "norm":
            return ml.batch_norm(x, self.w[0], self.w[1], self.w[2], self.w[3])
        if self.kind == "center":
            return x - x.mean(axis=0)
        layer = {"gru": ml.gru, "lstm": ml.lstm, "rnn": ml.rnn}[self.kind]
        return layer(x, self.w[: x.shape[1]], self.w[x.shape[1] :], self.bias)

    @property
    def by_frame(self) -> bool:
        return self.kind in ("dense", "norm")


def save(spark: SparkSession, folder: str, name: str, layers: list[Layer]) -> None:
    """Adds a model, or takes the place of the one of that name."""
    rows = [(name, k, x.kind, x.activation, [int(n) for n in x.w.shape], x.w.ravel().tolist(), x.bias.ravel().tolist()) for k, x in enumerate(layers)]
    spark.createDataFrame(rows, _SCHEMA).drop("model").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/model={name}")


def available(spark: SparkSession, folder: str) -> DataFrame:
    """model, layers, numbers of every model in a registry."""
    t = spark.read.schema(_SCHEMA).option("basePath", folder).parquet(folder)
    return t.groupBy("model").agg(F.count("*").alias("layers"), F.sum(F.size("w") + F.size("bias")).cast("bigint").alias("numbers"))


def load(spark: SparkSession, folder: str, name: str, max_bytes: int = MAX_BYTES) -> list[Layer]:
    """A model's layers in order. Unknown names and models beyond the bound are refused before any number is read."""
    t = spark.read.schema(_SCHEMA).option("basePath", folder).parquet(folder).where(F.col("model") == name)
    numbers = t.agg(F.sum(F.size("w") + F.size("bias"))).first()[0]
    if numbers is None:
        raise KeyError(f"no model {name}")
    if 8 * numbers > max_bytes:
        raise ValueError(f"{name} has {8 * numbers} bytes, over {max_bytes}")
    return [Layer(r.kind, np.array(r.w).reshape(r.shape), np.array(r.bias), r.activation) for r in t.orderBy("layer").collect()]


def _graph(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer.run(x)
    return x


def predict(frames: DataFrame, layers: list[Layer]) -> DataFrame:
    """signal_id, i, v of a model whose layers look at one frame each. frames: signal_id, i, v."""
    if not all(x.by_frame for x in layers):
        raise ValueError("a layer needs neighbouring frames: use predict_chunks")
    sent = ship(frames.sparkSession).sparkContext.broadcast(layers)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()

    def run(it):
        for b in it:
            if b.num_rows:
                y = _graph(sent.value, np.asarray(b.column("v").flatten(), float).reshape(b.num_rows, -1))
                at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("signal_id"), b.column("i"), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(y).ravel()))], ["signal_id", "i", "v"])

    return frames.select("signal_id", F.col("i").cast("long").alias("i"), "v").mapInArrow(run, f"signal_id {kind}, i long, v array<double>")


def chunk_places(n, size: int, hop: int):
    """For a signal of n frames: an array of (start, at) of its chunks that the end cuts: which frames they have, and where their outputs are put."""
    first = F.greatest(F.ceil((n - size + 1) / hop), F.lit(1)).cast("bigint")
    starts = F.when(first * hop < n, F.sequence(first * hop, n - 1, F.lit(hop).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    kind = "struct<end:bigint,made:array<struct<start:bigint,at:bigint>>>"

    def put(acc, start):
        at = acc["end"] - (size - hop)
        return F.struct((at + F.least(n - start, F.lit(size))).alias("end"), F.concat(acc["made"], F.array(F.struct(start.alias("start"), at.alias("at")))).alias("made")).cast(kind)

    # the chunk before the first cut one is whole and ends `size` behind its start
    begin = F.struct(((first - 1) * hop + size).alias("end"), F.array().cast("array<struct<start:bigint,at:bigint>>").alias("made")).cast(kind)
    return F.when(n > size, F.aggregate(starts, begin, put)["made"]).otherwise(F.array().cast("array<struct<start:bigint,at:bigint>>"))


def predict_chunks(frames: DataFrame, layers: list[Layer], size: int, hop: int, merge: str = "average") -> DataFrame:
    """signal_id, i, v of a model over overlapping chunks of `size` frames, merged as by `ml.chunked`. frames: signal_id, i (from 0 without gaps), v."""
    sent = ship(frames.sparkSession).sparkContext.broadcast(layers)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()
    lengths = frames.groupBy("signal_id").agg((F.max("i") + 1).alias("n"))
    known = lengths.withColumn("cut", chunk_places(F.col("n"), size, hop))
    each = frames.join(known, "signal_id")
    lowest = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.greatest(F.ceil((F.col("i") - size + 1) / hop), F.lit(0))).cast("bigint")
    highest = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.floor(F.col("i") / hop)).cast("bigint")
    dealt = each.select("signal_id", "i", "v", "n", "cut", F.explode(F.sequence(lowest, highest)).alias("chunk"))
    rows = dealt.groupBy("signal_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("f"), F.first("cut").alias("cut"))
    start = F.col("chunk") * hop
    cut = F.filter("cut", lambda c: c["start"] == start)
    rows = rows.select("signal_id", "chunk", F.when(F.size(cut) > 0, cut[0]["at"]).otherwise(start).alias("at"), F.transform("f", lambda f: f["v"]).alias("m"))

    def run(it):
        for b in it:
            out: list[list] = [[], [], [], [], [], []]
            for k in range(b.num_rows):
                m = b.column("m")[k].values
                y = _graph(sent.value, np.asarray(m.flatten(), float).reshape(len(m), -1))
                at = b.column("at")[k].as_py()
                for j, row in enumerate(y):
                    for column, value in zip(out, (b.column("signal_id")[k].as_py(), b.column("chunk")[k].as_py(), at + j, j, min(size - hop, len(y)), row)):
                        column.append(value)
            kinds = (b.column("signal_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["signal_id", "chunk", "i", "j", "both", "v"])

    made = rows.mapInArrow(run, f"signal_id {kind}, chunk long, i long, j long, both long, v array<double>")
    parts = made.groupBy("signal_id", "i").agg(F.array_sort(F.collect_list(F.struct("chunk", "j", "both", "v"))).alias("p"))
    share = lambda x: x["j"] / F.greatest(x["both"], F.lit(1)) if merge == "overlap" else F.lit(0.5)

    def join(a, x):
        if merge == "max":
            return F.zip_with(a, x["v"], lambda u, w: F.greatest(u, w))
        return F.zip_with(a, x["v"], lambda u, w: (1 - share(x)) * u + share(x) * w)

    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    return parts.select("signal_id", "i", F.aggregate(rest, F.get("p", F.lit(0))["v"], join).alias("v"))
