"""Nonnegative matrix factorisation of matrices with any number of rows.

V (rows by bins) is approximated by W H. A row's factors depend on its own values and on H, so W
is updated where the rows are; H depends on W only by W'V and W'W, which blocks of rows contribute to
and one aggregation sums to k x bins and k x k numbers. Each round writes W anew to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..store import drop, staged

_EPS = 1e-10
_STATE = "i array<long>, v array<double>, w array<double>, top array<double>, gram array<double>, apart double"


def started(i: np.ndarray, k: int) -> np.ndarray:
    """First factors of rows by their numbers, in (0, 1): the same whatever block a row is in."""
    x = (i[:, None].astype(np.uint64) * np.uint64(k) + np.arange(k, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


class Factors:
    """V ~ W H of rows (signal_id, i, v), each signal on its own, or all as one where `signal_id` is the same; `h`: H by signal."""

    def __init__(self, rows: DataFrame, k: int, rounds: int, block: int = 4096):
        spark = ship(rows.sparkSession)
        self.kind = rows.select("signal_id").schema[0].dataType.simpleString()
        self.k = k
        facts = rows.groupBy("signal_id").agg(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"), F.max(F.size("v")).alias("bins")).collect()  # a row for each signal
        self.h = {}
        for r in facts:
            scale = np.sqrt(r.mean / k)
            self.h[r.signal_id] = started(np.arange(k) + (1 << 40), r.bins) * scale + _EPS
        scales = {r.signal_id: float(np.sqrt(r.mean / k)) for r in facts}
        blocks = rows.groupBy("signal_id", F.floor(F.col("i") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("f"))
        blocks = blocks.select("signal_id", F.transform("f", lambda f: f["i"]).alias("i"), F.flatten(F.transform("f", lambda f: f["v"])).alias("v"))
        sent = spark.sparkContext.broadcast(scales)

        def first(i, v, w, h, signal):
            return started(i, k) * sent.value[signal] + _EPS

        self.state = self._pass(blocks.withColumn("w", F.lit(None).cast("array<double>")), first)
        for _ in range(rounds):
            self._raise_h()
            before, self.state = self.state, self._pass(self.state.select("signal_id", "i", "v", "w"), _raised)
            drop(before)

    def _pass(self, blocks: DataFrame, change) -> DataFrame:
        sent = blocks.sparkSession.sparkContext.broadcast(self.h)
        k = self.k

        def run(it):
            for b in it:
                for r in range(b.num_rows):
                    signal = b.column("signal_id")[r].as_py()
                    h = sent.value[signal]
                    i = np.asarray(b.column("i")[r].values)
                    v = np.asarray(b.column("v")[r].values, float).reshape(len(i), -1)
                    w = b.column("w")[r]
                    w = change(i, v, np.asarray(w.values, float).reshape(len(i), k) if w.is_valid else None, h, signal)
                    numbers = lambda x: pa.array([np.asarray(x).ravel()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column("signal_id").slice(r, 1), pa.array([i], pa.list_(pa.int64())), numbers(v), numbers(w), numbers(w.T @ v), numbers(w.T @ w), pa.array([float(((v - w @ h) ** 2).sum())])], ["signal_id", "i", "v", "w", "top", "gram", "apart"])

        return staged(blocks.select("signal_id", "i", "v", "w").mapInArrow(run, f"signal_id {self.kind}, {_STATE}"))

    def _raise_h(self) -> None:
        """H by the blocks' sums: k x (bins + k) numbers a signal."""
        sums: dict = {}
        for name in ("top", "gram"):
            each = self.state.select("signal_id", F.posexplode(name).alias("at", "x")).groupBy("signal_id", "at").agg(F.sum("x").alias("x")).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("x"))
            for r in each.collect():
                sums.setdefault(r.signal_id, {})[name] = np.array(r.x)
        for signal, s in sums.items():
            h = self.h[signal]
            self.h[signal] = h * s["top"].reshape(h.shape) / (s["gram"].reshape(self.k, self.k) @ h + _EPS)

    def error(self) -> DataFrame:
        """signal_id, error: the norm of what is left over that of V."""
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        return self.state.groupBy("signal_id").agg((F.sqrt(F.sum("apart")) / F.greatest(F.sqrt(F.sum(square)), F.lit(_EPS))).alias("error"))

    def factors(self) -> DataFrame:
        """signal_id, i, w of every row."""
        k, n = self.k, F.size("i")
        rows = self.state.select("signal_id", F.arrays_zip("i", F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice("w", j * k + 1, k)).alias("w")).alias("r"))
        return rows.select("signal_id", F.explode("r").alias("r")).select("signal_id", "r.i", "r.w")


def _raised(i, v, w, h, signal):
    return w * (v @ h.T) / (w @ h @ h.T + _EPS)
