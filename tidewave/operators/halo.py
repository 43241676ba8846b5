"""Blocks of samples with a halo: transforms of signals of any length, block by block.

Blocks have `length` samples from 0 on (the last is shorter). A frame belongs to the block
in which it begins, or, centred, in which its middle lies; samples that it needs of
neighbouring blocks come as a halo. Only halos are copied; nothing holds a whole signal.
The inverse transform adds frames up within their block and sends what falls into
neighbouring blocks to these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import hann
from ..session import ship


def blocks_of(samples: DataFrame, length: int) -> DataFrame:
    """signal_id, block, x from (signal_id, idx, y); idx from 0 without gaps."""
    each = samples.select("signal_id", F.floor(F.col("idx") / length).alias("block"), F.struct("idx", "y").alias("s"))
    return each.groupBy("signal_id", "block").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["y"]).alias("x"))


def samples_of(blocks: DataFrame, length: int, column: str = "y", name: str = "v") -> DataFrame:
    """signal_id, idx and a value for each number of blocks that have one a sample."""
    return blocks.select("signal_id", "block", F.posexplode(column).alias("i", name)).select("signal_id", (F.col("block") * length + F.col("i")).alias("idx"), name)


def with_halo(blocks: DataFrame, length: int, behind: int, ahead: int) -> DataFrame:
    """signal_id, block, first (index of x's first sample), x with `behind` samples before the block and `ahead` after it, where there are any; n (length of the signal)."""
    near = F.sequence(F.col("block") - (-(-ahead // length)), F.col("block") + (-(-behind // length)))
    sent = blocks.select("signal_id", F.col("block").alias("own"), "x", F.explode(near).alias("block"))
    # of x, the samples from lo to hi lie within the target's reach
    at = F.col("own") * length
    lo = F.greatest(F.col("block") * length - behind - at, F.lit(0))
    hi = F.least((F.col("block") + 1) * length + ahead - at, F.size("x"))
    cut = sent.select("signal_id", "block", F.col("own"), (at + lo).alias("first"), F.when(hi > lo, F.slice("x", (lo + 1).cast("int"), (hi - lo).cast("int"))).alias("x"))
    whole = cut.where("x is not null").groupBy("signal_id", "block").agg(F.array_sort(F.collect_list(F.struct("first", "x", "own"))).alias("p"))
    joined = whole.where(F.exists("p", lambda p: p["own"] == F.col("block"))).select("signal_id", "block", F.get("p", F.lit(0))["first"].alias("first"), F.flatten(F.transform("p", lambda p: p["x"])).alias("x"))
    # a row for each signal
    ends = blocks.groupBy("signal_id").agg(F.max(F.col("block") * length + F.size("x")).alias("n"))
    return joined.join(ends, "signal_id")


def stft(blocks: DataFrame, length: int, n_fft: int = 2048, hop: int | None = None, center: bool = True) -> DataFrame:
    """signal_id, frame, re, im of blocks (signal_id, block, x). Centred frames see zeros before and behind the signal."""
    hop = hop or n_fft // 4
    half = n_fft // 2 if center else 0
    ship(blocks.sparkSession)
    kind = blocks.select("signal_id").schema[0].dataType.simpleString()
    window = hann(n_fft)

    def run(it):
        for b in it:
            for i, (signal, block, first, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("signal_id", "block", "first", "n")))):
                x = np.asarray(b.column("x")[i].values, float)
                # middles (or beginnings) from the block's first sample on; the last block also has the one at the signal's end
                last = n if center and (block + 1) * length >= n else (block + 1) * length - 1
                if not center:
                    last = min(last, n - n_fft)
                frames = np.arange(-(-block * length // hop), last // hop + 1)
                if not len(frames):
                    continue
                # x as if it began at the first frame and were as long as all need
                begin, end = int(frames[0]) * hop - half, int(frames[-1]) * hop - half + n_fft
                y = np.zeros(end - begin)
                lo, hi = max(begin, first), min(end, first + len(x))
                y[lo - begin : hi - begin] = x[lo - first : hi - first]
                view = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
                for k in range(0, len(view), 1024):
                    s = np.fft.rfft(view[k : k + 1024] * window, axis=1)
                    width = s.shape[1]
                    at = pa.array(np.arange(len(s) + 1, dtype=np.int32) * width)
                    lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(v).ravel())) for v in (s.real, s.imag)]
                    yield pa.RecordBatch.from_arrays([pa.array([signal] * len(s), b.column("signal_id").type), pa.array(frames[k : k + len(s)]), *lists], ["signal_id", "frame", "re", "im"])

    reached = with_halo(blocks, length, half, n_fft - half)
    return reached.mapInArrow(run, f"signal_id {kind}, frame long, re array<double>, im array<double>")


def istft(frames: DataFrame, lengths: DataFrame, length: int, hop: int, center: bool = True) -> DataFrame:
    """signal_id, block, x of frames (signal_id, frame, re, im); lengths: signal_id, n. Frames are grouped by the block of their middle; each block's sums reach into its neighbours only."""
    ship(frames.sparkSession)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()

    def added(t: pa.Table) -> pa.Table:
        """Sums of the frames of a block, cut by the blocks that they fall into."""
        order = np.argsort(np.asarray(t.column("frame")))
        number = np.asarray(t.column("frame"))[order]
        re, im = (np.stack([np.asarray(v.values, float) for v in t.column(c)])[order] for c in ("re", "im"))
        n_fft = 2 * (re.shape[1] - 1)
        w = hann(n_fft)
        half = n_fft // 2 if center else 0
        begin = int(number[0]) * hop - half
        y = np.zeros((int(number[-1]) - int(number[0])) * hop + n_fft)
        total = np.zeros(len(y))
        for f, part in zip(number, np.fft.irfft(re + 1j * im, n_fft, axis=1) * w):
            a = (int(f) - int(number[0])) * hop
            y[a : a + n_fft] += part
            total[a : a + n_fft] += w * w
        out: list[list] = [[], [], [], []]
        for block in range(max(begin, 0) // length, (begin + len(y) - 1) // length + 1):
            lo, hi = max(block * length, begin, 0), min((block + 1) * length, begin + len(y))
            for column, value in zip(out, (block, lo - block * length, y[lo - begin : hi - begin], total[lo - begin : hi - begin])):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        columns = {c: pa.array(v, k) for c, v, k in zip(("block", "at", "y", "w"), out, kinds)}
        return pa.table({"signal_id": pa.array([t.column("signal_id")[0].as_py()] * len(out[0]), t.schema.field("signal_id").type), **columns})

    def summed(t: pa.Table) -> pa.Table:
        n, block = t.column("n")[0].as_py(), t.column("block")[0].as_py()
        size = max(min(length, n - block * length), 0)
        y, total = np.zeros(length), np.zeros(length)
        for at, a, b in zip(t.column("at").to_pylist(), t.column("y"), t.column("w")):
            part = np.asarray(a.values, float)
            y[at : at + len(part)] += part
            total[at : at + len(part)] += np.asarray(b.values, float)
        y = np.where(total > 1e-10, y / np.maximum(total, 1e-300), y)[:size]
        return pa.table({"signal_id": t.column("signal_id")[:1], "block": t.column("block")[:1], "x": pa.array([y], pa.list_(pa.float64()))})

    dealt = frames.withColumn("owner", F.floor(F.col("frame") * hop / length))
    pieces = dealt.groupBy("signal_id", "owner").applyInArrow(added, f"signal_id {kind}, block long, at long, y array<double>, w array<double>")
    return pieces.join(lengths.select("signal_id", "n"), "signal_id").groupBy("signal_id", "block").applyInArrow(summed, f"signal_id {kind}, block long, x array<double>").where(F.size("x") > 0)
