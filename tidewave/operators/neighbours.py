"""Nearest neighbours of all frames of a signal among themselves, by blocks.

Frames are dealt to cells of a square: a query block and a candidate block. A cell computes
its distances and keeps the k nearest of each query; these lists are merged by query. A frame is sent to
twice as many cells as a signal has blocks (`cells._WIDE` of them, until a block is full); a cell has two blocks, and no matrix of all pairs exists.
In a cell, the columns are dealt to groups: the k-th least of a row's group minima is a bound that at least k frames keep, and only groups
whose minimum keeps it are looked into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import cells
from .sequence import pairwise

_DIGITS = 8  # distances that agree in these are tied; the lower frame comes first
_GROUP = 16  # columns
_SLICE = 1 << 18  # pairs at a time


def nearest(frames: DataFrame, k: int = 5, metric: str = "euclidean", block: int = 2048) -> DataFrame:
    """signal_id, i, r (rank from 0), j, d: the k nearest other frames of each. frames: signal_id, i (from 0 without gaps), v; block: the least frames of a block."""
    ship(frames.sparkSession)
    kind = frames.select("signal_id").schema[0].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        own, x, other, y = cells.sides(t)
        found: list[list] = [[], [], [], []]
        candidates = _searcher(y, other, k, metric)
        step = max(1, _SLICE // max(len(y), 1))
        for at in range(0, len(x), step):
            rows = slice(at, at + step)
            q, near = candidates(x[rows], own[rows])
            d = np.round(cells.exact(x[rows], y, q, near, metric), _DIGITS)
            order = np.lexsort((near, d, q))
            q, near, d = q[order], near[order], d[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            n = np.bincount(q[best], minlength=len(x[rows]))
            for to, part in zip(found, (own[rows], n, other[near[best]], d[best])):
                to.append(part)
        own, n, j, d = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.table({"signal_id": pa.repeat(t.column("signal_id")[0], len(own)), "i": pa.array(own, pa.int64()), "j": pa.ListArray.from_arrays(at, pa.array(j, pa.int64())), "d": pa.ListArray.from_arrays(at, pa.array(d, pa.float64()))})

    lists = cells.dealt(frames, block, cells._WIDE).applyInArrow(local, f"signal_id {kind}, i long, j array<long>, d array<double>")
    pairs = lists.select("signal_id", "i", F.arrays_zip("d", "j").alias("p"))
    merged = pairs.groupBy("signal_id", "i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
    return merged.select("signal_id", "i", F.posexplode("p").alias("r", "x")).select("signal_id", "i", F.col("r").cast("bigint").alias("r"), "x.j", "x.d")


def _searcher(y: np.ndarray, other: np.ndarray, k: int, metric: str):
    """A function of rows x and their numbers: pairs (row of x, row of y) that may be among the k nearest of the former, by a matrix product whose rounding is allowed for.

    other: the numbers of y, in order; a row is no neighbour of its own. Distances without a number come last.
    """
    m = len(y)
    groups = -(-m // _GROUP)
    finite = bool(np.isfinite(y).all())
    wide = np.zeros((groups * _GROUP, y.shape[1] if m else 0))
    wide[:m] = y
    squares = np.full(len(wide), np.inf)
    squares[:m] = (y * y).sum(axis=1)
    high = squares[:m].max(initial=0)
    turned = np.ascontiguousarray(-2 * wide.T)

    def run(x, own):
        at = np.minimum(np.searchsorted(other, own), max(m - 1, 0))
        me = np.flatnonzero(other[at] == own) if m else at[:0]
        if not (finite and np.isfinite(x).all()):
            same = np.zeros((len(x), m), bool)
            same[me, at[me]] = True
            near = np.lexsort((np.round(pairwise(x, y, metric), _DIGITS), same), axis=1)[:, :k]
            kept = ~np.take_along_axis(same, near, axis=1)
            return np.nonzero(kept)[0], near[kept]
        if metric == "cosine":
            d = np.full((len(x), len(wide)), np.inf)
            d[:, :m] = pairwise(x, y, metric)
            slack = 1e-7
        else:
            # squares of distances but for those of x; what 1e-6 (1 + the greatest norm) makes of them
            d = x @ turned
            d += squares
            most = np.sqrt(max((x * x).sum(axis=1).max(initial=0), high))
            slack = 1e-6 * (1 + most)
            slack = 4 * most * slack + slack * slack
        d[me, at[me]] = np.inf
        if k >= groups:
            far = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < m else np.inf
            return np.nonzero((d <= far + slack) & (d < np.inf))
        least = d.reshape(len(x), _GROUP, groups).min(axis=1)
        far = np.partition(least, k - 1, axis=1)[:, k - 1] + slack
        row, group = np.nonzero(least <= far[:, None])
        column = group[:, None] + groups * np.arange(_GROUP)
        inside = d[row[:, None], column]
        some, place = np.nonzero((inside <= far[row][:, None]) & (inside < np.inf))
        return row[some], column[some, place]

    return run


def aggregated(frames: DataFrame, links: DataFrame, how: str = "mean") -> DataFrame:
    """signal_id, i, k, v: for each frame and component the mean or median over the frames j that links (signal_id, i, j) name."""
    other = frames.select("signal_id", F.col("i").alias("j"), "v")
    met = links.select("signal_id", "i", "j").join(other, ["signal_id", "j"]).groupBy("signal_id", "i").agg(F.collect_list("v").alias("v"))
    known = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("v", F.size)) - 1), lambda k: F.filter(F.transform("v", lambda v: F.get(v, k)), lambda x: x.isNotNull()))
    each = met.where(F.exists("v", lambda v: F.size(v) > 0)).select("signal_id", "i", F.posexplode(known).alias("k", "x"))
    middle = lambda x, k: F.get(F.array_sort(x), F.floor(k).cast("int"))
    n = F.size("x")
    value = F.aggregate("x", F.lit(0.0), lambda a, x: a + x) / n if how == "mean" else (middle(F.col("x"), (n - 1) / 2) + middle(F.col("x"), n / 2)) / 2
    return each.select("signal_id", "i", F.col("k").cast("bigint").alias("k"), F.when(n > 0, value).alias("v"))
