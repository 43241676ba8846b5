"""Matching of reference and estimated times within a tolerance, without a group for each signal.

Times that can't influence each other's matches are told apart first: a cut lies between two
neighbouring times if no reference and estimate on different sides of it are within the tolerance.
What lies between two cuts is a component, matched on its own. Cuts are found within time
buckets that see a tolerance's width beyond their borders; a component's name is its first time, carried over borders by a
row for each signal and bucket. So a signal with most of the times is spread over its buckets and components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

_BUCKET = 256  # tolerances in a bucket


def with_component(times: DataFrame, tolerance: float) -> DataFrame:
    """times (signal_id, t, ref) with `component`: the place of its first time."""
    width = max(tolerance * _BUCKET, 1e-9)
    usable = times.where("signal_id is not null and t is not null and not isnan(t)")
    own = F.floor(F.col("t") / width)
    reach = tolerance * (1 + 1e-9)
    seen = usable.select("signal_id", "t", "ref", own.alias("own"), F.explode(F.sequence(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width))).alias("bucket"))
    order = Window.partitionBy("signal_id", "bucket").orderBy("t", "ref")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    of = lambda ref: F.when(F.col("ref") == ref, F.col("t"))
    sides = {f"{side}_{name}": f(of(ref), ignorenulls=True).over(w) for name, ref in (("ref", True), ("est", False)) for side, f, w in (("last", F.last, before), ("next", F.first, after))}
    near = lambda a, b: F.coalesce(F.col(b) - F.col(a) <= tolerance, F.lit(False))
    cut = ~(near("last_ref", "next_est") | near("last_est", "next_ref"))
    mine = seen.select("*", *[c.alias(k) for k, c in sides.items()]).withColumn("cut", cut).where("own = bucket").select("signal_id", "bucket", "t", "ref", "cut")
    begun = mine.withColumn("component", F.last(F.when(F.col("cut"), F.struct("t", "ref")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = mine.groupBy("signal_id", "bucket").agg(F.max(F.when(F.col("cut"), F.struct("t", "ref"))).alias("end"))
    carried = ends.select("signal_id", "bucket", F.last("end", ignorenulls=True).over(Window.partitionBy("signal_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    return begun.join(carried, ["signal_id", "bucket"]).select("signal_id", "t", "ref", F.coalesce("component", "carry").alias("component"))


def greedy(ref: np.ndarray, est: np.ndarray, tolerance: float) -> int:
    """Matches: each reference in order takes the nearest free estimate within the tolerance, the earlier of equally near ones. Both are in order of time."""
    e, hits, m = est.tolist(), 0, len(est)
    # the next free estimate to the left (plus 1, 0: none) and to the right (m: none); paths are halved when followed
    left, right = list(range(m + 1)), list(range(m + 1))

    def free(to, k):
        while to[k] != k:
            to[k] = to[to[k]]
            k = to[k]
        return k

    for t, at in zip(ref.tolist(), np.searchsorted(est, ref).tolist()):
        k, j = free(left, at) - 1, free(right, at)
        before, behind = (abs(e[k] - t) if k >= 0 else np.inf), (abs(e[j] - t) if j < m else np.inf)
        d, best = (before, k) if before <= behind else (behind, j)
        if d <= tolerance and 0 <= best < m:
            # of estimates at one time the first free one, though it makes no difference to the number
            left[best + 1], right[best] = best, best + 1
            hits += 1
    return hits


def scores(times: DataFrame, tolerance: float) -> DataFrame:
    """signal_id, hits, n_ref, n_est, precision, recall, f of times (signal_id, t, ref: whether it is a reference). Null times don't count."""
    ship(times.sparkSession)
    kind = times.select("signal_id").schema[0].dataType.simpleString()
    named = with_component(times.select("signal_id", F.col("t").cast("double").alias("t"), "ref"), tolerance)

    # a component of one side has no matches, one of a reference and an estimate has one; neither goes through Python
    of = lambda ref: F.collect_list(F.when(F.col("ref") == ref, F.col("t")))
    parts = named.groupBy("signal_id", "component").agg(of(True).alias("r"), of(False).alias("e")).select("signal_id", "r", "e", F.size("r").cast("long").alias("n_ref"), F.size("e").cast("long").alias("n_est"))
    plain = (F.col("n_ref") * F.col("n_est")) <= 1
    easy = parts.where(plain).select("signal_id", (F.col("n_ref") * F.col("n_est")).alias("hits"), "n_ref", "n_est")

    def matched(it):
        for b in it:
            hits = [greedy(np.sort(np.asarray(r.values)), np.sort(np.asarray(e.values)), tolerance) for r, e in zip(b.column("r"), b.column("e"))]
            yield pa.RecordBatch.from_arrays([b.column("signal_id"), pa.array(hits, pa.int64()), b.column("n_ref"), b.column("n_est")], ["signal_id", "hits", "n_ref", "n_est"])

    each = easy.unionByName(parts.where(~plain).mapInArrow(matched, f"signal_id {kind}, hits long, n_ref long, n_est long"))
    total = each.groupBy("signal_id").agg(*[F.sum(c).alias(c) for c in ("hits", "n_ref", "n_est")])
    share = lambda a, b: F.when(F.col("n_ref") * F.col("n_est") > 0, a / b).otherwise(0.0)
    return total.select("*", share(F.col("hits"), F.col("n_est")).alias("precision"), share(F.col("hits"), F.col("n_ref")).alias("recall"), share(2 * F.col("hits"), F.col("n_ref") + F.col("n_est")).alias("f"))
