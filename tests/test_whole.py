"""Queries use the whole of their signals and matrices."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewave.operators import sequence
from tidewave.plans import catalog
from tidewave.sources import signals


def test_dtw_path(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=64)], k) for k, n in ((0, 9), (1, 8), (2, 1)) for i in range(100 * k, 100 * k + n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cost = {r.signal_id: r.cost for r in catalog.QUERIES["dtw"](spark, str(tmp_path)).collect()}
    assert set(cost) == {0, 1}
    got = {}
    for r in catalog.QUERIES["dtw_path"](spark, str(tmp_path)).collect():
        got.setdefault(r.signal_id, []).append((r.i, r.j))
    assert set(got) == {0, 1}

    def cheapest(c, i, j, side=2):
        if i == j == 0:
            return c[0, 0]
        ways = [cheapest(c, i - a, j - b, side) + (1 if a and b else side) * c[i, j] for a, b in ((1, 1), (1, 0), (0, 1)) if i >= a and j >= b]
        return min(ways)

    for k, path in got.items():
        m = np.array([np.float32(v) for _, v, label in rows if label == k], float)
        c = sequence.pairwise(m[: len(m) // 2], m[len(m) // 2 :])
        i, j = c.shape[0] - 1, c.shape[1] - 1
        assert np.isclose(cost[k], cheapest(c, i, j, 1))
        want = [(i, j)]
        while i or j:  # backwards along the least cumulative cost
            i, j = min(((a, b) for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if a >= 0 and b >= 0), key=lambda s: cheapest(c, *s))
            want.append((i, j))
        assert sorted(path) == sorted(want) and (c.shape[0] - 1, c.shape[1] - 1) in path


def samples(spark):
    return {r.signal_id: np.array(r.samples) for r in signals.event_signals(spark, SF).collect()}


def test_decoders(spark):
    by = {n: {} for n in ("forward_backward", "crf_marginals")}
    for n, found in by.items():
        for r in catalog.QUERIES[n](spark, SF).collect():
            found.setdefault(r.signal_id, {})[r.idx] = r.p
    z = {r.signal_id: r.z for r in catalog.QUERIES["crf_log_partition"](spark, SF).collect()}
    t = np.array([[0.9, 0.1], [0.1, 0.9]])
    for k, y in samples(spark).items():
        p = np.clip(y / 4, 0.001, 0.999)
        o = np.stack([1 - p, p], axis=1)
        a, log = np.ones((len(o), 2)), 0.0
        for i in range(len(o)):
            a[i] = o[i] * (a[i - 1] @ t if i else 1)
            log += np.log(a[i].sum())
            a[i] /= a[i].sum()
        b = np.ones((len(o), 2))
        for i in range(len(o) - 2, -1, -1):
            b[i] = t @ (o[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        want = (a * b)[:, 1] / (a * b).sum(axis=1)
        assert np.isclose(z[k], log)
        for found in by.values():
            assert np.allclose([found[k][i] for i in range(len(y))], want, atol=1e-6) and len(found[k]) == len(y)


@pytest.mark.parametrize("name,bands", [("pitch_shift", 1), ("semitone_filterbank", 13)])
def test_effects(spark, name, bands):
    found = {r.signal_id: r.n for r in catalog.QUERIES[name](spark, SF).groupBy("signal_id").agg(F.count("*").alias("n")).collect()}
    assert found == {k: bands * len(y) for k, y in samples(spark).items()}
