"""Warping over tiles and matching by components, against kernels over whole signals and plain loops."""

import random
import time

import numpy as np
import pytest

from tidewave.operators import sequence, tolerance, warp


def frames(spark, parts):
    return spark.createDataFrame([(k, i, v.tolist()) for k, m in parts.items() for i, v in enumerate(m)], "signal_id string, i long, v array<double>")


@pytest.mark.parametrize("size, band, side", [(5, None, 1.0), (4, 3, 2.0), (100, 6, 2.0)])
def test_warp(spark, size, band, side):
    rng = np.random.default_rng(size)
    a = {"x": rng.normal(size=(23, 3)), "y": rng.normal(size=(4, 3)), "z": rng.integers(0, 2, (12, 3)).astype(float), "only": rng.normal(size=(3, 3))}
    b = {"x": rng.normal(size=(17, 3)), "y": rng.normal(size=(1, 3)), "z": rng.integers(0, 2, (12, 3)).astype(float)}
    w = warp.Warp(frames(spark, a), frames(spark, b), size, band, side)
    cost = {r.signal_id: r.cost for r in w.cost().collect()}
    path = {}
    for r in w.path().collect():
        path.setdefault(r.signal_id, []).append((r.i, r.j))
    assert set(cost) == set(b)
    for k in b:
        d = sequence.dtw(sequence.pairwise(a[k], b[k]), band, side == 2.0)
        assert np.isclose(cost[k], d[-1, -1]) or np.isinf(cost[k]) and np.isinf(d[-1, -1])
        assert sorted(path.get(k, [])) == (sequence.dtw_path(d) if np.isfinite(d[-1, -1]) else [])


def test_tiles_grow_with_the_sequences(spark):
    a, b = np.random.default_rng(2).normal(size=(2, 200, 1))
    w = warp.Warp(frames(spark, {"x": a}), frames(spark, {"x": b}), 2)
    assert w.size == 13 and len(w.rounds) == 31  # not 199
    assert np.isclose(w.cost().first().cost, sequence.dtw(sequence.pairwise(a, b))[-1, -1])


def test_warp_of_nothing(spark):
    none = frames(spark, {"x": np.ones((2, 1))}).limit(0)
    assert warp.Warp(none, frames(spark, {"x": np.ones((2, 1))})).last == -1


@pytest.mark.parametrize("reach", [0.0, 0.05, 1.0, 30.0])
def test_matches_by_component(spark, reach):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", *["hot"] * 6]), round(r.uniform(-40, 40), 2), r.random() < 0.5) for _ in range(500)]
    rows += [("refs", 1.0, True), ("ests", 1.0, False), ("same", 2.0, True), ("same", 2.0, False), ("same", 2.0, True), ("a", None, True), (None, 1.0, True), ("a", float("nan"), False)]
    got = {x.signal_id: x for x in tolerance.scores(spark.createDataFrame(rows, "signal_id string, t double, ref boolean"), reach).collect()}
    for k in ("a", "b", "hot", "refs", "ests", "same"):
        side = lambda f: np.array(sorted(t for c, t, x in rows if c == k and x == f and t is not None and t == t))
        ref, est = side(True), side(False)
        hits = tolerance.greedy(ref, est, reach)
        assert (got[k].hits, got[k].n_ref, got[k].n_est) == (hits, len(ref), len(est))
        assert np.isclose(got[k].f, 2 * hits / (len(ref) + len(est)) if len(ref) * len(est) else 0)
    assert set(got) == {"a", "b", "hot", "refs", "ests", "same"}


def test_components_are_small_and_cross_buckets(spark):
    rows = [("hot", i * 0.3, i % 2 == 0) for i in range(4000)] + [("hot", 5000 + 10.0 * i, i % 2 == 0) for i in range(4000)]
    named = tolerance.with_component(spark.createDataFrame(rows, "signal_id string, t double, ref boolean"), 0.4)
    sizes = sorted(r["count"] for r in named.groupBy("component").count().collect())
    assert sizes[-1] == 4000 and sizes[:-1] == [1] * 4000  # the chain is one, over several buckets


def test_greedy_matches():
    def plain(ref, est, reach):
        free, hits = list(est), 0
        for t in ref:
            d = [abs(e - t) for e in free]
            if d and min(d) <= reach:
                del free[d.index(min(d))]
                hits += 1
        return hits

    r = np.random.default_rng(4)
    for n in range(200):
        ref, est = (np.sort(r.integers(0, 40, r.integers(0, 25)) / 4) for _ in range(2))
        for reach in (0.0, 0.25, 1.0, 3.0, np.inf):
            assert tolerance.greedy(ref, est, reach) == plain(ref, est, reach)


def test_greedy_does_not_scan_all_estimates():
    t, begun = np.sort(np.random.default_rng(1).random((2, 100_000)), axis=1), time.process_time()
    assert tolerance.greedy(*t, 1e-3) > 50_000
    assert time.process_time() - begun < 5


def test_only_blocks_near_the_band_are_joined(spark):
    a, b = np.random.default_rng(3).normal(size=(2, 60, 1))
    w = warp.Warp(frames(spark, {"x": a}), frames(spark, {"x": b}), 10, 3)
    # of the 6 blocks of each side, those of the tiles (2, 2), and their neighbours at most
    assert w._near(w.a.withColumn("q", 4 - w.a["p"]), n_q=10).count() == w._near(w.b.withColumn("p", 4 - w.b["q"]), n_p=10).count() == 1
    assert np.isclose(w.cost().first().cost, sequence.dtw(sequence.pairwise(a, b), 3)[-1, -1])
