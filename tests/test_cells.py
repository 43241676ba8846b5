"""Pairs of frames by cells against whole matrices."""

import numpy as np
import pytest

from tidewave.operators import cells, segment, sequence


def table(spark, signals):
    return spark.createDataFrame([(name, i, x.tolist()) for name, m in signals.items() for i, x in enumerate(m)], "signal_id string, i long, v array<double>").repartition(5)


def signals(seed=3):
    rng = np.random.default_rng(seed)
    m = {"a": rng.normal(size=(70, 4)), "b": rng.normal(size=(9, 4)), "one": rng.normal(size=(1, 4))}
    m["a"][50:60] = m["a"][3]  # copies
    m["a"][61] = m["a"][4] + 1e-7
    return m


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_all_pairs_by_cells(spark, metric, monkeypatch):
    monkeypatch.setattr(cells, "_SLICE", 8)
    m = signals()
    got = {name: np.full((len(x), len(x)), np.nan) for name, x in m.items()}
    rows = cells.pairs(table(spark, m), metric, block=2).collect()
    for r in rows:
        got[r.signal_id][r.i, r.j] = r.d
    assert len(rows) == sum(len(x) ** 2 for x in m.values())
    for name, x in m.items():
        assert np.allclose(got[name], sequence.pairwise(x, x, metric), atol=1e-12)
    if metric == "euclidean":
        assert (got["a"][50:60, 50:60] == 0).all() and np.isclose(got["a"][4, 61], 2e-7, rtol=1e-6)


def test_blocks_grow_with_their_signal(spark):
    """A frame goes to 2 * 16 cells at most, and a block has no more than 8,192 frames."""
    n = spark.createDataFrame([(k,) for k in (1, 100, 5000, 100_000, 10_000_000)], "n long")
    assert [r[0] for r in n.select(cells.block_size(n.n, 256)).collect()] == [256, 256, 313, 6250, 8192]


def test_pair_queries_see_no_whole_signal(spark):
    from conftest import SF

    from tidewave.plans import catalog

    for name in ("cross_similarity", "cross_similarity_cosine", "recurrence_soft", "recurrence_threshold", "rqa", "path_enhance", "lag_to_recurrence", "timelag_filter"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "collect_list(struct(frame" not in plan and "FlatMapGroupsInArrow" in plan, name


@pytest.mark.parametrize("block", [2, 7, 256])
def test_points_below_a_threshold_and_their_runs_by_cells(spark, block):
    rng = np.random.default_rng(block)
    m = {"a": rng.random((75, 1)), "b": np.repeat(rng.random((8, 1)), 4, axis=0), "far": np.arange(5.0)[:, None] * 9, "one": np.zeros((1, 1)), "same": np.ones((40, 1))}
    f = table(spark, m)
    got = {r.signal_id: r for r in cells.quantified(f, 0.3, block=block).collect()}
    points = [(r.signal_id, r.i, r.j) for r in cells.below(f, 0.3, block).collect()]
    assert set(got) == set(m) and len(points) == len(set(points))
    for name, x in m.items():
        r = segment.recurrence(x, "threshold", threshold=0.3)
        assert {(i, j) for k, i, j in points if k == name} == set(zip(*np.nonzero(r)))
        for k, v in segment.rqa(r).items():
            assert np.isclose(got[name][k], v), (name, k)


@pytest.mark.parametrize("block", [1, 4, 9, 512])
def test_path_enhancement_by_cells(spark, block):
    rng = np.random.default_rng(1)
    m = {str(n): (rng.random((n, n)) < 0.4).astype(float) for n in (1, 2, 3, 5, 9, 13)}
    m["none"] = np.zeros((6, 6))
    links = spark.createDataFrame([(k, int(i), int(j)) for k, r in m.items() for i, j in zip(*np.nonzero(r))], "signal_id string, i long, j long")
    rows = cells.enhanced(links, spark.createDataFrame([(k, len(r)) for k, r in m.items()], "signal_id string, n long"), block=block).collect()
    assert len(rows) == sum(r.size for r in m.values())
    got = {k: np.full(r.shape, np.nan) for k, r in m.items()}
    for r in rows:
        got[r.signal_id][r.i, r.j] = r.v
    for k, r in m.items():
        assert np.allclose(got[k], segment.path_enhance(r)), k


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pairs_are_dealt_once_and_made_by_spark(spark, metric, monkeypatch):
    """A frame goes to 9 cells at most; a cell gives rows of distances, from which Spark makes the pairs, both ways alike."""
    sent, spread = [], cells._spread
    monkeypatch.setattr(cells, "_spread", lambda placed: sent.append(placed) or spread(placed))
    m = {"a": np.random.default_rng(5).normal(size=(64, 3))}
    df = cells.pairs(table(spark, m), metric, block=2)
    assert sent[0].count() == 9 * 64
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("FlatMapGroupsInArrow")
    got = {(r.i, r.j): r.d for r in df.collect()}
    assert len(got) == 64 * 64 and all(got[j, i] == d for (i, j), d in got.items() if i // 8 != j // 8)


def test_rounding_by_scale_is_that_of_sql(spark):
    import duckdb

    from tidewave.plans import spectra

    x = [0.0, -0.0, 1.2345675, 0.0078125, -0.0078125, 2.5e-7, -2.5e-7, 5e-7, -1e-17, 1e9 + 0.1234565, -3e9 - 1 / 3, 1e300, float("inf"), float("-inf"), float("nan"), None]
    x += (np.random.default_rng(6).integers(-4000, 4000, 2000) / 128 / np.array([1, 10, 1000, 1e6])[np.arange(2000) % 4]).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, v double")
    got = df.select("k", (spectra.scaled("v") + 0.0).alias("v")).orderBy("k").toPandas().v
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(x)))
    want = con.execute("SELECT round(v, 6) + 0.0 AS v FROM t ORDER BY k").df().v
    assert [repr(a) for a in got] == [repr(a) for a in want]


@pytest.mark.parametrize("name", ["cross_similarity", "cross_similarity_cosine", "recurrence_soft", "path_enhance"])
def test_pair_queries_do_not_round_through_decimals(spark, name):
    """F.round of a double is a BigDecimal; it is left for numbers that can't be scaled."""
    from conftest import SF

    from tidewave.plans import catalog

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "floor" in plan.lower() and "CASE WHEN" in plan


def strokes(n=150):
    """Lines and bars, some at edges and over the borders of blocks, and little else."""
    r = np.zeros((n, n))
    r[0, 3:9] = r[40:52, 60] = r[n - 1, n - 4 :] = r[70:73, 70:76] = r[100:110, n - 1] = r[:4, :3] = 1
    for k in range(20):
        r[30 + k, 80 + k] = r[20 + k, 21 + k] = r[120 - k, 10 + k] = 1
    return r


@pytest.mark.parametrize("block", [4, 30, 512])
def test_path_enhancement_of_few_links(spark, block):
    """A cell gives runs of equal values; Spark makes the rows from these."""
    m = {"strokes": strokes(), "dense": (np.random.default_rng(7).random((90, 90)) < 0.5).astype(float), "empty": np.zeros((40, 40))}
    links = [(k, int(i), int(j)) for k, r in m.items() for i, j in zip(*np.nonzero(r))]
    df = cells.enhanced(spark.createDataFrame(links + links[:5], "signal_id string, i long, j long"), spark.createDataFrame([(k, len(r)) for k, r in m.items()], "signal_id string, n long"), block=block)
    rows = df.collect()
    assert len(rows) == sum(r.size for r in m.values())
    got = {k: np.full(r.shape, np.nan) for k, r in m.items()}
    for r in rows:
        got[r.signal_id][r.i, r.j] = r.v
    for k, r in m.items():
        assert np.allclose(got[k], segment.path_enhance(r)), k
    assert np.count_nonzero(got["strokes"]) > 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(first") < plan.index("FlatMapGroupsInArrow")


def test_medians_of_few_and_of_many_points_agree():
    boxes = segment.path_sizes(5)
    r = strokes(300)
    i, j = np.nonzero(r)
    few = cells._medians(i, j, boxes, (0, 300), (0, 300))
    many = cells._medians(np.repeat(i, 100), np.repeat(j, 100), boxes, (0, 300), (0, 300))
    assert len(few[0]) > 50 and len(i) * 80 < r.size and all((a == b).all() for a, b in zip(few, many))


def test_frames_of_neighbours_are_sent_to_sixteen_cells(spark, monkeypatch):
    from tidewave.operators import neighbours

    sent, spread = [], cells._spread
    monkeypatch.setattr(cells, "_spread", lambda placed: sent.append(placed) or spread(placed))
    assert neighbours.nearest(table(spark, {"a": np.random.default_rng(8).normal(size=(64, 3))}), 5, block=2).count() == 5 * 64
    assert sent[0].count() == 16 * 64


def test_pairs_and_values_come_in_narrow_tiles(spark, monkeypatch):
    """Columns then repeat soon, which Parquet's compression finds."""
    monkeypatch.setattr(cells, "_TILE", 16)
    monkeypatch.setattr(cells, "_SLICE", 256)
    m = {"a": np.random.default_rng(9).normal(size=(100, 3))}
    f = table(spark, m)
    links = spark.createDataFrame([("a", 3, 4)], "signal_id string, i long, j long")
    for df in (cells.pairs(f, block=100), cells.enhanced(links, spark.createDataFrame([("a", 100)], "signal_id string, n long"), block=16)):
        rows = df.coalesce(1).collect()
        assert len(rows) == 100 * 100 == len({(r.i, r.j) for r in rows})
        changes = [k for k in range(1, len(rows)) if rows[k].i != rows[k - 1].i]
        assert max(np.diff([0, *changes, len(rows)])) <= 16
