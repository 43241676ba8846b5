"""Block scans, halo frames, as-of joins and blocked neighbours against whole-signal kernels and plain loops."""

import random

import numpy as np
import pytest

from tidewave.functions import banks
from tidewave.operators import asof, effects, halo, neighbours, rhythm, scans, segment, sequence, spectral


def as_blocks(spark, signals, length, width=1):
    """signals: name to array of rows."""
    rows = []
    for name, x in signals.items():
        x = np.asarray(x, float).reshape(-1, width)
        rows += [(name, b, x[b * length : (b + 1) * length].ravel().tolist()) for b in range(-(-len(x) // length))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "signal_id string, block long, x array<double>")


def joined(df, column="y"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.signal_id, r.block)):
        out.setdefault(r.signal_id, []).extend(r[column])
    return {k: np.array(v) for k, v in out.items()}


SIGNALS = {n: np.random.default_rng(k).normal(size=size) for k, (n, size) in enumerate({"a": 1000, "b": 97, "c": 1, "d": 20, "e": 400}.items())}


@pytest.mark.parametrize("length, span", [(20, 3), (128, 256), (7, 2)])
def test_recurrences_over_blocks(spark, length, span):
    blocks = as_blocks(spark, SIGNALS, length)
    sections = banks.semitone_biquads(440.0, 8000.0)
    for r, kernel in ((scans.one_pole(0.97), lambda y: effects.deemphasis(y, 0.97)), (scans.biquads(sections), lambda y: effects.biquad_cascade(y, sections))):
        got = joined(scans.filtered(blocks, r, span=span))
        assert set(got) == set(SIGNALS)
        for k, y in SIGNALS.items():
            assert np.allclose(got[k], kernel(y), atol=1e-10)


def test_delay_line_over_blocks(spark):
    got = joined(scans.filtered(as_blocks(spark, SIGNALS, 24), scans.one_pole(0.9), 12, span=2))
    for k, y in SIGNALS.items():
        assert np.allclose(got[k], rhythm.comb_forward(y, 12, 0.9), atol=1e-10)


def test_recurrence_started_by_its_first_row(spark):
    x = {k: np.abs(y[: len(y) // 3 * 3]).reshape(-1, 3) for k, y in SIGNALS.items() if len(y) >= 3}
    got = joined(scans.filtered(as_blocks(spark, x, 10, 3), scans.one_pole(0.8, 0.2), 3, start=lambda row: row, span=2))
    for k, m in x.items():
        want = [m[0]]
        for row in m[1:]:
            want.append(0.8 * want[-1] + 0.2 * row)
        assert np.allclose(got[k].reshape(-1, 3), want, atol=1e-12)


def test_series_of_recurrences():
    y = np.random.default_rng(3).normal(size=(200, 2))
    one, two = scans.one_pole(0.5, 2.0), scans.biquads([(1.0, 0.5, 0.25, -0.3, 0.1)])
    by_steps, state = two.run(one.run(y, np.zeros((1, 2)))[0], np.zeros((2, 2)))
    at_once, _ = one.then(two).run(y, np.zeros((3, 2)))
    assert np.allclose(by_steps, at_once) and state.shape == (2, 2)


@pytest.mark.parametrize("states, length, span", [(2, 50, 256), (3, 13, 2), (5, 1, 3)])
def test_chains_over_blocks(spark, states, length, span):
    rng = np.random.default_rng(states)
    sizes = {"a": 300 if length > 1 else 40, "b": length, "c": 1, "d": 2 * length + 1}
    obs = {k: np.log(rng.dirichlet(np.ones(states), n)) for k, n in sizes.items()}
    init, trans = np.log(rng.dirichlet(np.ones(states))), np.log(rng.dirichlet(np.ones(states), states))
    chain, blocks = scans.Chain(init, trans), as_blocks(spark, obs, length, states)
    paths, shares = joined(chain.viterbi(blocks, span)), joined(chain.posteriors(blocks, span))
    totals = {r.signal_id: r.z for r in chain.log_partition(blocks, span).collect()}
    for k, o in obs.items():
        assert (paths[k] == sequence.viterbi_log(o, init, trans)[0]).all()
        assert np.allclose(shares[k].reshape(-1, states), sequence.posteriors(o, init, trans), atol=1e-9)
        assert np.isclose(totals[k], sequence._lse(sequence.forward(o, init, trans)[-1], 0))


def test_path_ties_and_forbidden_steps(spark):
    obs = {"a": np.zeros((30, 2)), "b": np.log(np.tile([[0.4, 0.6]], (11, 1)))}
    with np.errstate(divide="ignore"):
        trans = np.log(np.array([[0.5, 0.5], [0.0, 1.0]]))
    chain = scans.Chain(np.log([0.5, 0.5]), trans)
    got = joined(chain.viterbi(as_blocks(spark, obs, 4, 2), 2))
    for k, o in obs.items():
        assert (got[k] == sequence.viterbi_log(o, chain.init, trans)[0]).all()


@pytest.mark.parametrize("length, n_fft, hop, center", [(64, 32, 8, True), (64, 32, 8, False), (20, 64, 16, True), (48, 32, 12, False), (1000, 64, 16, True)])
def test_halo_frames(spark, length, n_fft, hop, center):
    blocks = as_blocks(spark, SIGNALS, length)
    got = {(r.signal_id, r.frame): np.array(r.re) + 1j * np.array(r.im) for r in halo.stft(blocks, length, n_fft, hop, center).collect()}
    for k, y in SIGNALS.items():
        want = spectral.stft_complex(y, n_fft, hop, None, center)
        mine = [got.pop((k, t)) for t in range(len(want))]
        assert np.allclose(mine, want, atol=1e-10) if len(want) else not mine
    assert not got


@pytest.mark.parametrize("length, n_fft, hop", [(64, 32, 8), (20, 64, 16), (1000, 64, 16)])
def test_overlap_add_across_blocks(spark, length, n_fft, hop):
    frames = halo.stft(as_blocks(spark, SIGNALS, length), length, n_fft, hop)
    lengths = spark.createDataFrame([(k, len(y)) for k, y in SIGNALS.items()], "signal_id string, n long")
    got = joined(halo.istft(frames, lengths, length, hop), "x")
    for k, y in SIGNALS.items():
        assert np.allclose(got[k], spectral.istft(spectral.stft_complex(y, n_fft, hop), hop, length=len(y)), atol=1e-10)
        assert len(y) < n_fft or np.allclose(got[k], y, atol=1e-10)


def test_samples_and_blocks(spark):
    tidy = spark.createDataFrame([(k, i, float(v)) for k, y in SIGNALS.items() for i, v in enumerate(y)], "signal_id string, idx long, y double")
    back = {(r.signal_id, r.idx): r.v for r in halo.samples_of(halo.blocks_of(tidy, 30), 30, "x").collect()}
    assert back == {(k, i): v for k, y in SIGNALS.items() for i, v in enumerate(y)}


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance, width", [(None, 7.0), (4, None), (None, 1e9)])
def test_asof(spark, direction, tolerance, width):
    r = random.Random(4)
    left = [(r.choice(["a", "b", "hot", "none"]), r.randint(-60, 60), i) for i in range(200)] + [(None, 3, 900), ("a", None, 901)]
    right = [(r.choice(["a", "b", *["hot"] * 8]), r.randint(-60, 60), i) for i in range(120)] + [(None, 3, 7), ("b", None, 8), ("a", 5, None)]
    a, b = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, hit long")
    got = {x.id: (x.t_right, x.hit_right) for x in asof.asof(a, b, ["k"], "t", direction, tolerance, width).collect()}
    assert len(got) == len(left)
    key = lambda x: (x[1] is not None, x[1] or 0)
    for k, t, i in left:
        fit = [(u, h) for c, u, h in right if c == k and None not in (k, t, u)]
        before = max(((u, h) for u, h in fit if u <= t), key=lambda x: (x[0], key(x)), default=None)
        after = max(((u, h) for u, h in fit if u >= t), key=lambda x: (-x[0], key(x)), default=None)
        if direction == "nearest":
            both = [x for x in (before, after) if x]
            want = min(both, key=lambda x: abs(x[0] - t), default=None)
        else:
            want = before if direction == "backward" else after
        if want and tolerance is not None and abs(want[0] - t) > tolerance:
            want = None
        assert got[i] == (want or (None, None))
    assert asof.asof(a, b.limit(0), ["k"], "t", direction, tolerance, width).where("t_right is null").count() == len(left)
    assert asof.asof(a.limit(0), b, ["k"], "t", direction, tolerance, width).count() == 0
    with pytest.raises(ValueError):
        asof.asof(a, b, ["k"], "t", "sideways")


def test_neighbours_by_blocks(spark):
    rng = np.random.default_rng(8)
    frames = {"a": rng.normal(size=(70, 4)), "b": np.repeat(rng.normal(size=(6, 4)), 3, axis=0), "c": rng.normal(size=(3, 4)), "d": rng.normal(size=(1, 4))}
    table = spark.createDataFrame([(k, i, v.tolist()) for k, m in frames.items() for i, v in enumerate(m)], "signal_id string, i long, v array<double>")
    for metric in ("euclidean", "cosine"):
        got = {}
        for r in neighbours.nearest(table, 5, metric, block=16).orderBy("signal_id", "i", "r").collect():
            got.setdefault((r.signal_id, r.i), []).append(r.j)
        for k, m in frames.items():
            want = segment.nearest(m, 5, metric)
            assert [got.get((k, i), []) for i in range(len(m))] == want.tolist()
    links = neighbours.nearest(table, 2, block=16)
    means = {(r.signal_id, r.i, r.k): r.v for r in neighbours.aggregated(table, links).collect()}
    for k, m in frames.items():
        if len(m) > 2:
            want = segment.nn_filter(m, 2, "euclidean")
            assert np.allclose([[means[k, i, c] for c in range(4)] for i in range(len(m))], want)
