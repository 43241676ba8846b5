"""Kernels against plain loops written from their definitions."""

import numpy as np
import pytest

from tidewave.operators import harmony, ml, pitch, rhythm, segment, sequence


def beats_by_loops(x, period, trim):
    whole = max(1, int(np.floor(period + 0.5)))
    reach = max(1, whole // 2)
    score, back = list(map(float, x)), [None] * len(x)
    for t in range(1, len(x)):
        best = None
        lo = t - whole - reach
        hi = min(t - 1, t - whole + reach)
        for k in range(max(lo, 0), max(hi, 0) + 1):
            v = score[k] - 100 / period**2 * (np.log(t - k) - np.log(period)) ** 2
            if best is None or v > best:
                best, back[t] = v, k
        score[t] += best
    at, out = int(np.argmax(score)), []
    while at is not None:
        out.append(at)
        at = back[at]
    out.reverse()
    for side in (0, -1) if trim else ():
        if len(out) > 1:
            out.pop(side)
    return out


@pytest.mark.parametrize("trim", [True, False])
def test_beats(trim):
    rng = np.random.default_rng(7)
    for k in range(40):
        x = rng.random(rng.integers(1, 120)) if k % 2 else np.tile([1.0, 0, 0, 0.3, 0, 0, 0, 0], 12)
        for period in (1.0, 5.5, 8.0, 12.7, 30.0):
            assert rhythm.beat_dp(x, period, trim).tolist() == beats_by_loops(x, period, trim)
    assert not len(rhythm.beat_dp(np.zeros(0), 4.0))
    assert rhythm.beat_dp(np.array([0, 1.0]), 1.0).tolist() == [1]  # of two beats only the first is trimmed


def test_backtrack_on_plateaus():
    assert rhythm.backtrack([6], np.array([5, 0, 0, 0, 1, 2, 9.0])).tolist() == [3]
    assert rhythm.backtrack([6], np.array([5, 1, 1, 0, 0, 2, 9.0])).tolist() == [4]
    assert rhythm.backtrack([2, 0], np.array([3, 3, 3.0])).tolist() == [2, 0]
    assert rhythm.backtrack([3], np.array([1, 2, 2, 5.0])).tolist() == [0]


def test_peaks_refined_out_of_the_range_are_left_out():
    rows = np.zeros((1, 9))
    rows[0] = [0, 0.1, 1.0, 0.9, 0.1, 0.2, 0.5, 0.45, 0.0]
    got = pitch.piptrack(rows, 16.0, 16, 2.3, 6.2)
    assert [g[0] for g in got] == [0] and np.isclose(got[0][1], 2 + 0.5 * (0.1 - 0.9) / (0.1 - 2.0 + 0.9))
    assert len(pitch.piptrack(rows, 16.0, 16, 2.3, 7.0)) == 2
    assert pitch.piptrack(rows, 16.0, 16, 2.45, 6.2) == []


def test_local_transitions():
    assert np.allclose(sequence.transition_local(5, 5)[2], np.bartlett(5) / np.bartlett(5).sum())
    assert np.allclose(sequence.transition_local(4, 3, "even")[0], [0.5, 0.5, 0, 0])
    assert np.allclose(sequence.transition_local(4, 3, "even", wrap=True)[0], [1 / 3, 1 / 3, 0, 1 / 3])
    assert np.allclose(sequence.transition_local(3, [1, 3, 3], "hann").sum(axis=1), 1)


def test_band_of_unequal_sides():
    d = sequence.dtw(np.ones((20, 30)), 3)
    for i in range(20):
        for j in range(30):
            if abs(i / 20 - j / 30) > 3 / 30:
                assert np.isinf(d[i, j])
    assert np.isinf(d[19, 19]) and np.isfinite(d[10, 15])


def test_rectangle_medians():
    rng = np.random.default_rng(2)
    r = rng.random((7, 7))
    for rows, columns in segment.path_sizes(5):
        got = segment.rectangle_median(r, rows, columns)
        for i in range(7):
            for j in range(7):
                fold = lambda k: -1 - k if k < 0 else 13 - k if k > 6 else k
                cells = sorted(r[fold(i + a), fold(j + b)] for a in range(-(rows // 2), rows - rows // 2) for b in range(-(columns // 2), columns - columns // 2))
                assert got[i, j] == cells[len(cells) // 2]
    assert segment.path_sizes(5)[0] == (1, 5) and (segment.path_enhance(r, zero_mean=True) >= 0).all()
    assert np.isclose(segment.path_enhance(r, zero_mean=True, clip=False).mean(), 0)


def chunks_by_loops(f, x, size, hop, merge):
    if len(x) <= size:
        return f(x)
    out = None
    for s in range(0, len(x), hop):
        y = list(f(x[s : s + size]))
        if out is None:
            out = y
            end = len(y)
            continue
        at, overlap = end - (size - hop), min(size - hop, len(y))
        for k, v in enumerate(y):
            if at + k < len(out) and k < overlap:
                old = out[at + k]
                out[at + k] = max(old, v) if merge == "max" else (old + v) / 2 if merge == "average" else (1 - k / overlap) * old + k / overlap * v
            elif k >= overlap:
                out[at + k : at + k + 1] = [v]
        end = at + len(y)
    return np.array(out[: len(x)])


@pytest.mark.parametrize("merge", ["average", "max", "overlap"])
def test_chunks(merge):
    rng = np.random.default_rng(1)
    for n in (1, 8, 9, 20, 22, 23, 40):
        for size, hop in ((8, 4), (8, 3), (8, 8), (6, 2)):
            x = rng.random(n)
            f = lambda v: v - v.mean()
            assert np.allclose(ml.chunked(f, x, size, hop, merge), chunks_by_loops(f, x, size, hop, merge))


def test_recurrence_measures():
    r = np.zeros((6, 6))
    for i, j in ((0, 1), (1, 2), (2, 3), (3, 0), (4, 0), (5, 0), (4, 4), (5, 2)):
        r[i, j] = 1
    got = segment.rqa(r)
    assert np.isclose(got["rate"], 7 / 30) and np.isclose(got["determinism"], 3 / 7) and np.isclose(got["laminarity"], 3 / 7)
    assert got["mean_diagonal"] == got["mean_vertical"] == got["longest"] == 3 and got["entropy"] == 0


def test_lags():
    r = np.arange(16.0).reshape(4, 4)
    lag = segment.recurrence_to_lag(r)
    assert all(lag[k, i] == r[(i + k) % 4, i] for k in range(4) for i in range(4))
    assert all(segment.recurrence_to_lag(r, axis=0)[k, i] == r[i, (i + k) % 4] for k in range(4) for i in range(4))
    assert segment.recurrence_to_lag(r, pad=False)[3].tolist() == [r[3, 0], 0, 0, 0]
    assert (segment.lag_to_recurrence(lag) == r).all()


def test_notes_begin_off():
    act = np.array([[0.9], [0.9], [0.05], [0.05], [0.05], [0.05], [0.99], [0.99], [0.99], [0.99]])
    trans, best = np.array([[0.99, 0.01], [0.05, 0.95]]), None
    for code in range(1 << 10):
        path = [code >> k & 1 for k in range(10)]
        p = np.log([0.99, 0.01][path[0]]) + sum(np.log(trans[a, b]) for a, b in zip(path, path[1:])) + sum(np.log(a if s else 1 - a) for s, a in zip(path, act[:, 0]))
        best = max(best or (-np.inf, None), (p, path))
    assert [n[:2] for n in harmony.piano_hmm(act, shortest=1)] == [(a, b) for a, b, k in sequence.runs(best[1]) if k]


def pyin_by_loops(y, sr, fmin, fmax, size, hop, n_thresholds, resolution):
    """Observation shares and voiced probabilities, threshold by threshold."""
    low, high = max(1, int(sr / fmax)), min(int(sr / fmin), size // 2)
    n_bins = int(np.ceil(12 * np.log2(fmax / fmin) / resolution))
    y = np.concatenate((np.zeros(size // 2), y, np.zeros(size // 2)))
    rows, heard = [], []
    for start in range(0, len(y) - size + 1, hop):
        d = pitch.cmndf(pitch.difference(y[start : start + size], high))
        row, voiced = [0.0] * (n_bins + 1), 0.0
        for t in range(1, n_thresholds + 1):
            lag = next((k for k in range(low, high + 1) if d[k] < t / n_thresholds), None)
            if lag is None:
                lag = min(range(low, high + 1), key=lambda k: (d[k], k))
            else:
                while lag < high and d[lag + 1] < d[lag]:
                    lag += 1
            hz = sr / pitch.parabola(d, lag)
            if fmin <= hz <= fmax:
                share = 1 - float(pitch.beta_cdf(min(max(d[lag], 0), 1)))
                voiced += share
                k = int(np.floor(12 * np.log2(hz / fmin) / resolution + 0.5))
                if k < n_bins:
                    row[k] += share
                    row[-1] += 1 - share
                    continue
            row[-1] += 1
        rows.append([v / sum(row) for v in row])
        heard.append(voiced / n_thresholds)
    return np.array(rows), np.array(heard)


def test_probabilistic_yin():
    rng = np.random.default_rng(6)
    t = np.arange(400)
    y = np.where(t < 250, np.sin(2 * np.pi * t / 8), 0) + 0.01 * rng.normal(size=400)
    args = (32.0, 2.0, 14.0, 32, 8, 20, 0.5)
    rows, heard = pyin_by_loops(y, *args)
    hz, on, share = pitch.pyin(y, *args)
    assert np.allclose(share, heard)
    n = rows.shape[1] - 1
    trans = np.zeros((n + 1, n + 1))
    for i in range(n):
        w = [np.exp(-0.5 * ((i - j) * 0.5 / max(35.92 * 8 / 32, 0.5)) ** 2) for j in range(n)]
        trans[i, :n] = [0.99 * v / sum(w) for v in w]
        trans[i, n] = 0.01
    trans[n, :n], trans[n, n] = 0.01 / n, 0.99
    with np.errstate(divide="ignore"):
        path, _ = sequence.viterbi_log(np.log(rows), np.full(n + 1, -np.log(n + 1)), np.log(trans))
    assert (on == (path < n)).all() and np.allclose(hz[on], 2.0 * 2 ** (path[on] * 0.5 / 12)) and np.isnan(hz[~on]).all()
    assert on[2:25].all() and abs(np.median(hz[2:25]) - 32 / 8) < 0.15
