"""Known answers and invariants of the numpy kernels."""

import numpy as np
import pytest

from tidewave.functions import banks, windows
from tidewave.operators import effects, evaluate, features, harmony, ml, pitch, rhythm, segment, sequence, spectral

SR = 22050


@pytest.fixture(scope="module")
def sine():
    return spectral.tone(440, SR)


@pytest.fixture(scope="module")
def click_train():
    y = np.zeros(4 * SR)
    for i in range(0, len(y), SR // 2):
        y[i : i + 100] = 0.9
    return y


@pytest.mark.parametrize("n_fft", [256, 512, 1024, 2048])
@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("length", [0, 1, 4096, 22050])
def test_stft_shape(n_fft, center, length):
    m = spectral.stft(np.ones(length), n_fft, n_fft // 4, None, center)
    padded = length + (n_fft if center else 0)
    assert m.shape == (0 if padded < n_fft else 1 + (padded - n_fft) // (n_fft // 4), n_fft // 2 + 1)
    assert np.isfinite(m).all()


def test_sizes_that_are_no_power_of_two_are_empty():
    assert spectral.stft(np.ones(4000), 1000).shape == (0, 501)


def test_stft_against_the_definition():
    y = np.random.default_rng(0).normal(size=64)
    m = spectral.stft_complex(y, 16, 4, None, False)
    w = windows.hann(16)
    k, i = np.arange(9)[:, None], np.arange(16)[None, :]
    want = np.array([(np.exp(-2j * np.pi * k * i / 16) * (y[t * 4 : t * 4 + 16] * w)).sum(axis=1) for t in range(13)])
    assert np.allclose(m, want)


def test_istft_inverts(sine):
    assert np.allclose(spectral.istft(spectral.stft_complex(sine), length=len(sine)), sine, atol=1e-9)


def test_descriptors_of_a_sine(sine):
    m, f = spectral.stft(sine), banks.fft_frequencies(SR, 2048)
    inner = slice(4, -4)
    assert abs(f[m[inner].mean(axis=0).argmax()] - 440) < SR / 2048
    assert np.allclose(features.centroid(m, f)[inner], 440, atol=2)
    assert np.allclose(features.rms(sine)[inner], np.sqrt(0.5), atol=1e-2)
    assert features.chroma_stft(sine, SR).mean(axis=0).argmax() == 9
    assert features.chroma_cqt(sine, SR).mean(axis=0).argmax() == 9
    assert np.allclose(features.zero_crossing_rate(sine)[inner], 2 * 440 / SR, atol=2e-3)


def test_centroid_rises_along_a_chirp():
    y = spectral.chirp(200, 4000, SR, duration=2.0)
    c = features.centroid(spectral.stft(y), banks.fft_frequencies(SR, 2048))[4:-4]
    assert (np.diff(c) > -1).all() and c[-1] > c[0] + 2000


def test_flatness_of_noise_and_sine(sine):
    noise = np.random.default_rng(1).normal(size=SR)
    assert features.flatness(spectral.stft(noise)).mean() > 0.3 > 0.05 > features.flatness(spectral.stft(sine)).mean()


def test_pitch(sine):
    assert np.allclose(pitch.yin(sine, SR)[4:-4], 440, rtol=0.01)
    f0, voiced, _ = pitch.pyin(sine[:8000], SR, fmax=1000)
    assert voiced[4:-4].all() and np.allclose(f0[4:-4], 440, rtol=0.01)
    assert abs(pitch.estimate_tuning(sine, SR)) < 0.05


def test_click_train(click_train):
    bpm, beats = rhythm.beat_track(click_train, SR)
    assert abs(bpm - 120) < 5
    assert np.allclose(np.diff(beats) * 512 / SR, 0.5, atol=0.05)
    assert len(rhythm.onset_detect(click_train, SR, wait=5)) >= 6


def tempo_by_loops(x, fps, low, high):
    """Of all lags between the ranges' ends, cut to whole frames, the one of largest weighted autocorrelation."""
    best, top = None, -np.inf
    for lag in range(max(1, int(60 * fps / high)), min(len(x) - 1, int(60 * fps / low)) + 1):
        r = sum(x[i] * x[i + lag] for i in range(len(x) - lag)) * np.exp(-0.5 * np.log2(60 * fps / lag / 120) ** 2)
        best, top = (lag, r) if r > top else (best, top)
    return 60 * fps / best


def test_tempo_against_loops():
    rng = np.random.default_rng(2)
    for x in (np.ones(100), rng.random(150), np.tile([1.0, 0, 0, 0.2, 0, 0, 0], 30)):
        assert np.isclose(rhythm.tempo(None, 22050, envelope=x), tempo_by_loops(x, 22050 / 512, 30, 300))
        assert np.isclose(rhythm.tempo_from_activations(x, 50.0), np.clip(tempo_by_loops(x, 50.0, 55, 215), 55, 215))
    assert rhythm.tempo(None, 22050, envelope=np.zeros(100)) == rhythm.tempo(None, 22050, envelope=np.ones(1)) == 120.0
    assert rhythm.tempo_from_activations(np.ones(1)) == 0 and rhythm.beat_track(None, 22050, envelope=np.ones(1))[0] == 0


def continuity_by_loops(ref, est):
    j = run = best = 0
    gaps = [b - a for a, b in zip(ref, ref[1:])]
    for i, r in enumerate(ref):
        reach = 0.175 * gaps[min(i, len(gaps) - 1)]
        while j < len(est) - 1 and est[j] < r - reach:
            j += 1
        run = run + 1 if abs(r - est[j]) <= reach else 0
        best = max(best, run)
    return best / len(ref)


def test_continuity_against_loops():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ref = np.sort(rng.random(rng.integers(2, 12)) * 5)
        est = np.sort(np.concatenate((ref[rng.random(len(ref)) < 0.8] + rng.normal(0, 0.05), rng.random(2) * 5)))
        assert np.isclose(evaluate.continuity(ref, est), continuity_by_loops(ref, est))
        half = [est[i] for i in range(0, len(est), 2)], [est[i] for i in range(1, len(est), 2)]
        more = sorted([*est, *((a + b) / 2 for a, b in zip(est, est[1:]))])
        assert np.isclose(evaluate.continuity_any(ref, est), max(continuity_by_loops(ref, e) for e in (est, more, *(half if len(est) >= 4 else ()))))
    assert evaluate.continuity(ref, ref[:1]) == 0


def test_default_clicks():
    y = spectral.clicks(sr=1000.0, length=1200, freq=100.0)
    assert np.array_equal(y, spectral.clicks([0.0, 0.5], 1000.0, 1200, 100.0)) and np.array_equal(y, spectral.clicks(None, 1000.0, 1200, 100.0, frames=[0, 500]))
    assert np.flatnonzero(np.abs(y) > 0.5).max() < 600 and len(spectral.clicks(sr=100.0)) == 460


def test_effects(sine):
    assert np.allclose(effects.deemphasis(effects.preemphasis(sine)), sine)
    assert np.array_equal(effects.pitch_shift(sine, SR, 0), sine)
    h, p = effects.hpss(sine[:8192], 512, kernel=9)
    assert (h**2).sum() > 5 * (p**2).sum()
    quiet = np.concatenate((np.zeros(SR), sine, np.zeros(SR)))
    a, b = effects.trim(quiet)
    assert abs(a - SR) <= 2048 and abs(b - 2 * SR) <= 2048
    assert len(effects.split(np.concatenate((quiet, quiet)))) == 2
    assert len(effects.time_stretch(sine, 2.0)) < 0.6 * len(sine)


def test_savgol_of_a_line():
    x = np.arange(20.0)[:, None] * 3
    assert np.allclose(features.delta(x), 3)
    assert len(features.delta(x[:5])) == 0


def test_resample_keeps_a_sine(sine):
    assert np.abs(spectral.resample(sine, SR, SR / 2)[500:-500] - spectral.tone(440, SR / 2)[500:-500]).max() < 1e-3


def test_mel_inversion(sine):
    m = spectral.melspectrogram(sine, SR, n_mels=40)
    s = spectral.mel_to_stft(m, SR)
    again = s @ banks.mel(SR, 2048, 40).T  # the regularisation shrinks it
    assert (s >= 0).all() and np.array_equal(again[4:-4].argmax(axis=1), m[4:-4].argmax(axis=1))
    assert np.corrcoef(again.ravel(), m.ravel())[0, 1] > 0.9


def brute_viterbi(prob, trans):
    import itertools

    k, best = prob.shape[1], None
    for path in itertools.product(range(k), repeat=len(prob)):
        s = np.log(1 / k) + np.log(prob[0, path[0]]) + sum(np.log(trans[a, b]) + np.log(prob[t + 1, b]) for t, (a, b) in enumerate(zip(path, path[1:])))
        if best is None or s > best[0] + 1e-12:
            best = s, path
    return best


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    prob, trans = rng.random((5, 3)) + 0.05, rng.random((3, 3)) + 0.05
    path, score = sequence.viterbi(prob, trans)
    want = brute_viterbi(prob, trans)
    assert tuple(path) == want[1] and np.isclose(score, want[0])


def test_marginals_and_partition():
    import itertools

    rng = np.random.default_rng(4)
    u, p = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    scores = {s: sum(u[t, s[t]] for t in range(4)) + sum(p[a, b] for a, b in zip(s, s[1:])) for s in itertools.product(range(3), repeat=4)}
    z = np.log(sum(np.exp(v) for v in scores.values()))
    assert np.isclose(sequence.crf_log_partition(u, p), z)
    want = np.array([[sum(np.exp(v - z) for s, v in scores.items() if s[t] == k) for k in range(3)] for t in range(4)])
    assert np.allclose(sequence.crf_marginals(u, p), want)


def test_dtw():
    c = np.random.default_rng(5).random((6, 7))
    d = sequence.dtw(c)
    path = sequence.dtw_path(d)
    assert path[0] == (0, 0) and path[-1] == (5, 6)
    assert np.isclose(sum(c[i, j] for i, j in path), d[-1, -1])
    assert np.isinf(sequence.dtw(np.ones((10, 10)), band=2)[0, 9])


def test_segments():
    x = np.concatenate((np.zeros((5, 2)), np.ones((4, 2)), np.full((3, 2), 5)))
    assert list(segment.agglomerative(x, 3)) == [0, 5, 9, 12]
    r = segment.recurrence(np.random.default_rng(6).random((20, 3)))
    assert (r.sum(axis=1) == 5).all() and np.array_equal(segment.lag_to_recurrence(segment.recurrence_to_lag(r)), r)
    v = np.random.default_rng(7).random((10, 3)) @ np.random.default_rng(8).random((3, 12))
    for loss in ("euclidean", "kl"):
        assert segment.reconstruction_error(v, *segment.nmf(v, 3, 400, loss)) < 0.05
    assert sequence.runs([1, 1, 2, 2, 2, 1]) == [(0, 2, 1), (2, 5, 2), (5, 6, 1)]


def test_evaluation():
    ref = np.array([1.0, 2, 3, 4])
    s = evaluate.beat_scores(ref, ref)
    assert s["f_measure"] == s["cemgil"] == 1 and s["p_score"] > 0.99
    assert all(v < 0.01 for v in evaluate.beat_scores(ref, ref + 100).values())
    assert all(v == 0 for v in evaluate.beat_scores(ref, np.zeros(0)).values())
    assert evaluate.onset_scores(ref, ref + 0.1, 0.07)[2] == 0 and evaluate.onset_scores(ref, ref + 0.1, 0.15)[2] == 1
    assert evaluate.tempo_scores(120, 60)[0] == 1 and evaluate.tempo_scores(120, 75)[0] == 0


def test_layers():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(7, 3))
    args = rng.normal(size=(3, 16)), rng.normal(size=(4, 16)), np.zeros(16)
    assert ml.lstm(x, *args).shape == (7, 4) and ml.bidirectional(ml.lstm, x, args, args).shape == (7, 8)
    assert np.allclose(ml.bidirectional(ml.lstm, x, args, args)[::-1, 4:], ml.lstm(x[::-1], *args))
    for merge in ("overlap", "average", "max"):
        assert np.allclose(ml.chunked(lambda z: 2 * z, x[:6], 4, 2, merge), 2 * x[:6])  # whole hops: no chunk follows one that the end cuts
    assert ml.combine([np.ones(2), np.zeros(2), np.full(2, 5.0)], "median").tolist() == [1, 1]


def test_harmony():
    a = np.zeros((10, 25))
    a[:5, 3], a[5:, 7] = 1, 1
    assert [(s, e) for s, e, _ in harmony.chord_detect(a + 0.01)] == [(0, 5), (5, 10)]
    assert harmony.relative_key(harmony.relative_key(4)) == 4
    assert harmony.note_name(60) == "C4" and harmony.key_detect(np.eye(24)[13])[1] == "C# minor"


@pytest.mark.parametrize("y", [np.zeros(4096), np.ones(4096), np.zeros(1), np.full(4096, 1e30)])
def test_edge_signals_stay_finite(y):
    assert np.isfinite(features.centroid(spectral.stft(y), banks.fft_frequencies(SR, 2048))).all()
    assert len(rhythm.beat_track(y, SR)[1]) >= 0
    assert np.isfinite(pitch.yin(y[:4096], SR)).all()


def test_tonnetz_and_banks():
    assert np.allclose(features.tonnetz(np.zeros((2, 12))), 0)
    assert np.allclose(banks.dct(8, 8) @ banks.dct(8, 8).T, np.eye(8))
    assert np.allclose(banks.mel_to_hz(banks.hz_to_mel(np.array([10.0, 999, 1000, 8000]))), [10, 999, 1000, 8000])
    v = banks.variable_q(SR, 2048)
    assert np.allclose(v.sum(axis=1), 1)


def test_tempogram_scales():
    x = np.zeros(40)
    x[20] = 3.0
    t, f = rhythm.tempogram(x, 12), rhythm.fourier_tempogram(x, 12)
    assert t.shape == (40, 12) and np.isclose(t[20, 0], 9) and np.allclose(t[:, 1:], 0)  # the pulse at the window's top, not normalised
    assert np.isclose(f[20, 0], 2 * 3 / 16) and np.allclose(f[20, 1:7], 4 * 3 / 16)


def test_harmonics_and_ratio():
    s, f = np.array([[0.0, 1, 2, 3, 4]]), np.arange(5.0)
    assert np.allclose(features.salience(s, f, (1, 2), [1, 3]), [[0, 3.5, 7, 1.5, 2]])
    assert np.allclose(features.f0_harmonics(np.repeat(s, 3, axis=0), f, [1.5, np.nan, 0], (1, 2)), [[1.5, 3], [0, 0], [0, 0]])
    bpm = np.array([np.inf, 480, 240, 160, 120])
    got = features.tempogram_ratio(np.array([[9.0, 8, 4, 2, 1]]), bpm, factors=(0.5, 1, 3, 4))
    assert np.allclose(got, [[0, 1 / 8, 6 / 8, 1]])
