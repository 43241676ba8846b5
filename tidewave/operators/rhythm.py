"""Onset, tempo and beat kernels (numpy)."""

from __future__ import annotations

import numpy as np

from . import spectral


def lagged_rise(db, lag=1):
    """Positive part of the difference to the frame `lag` before; zeros at the start."""
    out = np.zeros_like(db)
    if len(db) > lag:
        out[lag:] = np.maximum(0, db[lag:] - db[:-lag])
    return out


def onset_strength(y, sr, hop=512, n_fft=2048, n_mels=128, lag=1, aggregate=True, center=True):
    db = spectral.power_to_db(spectral.melspectrogram(y, sr, n_fft, hop, n_mels, center=center))
    d = lagged_rise(db, lag)
    if center:
        shift = n_fft // (2 * hop)
        d = np.pad(d, ((shift, 0), (0, 0)))[: len(d)]
    return d.mean(axis=1) if aggregate else d


def superflux(db, size=3, lag=1):
    half = size // 2
    p = np.pad(db, ((0, 0), (half, half)), constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(p, size, axis=1).max(axis=2)
    out = np.zeros(len(db))
    if len(db) > lag:
        out[lag:] = np.maximum(0, db[lag:] - top[:-lag]).sum(axis=1)
    return out


def complex_flux(s):
    """Distance of each frame from the one before turned on by its last phase advance."""
    m, a = np.abs(s), np.angle(s)
    out = np.zeros(len(s))
    if len(s) > 2:
        out[2:] = np.abs(s[2:] - m[1:-1] * np.exp(1j * (2 * a[1:-1] - a[:-2]))).sum(axis=1)
    return out


def high_frequency_content(m):
    return (np.arange(m.shape[1]) * m * m).sum(axis=1)


def kl_divergence(m, eps=1e-10):
    p = (m + eps) / (m + eps).sum(axis=1, keepdims=True)
    out = np.zeros(len(m))
    if len(m) > 1:
        out[1:] = np.maximum(0, (p[1:] * np.log(p[1:] / p[:-1])).sum(axis=1))
    return out


def peak_candidates(x, pre_max=3, post_max=3, pre_avg=3, post_avg=3, delta=0.07):
    """Frames that are the greatest of their window and stand delta over its mean; frames without whole windows are left out."""
    a, b = max(pre_max, pre_avg), max(post_max, post_avg)
    return [i for i in range(a, len(x) - b) if x[i] >= x[i - pre_max : i + post_max + 1].max() and x[i] >= x[i - pre_avg : i + post_avg + 1].mean() + delta]


def _spaced(candidates, wait):
    out, last = [], None
    for i in candidates:
        if last is None or i - last >= wait:
            out.append(i)
            last = i
    return out


def peak_pick(x, pre_max=3, post_max=3, pre_avg=3, post_avg=3, delta=0.07, wait=30):
    return np.array(_spaced(peak_candidates(x, pre_max, post_max, pre_avg, post_avg, delta), wait), np.int64)


def backtrack(peaks, x):
    """Each peak moved down to the least value before the curve rises again, going back; of equal ones the last."""
    out = []
    for p in peaks:
        best = at = p
        while at > 0 and x[at - 1] <= x[best]:
            at -= 1
            if x[at] < x[best]:
                best = at
        out.append(best)
    return np.array(out, np.int64)


def onset_detect(y, sr, hop=512, delta=0.07, wait=30, do_backtrack=False, envelope=None):
    x = onset_strength(y, sr, hop) if envelope is None else np.asarray(envelope, float)
    x = x / x.max() if len(x) and x.max() > 0 else x
    peaks = peak_pick(x, delta=delta, wait=wait)
    return backtrack(peaks, x) if do_backtrack else peaks


def neural_onset_detect(x, threshold=0.3, method="adaptive", pre=3, post=3, wait=3):
    """fixed: local maxima over the threshold; adaptive: over the local mean plus threshold times the maximum; combined: both."""
    out, top = [], x.max() if len(x) else 0
    for i in range(len(x)):
        w = x[max(0, i - pre) : i + post + 1]
        fixed = x[i] >= threshold
        adaptive = x[i] >= w.mean() + threshold * top
        if x[i] >= w.max() and {"fixed": fixed, "adaptive": adaptive, "combined": fixed and adaptive}[method]:
            out.append(i)
    return np.array(_spaced(out, wait), np.int64)


def smooth(x, width):
    """Centred moving average of odd width, cut at the edges."""
    half = (width | 1) // 2
    c = np.concatenate(([0], np.cumsum(x)))
    i = np.arange(len(x))
    lo, hi = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (c[hi] - c[lo]) / (hi - lo)


def _acf_tempo(x, fps, start_bpm, low=30.0, high=300.0, std=1.0):
    """The tempo whose lag has the largest autocorrelation (of x as it is, mean included), weighted by a log-normal prior; lags are cut to whole frames."""
    lags = np.arange(max(1, int(60 * fps / high)), min(len(x) - 1, int(60 * fps / low)) + 1)
    if len(lags) < 2:
        return start_bpm
    acf = spectral.autocorrelate(x)
    bpm = 60 * fps / lags
    return float(bpm[(acf[lags] * np.exp(-0.5 * (np.log2(bpm / start_bpm) / std) ** 2)).argmax()])


def tempo(y, sr, hop=512, start_bpm=120.0, envelope=None):
    """start_bpm for an envelope without a positive value."""
    x = onset_strength(y, sr, hop) if envelope is None else np.asarray(envelope, float)
    return _acf_tempo(x, sr / hop, start_bpm) if len(x) and x.max() > 0 else start_bpm


def tempo_from_activations(x, fps=100.0, low=55.0, high=215.0, start_bpm=120.0):
    """0 for fewer than two frames."""
    if len(x) < 2:
        return 0.0
    return float(np.clip(_acf_tempo(np.asarray(x, float), fps, start_bpm, low, high), low, high))


def comb_forward(x, delay, alpha=0.99):
    y = np.array(x, float)
    for i in range(delay, len(y), delay):
        n = min(delay, len(y) - i)
        y[i : i + n] += alpha * y[i - delay : i - delay + n]
    return y


def comb_backward(x, delay, alpha=1.0):
    y = np.array(x, float)
    y[delay:] += alpha * np.asarray(x, float)[: max(len(y) - delay, 0)]
    return y


def tempo_filter_bank(x, fps, low=30, high=300, alpha=0.99):
    bpm = np.arange(low, high + 1)
    return bpm, np.array([(comb_forward(x, max(1, int(60 * fps / b + 0.5)), alpha) ** 2).sum() for b in bpm])


def comb_filter_tempo(x, fps, low=30, high=300, alpha=0.99):
    bpm, e = tempo_filter_bank(x, fps, low, high, alpha)
    return float(bpm[e.argmax()])


def _centred(x, win):
    """Hann-windowed stretches around each value, zeros beyond the ends."""
    p = np.pad(np.asarray(x, float), win // 2)
    return np.lib.stride_tricks.sliding_window_view(p, win)[: len(x)] * np.hanning(win + 1)[:-1]


def tempogram(x, win=384):
    """Hann-windowed local autocorrelation, (frame, lag), as it is."""
    z = np.fft.rfft(_centred(x, win), 2 * win, axis=1)
    return np.fft.irfft(z * z.conj(), axis=1)[:, :win]


def fourier_tempogram(x, win=384):
    """Magnitudes on a grid of the next power of two, the first win/2 + 1 bins, times 4 / size; half that for the real bins at both ends."""
    size = 1 << int(np.ceil(np.log2(win)))
    m = np.abs(np.fft.rfft(_centred(x, win), size, axis=1)) * 4 / size
    m[:, [0, -1]] /= 2
    return m[:, : win // 2 + 1]


def beat_dp(x, period, trim=True, tightness=100.0):
    """Beats that maximise strength less the squared log deviation of their gaps from the period.

    A beat's predecessor lies half a period, in whole frames, around one period before it; near the
    beginning, where all of that lies before the first frame, it is the first frame. Ties go to the longer gap.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    whole = max(1, int(np.floor(period + 0.5)))
    reach = max(1, whole // 2)
    score, back = np.array(x, float), np.full(n, -1)
    for t in range(1, n):
        before = np.arange(max(0, t - whole - reach), max(0, min(t - 1, t - whole + reach)) + 1)
        v = score[before] - tightness / period**2 * (np.log(t - before) - np.log(period)) ** 2
        k = int(v.argmax())
        score[t] += v[k]
        back[t] = before[k]
    path, t = [], int(score.argmax())
    while t >= 0:
        path.append(t)
        t = back[t]
    path = path[::-1]
    if trim:
        path = path[1:] if len(path) > 1 else path
        path = path[:-1] if len(path) > 1 else path
    return np.array(path, np.int64)


def beat_track(y, sr, hop=512, start_bpm=120.0, trim=True, envelope=None):
    """(bpm, beat frames); 0 and none for fewer than two frames."""
    x = onset_strength(y, sr, hop) if envelope is None else np.asarray(envelope, float)
    if len(x) < 2:
        return 0.0, np.zeros(0, np.int64)
    x = x / x.max() if x.max() > 0 else x
    bpm = _acf_tempo(x, sr / hop, start_bpm)
    return bpm, beat_dp(x, 60 * sr / hop / bpm, trim)


def neural_beats(x, fps=100.0, low=55.0, high=215.0, threshold=0.05, trim=True):
    """(bpm, beat frames) of beat activations."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return 0.0, np.flatnonzero(x >= threshold)
    bpm = tempo_from_activations(x, fps, low, high)
    beats = beat_dp(x, 60 * fps / bpm, trim=False)
    beats = beats[x[beats] >= threshold]
    return bpm, beats[1:-1] if trim and len(beats) > 2 else beats


def downbeats(act, fps=100.0, per_bar=4):
    """(beats, whether each is a downbeat) of (frame, none / beat / downbeat) activations; bars are counted from the likeliest downbeat."""
    both = act[:, 1] + act[:, 2]
    _, beats = neural_beats(both, fps)
    if not len(beats):
        return beats, np.zeros(0, bool)
    anchor = int((act[beats, 2] / np.maximum(both[beats], 1e-10)).argmax())
    return beats, (np.arange(len(beats)) - anchor) % per_bar == 0


def plp(x, fps, win=384, low=30.0, high=300.0):
    """Predominant local pulse: each frame's dominant tempo as a windowed cosine, overlapped and added."""
    p = np.pad(np.asarray(x, float), win // 2)
    w = np.hanning(win + 1)[:-1]
    f = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(p, win)[: len(x)] * w, axis=1)
    bpm = np.arange(f.shape[1]) * fps * 60 / win
    f[:, (bpm < low) | (bpm > high)] = 0
    out = np.zeros(len(p))
    for t, row in enumerate(f):
        k = int(np.abs(row).argmax())
        out[t : t + win] += w * np.cos(2 * np.pi * k * np.arange(win) / win + np.angle(row[k])) if np.abs(row[k]) > 0 else 0
    out = np.maximum(out[win // 2 : win // 2 + len(x)], 0)
    return out / out.max() if len(out) and out.max() > 0 else out
