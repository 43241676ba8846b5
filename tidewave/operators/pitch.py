"""Pitch kernels (numpy)."""

from __future__ import annotations

import math

import numpy as np

from . import sequence, spectral


def difference(frame, max_lag):
    """Squared difference to the frame moved by each lag, over the part they share."""
    return np.array([((frame[: len(frame) - k] - frame[k:]) ** 2).sum() for k in range(max_lag + 1)])


def cmndf(d):
    """Difference over its running mean; 1 at lag 0."""
    lag = np.arange(len(d))
    run = np.cumsum(d)
    out = np.ones(len(d))
    ok = run[1:] > 0
    out[1:][ok] = d[1:][ok] * lag[1:][ok] / run[1:][ok]
    return out


def parabola(x, i):
    if 0 < i < len(x) - 1:
        a, b, c = x[i - 1 : i + 2]
        den = a - 2 * b + c
        if abs(den) > 1e-12:
            return i + 0.5 * (a - c) / den
    return float(i)


def yin(y, sr, fmin=65.0, fmax=2093.0, size=2048, hop=None, threshold=0.1, center=True):
    """Hz of each frame, 0 where none."""
    low, high = max(1, int(sr / fmax)), min(int(sr / fmin), size // 2)
    framed, out = spectral.frames(np.asarray(y, float), size, hop or size // 4, center), []
    if high <= low:
        return np.zeros(len(framed))
    for f in framed:
        d = cmndf(difference(f, high))
        part = d[low : high + 1]
        below = np.flatnonzero(part < threshold)
        i = int(below[0]) if len(below) else int(part.argmin())
        while len(below) and i + 1 < len(part) and part[i + 1] < part[i]:
            i += 1
        hz = sr / parabola(d, low + i)
        out.append(hz if fmin <= hz <= fmax else 0.0)
    return np.array(out)


def beta_cdf(x, a=2, b=18):
    """Of integer parameters, as a binomial tail."""
    n = a + b - 1
    x = np.asarray(x, float)
    return sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))


def _lags(part, thresholds):
    """For each threshold the first dip below it, followed down to where it rises again; the deepest place where there is none."""
    lowest = np.minimum.accumulate(part)
    first = np.searchsorted(-lowest, -np.asarray(thresholds), side="right")  # the first place below each
    foot = np.arange(len(part))
    for i in range(len(part) - 2, -1, -1):
        if part[i + 1] < part[i]:
            foot[i] = foot[i + 1]
    return np.where(first < len(part), foot[np.minimum(first, len(part) - 1)], int(part.argmin()))


def pyin(y, sr, fmin=65.0, fmax=2093.0, size=2048, hop=None, n_thresholds=100, resolution=0.1, switch=0.01, center=True):
    """(Hz or NaN, voiced, probability) of each frame: a dip for each of many thresholds, decoded by Viterbi.

    A dip of depth d counts in its pitch bin with the share 1 - B(d) of a Beta(2, 18) distribution, and as unvoiced with the rest; a dip
    out of range counts as unvoiced altogether. Pitches move by a Gaussian of 35.92 semitones a second, at least half a semitone a frame.
    """
    hop = hop or size // 4
    low, high = max(1, int(sr / fmax)), min(int(sr / fmin), size // 2)
    framed = spectral.frames(np.asarray(y, float), size, hop, center)
    n_bins = int(np.ceil(12 * np.log2(fmax / fmin) / resolution))
    if high <= low or n_bins <= 0 or not len(framed):
        return np.full(len(framed), np.nan), np.zeros(len(framed), bool), np.zeros(len(framed))
    thresholds = np.arange(1, n_thresholds + 1) / n_thresholds
    obs, heard = np.zeros((len(framed), n_bins + 1)), np.zeros(len(framed))
    for t, f in enumerate(framed):
        d = cmndf(difference(f, high))
        part = d[low : high + 1]
        for lag, times in zip(*np.unique(_lags(part, thresholds) + low, return_counts=True)):
            hz = sr / parabola(d, int(lag))
            share = float(1 - beta_cdf(min(max(d[lag], 0.0), 1.0)))
            k = int(np.floor(12 * np.log2(hz / fmin) / resolution + 0.5)) if fmin <= hz <= fmax else -1
            heard[t] += times * share if k >= 0 else 0.0
            if 0 <= k < n_bins:
                obs[t, k] += times * share
                obs[t, -1] += times * (1 - share)
            else:
                obs[t, -1] += times
    total = obs.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        score = np.log(obs / total)
    score[:, -1] = np.maximum(score[:, -1], np.log(1e-30))
    k = np.arange(n_bins)
    spread = max(35.92 * hop / sr, 0.5)
    near = np.exp(-0.5 * ((k[:, None] - k[None, :]) * resolution / spread) ** 2)
    trans = np.zeros((n_bins + 1, n_bins + 1))
    with np.errstate(divide="ignore"):
        trans[:-1, :-1] = np.log(near / near.sum(axis=1, keepdims=True) * (1 - switch))
        trans[:-1, -1], trans[-1, :-1], trans[-1, -1] = np.log(switch), np.log(switch / n_bins), np.log(1 - switch)
    path = sequence.viterbi_log(score, np.full(n_bins + 1, -np.log(n_bins + 1)), trans)[0]
    on = path < n_bins
    return np.where(on, fmin * 2.0 ** (path * resolution / 12), np.nan), on, heard / n_thresholds


def piptrack(s, sr, n_fft, fmin=150.0, fmax=4000.0, threshold=0.1):
    """(frame, Hz, magnitude) of local peaks, refined by parabolas; the refined frequency must be in the range, and the bin at most one below it."""
    out = []
    bin_hz = sr / n_fft
    low, high = max(1, int(fmin / bin_hz)), min(s.shape[1] - 2, int(fmax / bin_hz))
    for t, row in enumerate(s):
        least = threshold * row.max() if len(row) else 0
        for i in range(low, high + 1):
            if row[i] > row[i - 1] and row[i] > row[i + 1] and row[i] >= least:
                bend = row[i - 1] - 2 * row[i] + row[i + 1]
                step = 0.5 * (row[i - 1] - row[i + 1]) / bend if abs(bend) > 1e-10 else 0.0
                hz = (i + step) * bin_hz
                if fmin <= hz <= fmax:
                    out.append((t, hz, float(row[i] - 0.25 * (row[i - 1] - row[i + 1]) * step)))
    return out


def pitch_tuning(hz, weights=None, resolution=0.01, bpo=12):
    """The most frequent deviation from equal temperament, in parts of a bin."""
    hz = np.asarray(hz, float)
    ok = hz > 0
    if not ok.any():
        return 0.0
    d = np.mod(bpo * np.log2(hz[ok] / 440.0), 1.0)
    d = np.where(d >= 0.5, d - 1, d)
    n = int(np.ceil(1 / resolution))
    count, edges = np.histogram(d, n, (-0.5, 0.5), weights=None if weights is None else np.asarray(weights)[ok])
    k = int(count.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def estimate_tuning(y, sr, n_fft=2048, resolution=0.01, bpo=12):
    peaks = piptrack(spectral.stft(y, n_fft), sr, n_fft)
    return pitch_tuning([p[1] for p in peaks], [p[2] for p in peaks], resolution, bpo) if peaks else 0.0
