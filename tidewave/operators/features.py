"""Feature kernels on magnitude matrices (frame, bin) or signals (numpy)."""

from __future__ import annotations

import numpy as np

from ..functions import banks
from . import spectral


def centroid(s, f):
    total = s.sum(axis=1)
    return np.where(total > 0, s @ f / np.where(total > 0, total, 1), 0)


def bandwidth(s, f, p=2.0):
    total = s.sum(axis=1)
    d = np.abs(f[None, :] - centroid(s, f)[:, None]) ** p
    return np.where(total > 0, (s * d).sum(axis=1) / np.where(total > 0, total, 1), 0) ** (1 / p)


def rolloff(s, f, share=0.85):
    c = s.cumsum(axis=1)
    return f[(c >= share * c[:, -1:]).argmax(axis=1)] if len(s) else np.zeros(0)


def flatness(s, exponent=2.0, amin=1e-10):
    x = np.maximum(s**exponent, amin)
    return np.where(s.sum(axis=1) < amin, 0, np.exp(np.log(x).mean(axis=1)) / x.mean(axis=1))


def contrast(s, f, n_bands=6, fmin=200.0, quantile=0.02):
    """dB between the means of the strongest and the weakest bins of each octave band, the band below fmin first, the last one up to the highest frequency. Edges and shares are rounded to whole bins, halves up."""
    hz = np.concatenate(([0], fmin * 2.0 ** np.arange(n_bands), f[-1:]))
    edges = np.minimum(np.floor(hz / (f[1] - f[0]) + 0.5).astype(int), s.shape[1])
    out = np.zeros((len(s), n_bands + 1))
    for k in range(n_bands + 1):
        band = np.sort(s[:, edges[k] : edges[k + 1]], axis=1)
        if band.shape[1]:
            q = max(1, int(quantile * band.shape[1] + 0.5))
            out[:, k] = 10 * np.log10(np.maximum(band[:, -q:].mean(axis=1), 1e-10)) - 10 * np.log10(np.maximum(band[:, :q].mean(axis=1), 1e-10))
    return out


def rms(y, size=2048, hop=512, center=True):
    return np.sqrt((spectral.frames(y, size, hop, center) ** 2).mean(axis=1))


def zero_crossing_rate(y, size=2048, hop=512, center=True):
    """Changes of the sign bit in a frame, over the frame's length."""
    s = np.signbit(spectral.frames(y, size, hop, center))
    return (s[:, 1:] != s[:, :-1]).sum(axis=1) / size


def normalize(x, norm=2.0):
    n = np.abs(x).max(axis=1) if norm == np.inf else (np.abs(x) ** norm).sum(axis=1) ** (1 / norm)
    return np.where(n[:, None] > 1e-10, x / np.where(n > 1e-10, n, 1)[:, None], x)


def chroma_stft(y, sr, n_fft=2048, hop=512, n_chroma=12, norm=None, tuning=0.0, center=True):
    c = spectral.power(y, n_fft, hop, None, center) @ banks.chroma(sr, n_fft, n_chroma, tuning).T
    return c if norm is None else normalize(c, norm)


def fold(c, bpo, n_chroma=12):
    """Bins of equal position in their octave, added."""
    out = np.zeros((len(c), n_chroma))
    for b in range(c.shape[1]):
        out[:, (b % bpo) * n_chroma // bpo] += c[:, b]
    return out


def chroma_cqt(y, sr, hop=None, bpo=36, octaves=7, norm=None, gamma=None):
    fmin = 32.70319566257483
    top = min(fmin * 2.0**octaves, sr / 2)
    c = spectral.cqt(y, sr, hop, fmin, top, bpo) if gamma is None else spectral.vqt(y, sr, hop, fmin, top, bpo, gamma)
    c = fold(c, bpo)
    return c if norm is None else normalize(c, norm)


def chroma_vqt(y, sr, hop=None, bpo=36, octaves=7, norm=None, gamma=0.0):
    return chroma_cqt(y, sr, hop, bpo, octaves, norm, gamma)


def cens(chroma, smooth=41):
    """Quantised, smoothed and normalised chroma; the edges repeat the outermost frames."""
    x = normalize(chroma, 1.0)
    q = sum((x >= t).astype(float) for t in (0.05, 0.1, 0.2, 0.4))
    w = np.hanning(smooth)
    half = smooth // 2
    padded = np.pad(q, ((half, half), (0, 0)), mode="edge") if len(q) else q
    out = np.stack([(padded[t : t + smooth] * w[:, None]).sum(axis=0) / w.sum() for t in range(len(q))]) if len(q) else q
    return normalize(out, 2.0) if len(q) else out


def tonnetz(chroma):
    total = np.abs(chroma).sum(axis=1, keepdims=True)
    return np.where(total > 1e-10, chroma / np.where(total > 1e-10, total, 1), 0) @ banks.tonnetz(chroma.shape[1]).T


def delta(x, width=9, order=1):
    """Savitzky-Golay derivative over frames; the edges repeat the outermost whole window's. Empty if there are too few frames."""
    if len(x) < width:
        return np.zeros((0, x.shape[1]))
    w = banks.savgol(width, order)
    inner = np.einsum("tfw,w->tf", np.lib.stride_tricks.sliding_window_view(x, width, axis=0), w)
    return np.pad(inner, ((width // 2, width // 2), (0, 0)), mode="edge")


def stack_memory(x, steps=2, delay=1):
    return np.concatenate([np.pad(x, ((k * delay, 0), (0, 0)))[: len(x)] for k in range(steps)], axis=1)


def poly_features(s, f, order=1):
    """Least-squares coefficients over frequency, highest power first."""
    return s @ np.linalg.pinv(np.vander(f, order + 1)).T


def interp_harmonics(s, f, harmonics):
    """(frame, harmonic, bin): magnitudes at multiples of each bin's frequency."""
    return np.stack([[np.interp(h * f, f, row, left=0, right=0) for h in harmonics] for row in s]) if len(s) else np.zeros((0, len(harmonics), len(f)))


def f0_harmonics(s, f, f0, harmonics):
    """Magnitudes at multiples of each frame's pitch; zeros where that is NaN or not positive."""
    rows = [np.interp(np.asarray(harmonics) * a, f, row, left=0, right=0) if a > 0 else np.zeros(len(harmonics)) for row, a in zip(s, f0)]
    return np.stack(rows) if rows else np.zeros((0, len(harmonics)))


def salience(s, f, harmonics=(1, 2, 3, 4, 5), weights=None, aggregate=None):
    """Weighted magnitudes at the harmonics, aggregated over these: their plain mean by default."""
    w = np.ones(len(harmonics)) if weights is None else np.asarray(weights, float)
    h = interp_harmonics(s, f, harmonics) * w[None, :, None]
    return h.mean(axis=1) if aggregate is None else aggregate(h)


def tempogram_ratio(t, bpms, base=120.0, factors=(1, 2, 3, 4), norm=np.inf):
    """The tempogram at multiples of a tempo, zero beyond its finite tempi; each frame is normalised."""
    known = np.isfinite(bpms) & (bpms > 0)
    if known.sum() < 2:
        return np.zeros((len(t), len(factors)))
    order = np.flatnonzero(known)[np.argsort(bpms[known])]
    x = np.array([np.interp(base * np.asarray(factors, float), bpms[order], row[order], left=0, right=0) for row in t]).reshape(len(t), len(factors))
    return x if norm is None else normalize(x, norm)


def deep_chroma_context(s, width=15):
    """Frames joined with their neighbours, zeros beyond the edges: the input of a dense network."""
    half = width // 2
    p = np.pad(s, ((half, half), (0, 0)))
    return np.concatenate([p[k : k + len(s)] for k in range(width)], axis=1)
