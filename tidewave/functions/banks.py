"""Filter banks and bases, as numpy matrices (band, bin) made once on the driver."""

from __future__ import annotations

import numpy as np

_BREAK_HZ, _BREAK_MEL, _STEP = 1000.0, 15.0, np.log(6.4) / 27


def hz_to_mel(f, htk: bool = False):
    f = np.asarray(f, float)
    if htk:
        return 2595 * np.log10(1 + f / 700)
    return np.where(f < _BREAK_HZ, 3 * f / 200, _BREAK_MEL + np.log(np.maximum(f, 1e-30) / _BREAK_HZ) / _STEP)


def mel_to_hz(m, htk: bool = False):
    m = np.asarray(m, float)
    if htk:
        return 700 * (10 ** (m / 2595) - 1)
    return np.where(m < _BREAK_MEL, 200 * m / 3, _BREAK_HZ * np.exp(_STEP * (m - _BREAK_MEL)))


def fft_frequencies(sr: float, n_fft: int) -> np.ndarray:
    return np.arange(n_fft // 2 + 1) * sr / n_fft


def mel_frequencies(n: int = 128, fmin: float = 0.0, fmax: float = 11025.0, htk: bool = False) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(fmin, htk), hz_to_mel(fmax, htk), n), htk)


def cqt_frequencies(n: int, fmin: float = 32.70319566257483, bins_per_octave: int = 12) -> np.ndarray:
    return fmin * 2.0 ** (np.arange(n) / bins_per_octave)


def tempo_frequencies(n: int, hop: int = 512, sr: float = 22050) -> np.ndarray:
    """BPM of each lag; lag 0 is infinite."""
    with np.errstate(divide="ignore"):
        return 60 * sr / (hop * np.arange(n, dtype=float))


def fourier_tempo_frequencies(win: int = 384, hop: int = 512, sr: float = 22050) -> np.ndarray:
    return np.arange(win // 2 + 1) * sr * 60 / (hop * win)


def _triangles(points: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    left, mid, right = points[:-2, None], points[1:-1, None], points[2:, None]
    up = (freqs - left) / np.maximum(mid - left, 1e-12)
    down = (right - freqs) / np.maximum(right - mid, 1e-12)
    return np.maximum(0, np.minimum(up, down))


def mel(sr: float, n_fft: int, n_mels: int = 128, fmin: float = 0.0, fmax: float | None = None, htk: bool = False, area: bool = True) -> np.ndarray:
    """Triangles between mel-spaced points; with `area` each has area one."""
    points = mel_frequencies(n_mels + 2, fmin, fmax or sr / 2, htk)
    fb = _triangles(points, fft_frequencies(sr, n_fft)[None, :])
    return fb * (2 / (points[2:] - points[:-2]))[:, None] if area else fb


def logarithmic(sr: float, n_fft: int, bands_per_octave: int = 24, fmin: float = 65.0, fmax: float = 2100.0, fref: float = 440.0, unique: bool = True) -> np.ndarray:
    """Triangles between the FFT bins nearest to frequencies spaced evenly on a log scale around fref."""
    low = int(np.floor(np.log2(fmin / fref) * bands_per_octave))
    high = int(np.ceil(np.log2(fmax / fref) * bands_per_octave))
    f = fref * 2.0 ** (np.arange(low, high + 1) / bands_per_octave)
    bins = np.clip(np.round(f[(f >= fmin) & (f <= fmax)] * n_fft / sr).astype(int), 0, n_fft // 2)
    bins = np.unique(bins) if unique else bins
    return _triangles(bins.astype(float), np.arange(n_fft // 2 + 1)[None, :].astype(float)) if len(bins) > 2 else np.zeros((0, n_fft // 2 + 1))


def variable_q(sr: float, n_fft: int, n_bins: int = 84, bins_per_octave: int = 12, fmin: float = 32.70319566257483, gamma: float = 0.0) -> np.ndarray:
    """Triangles around each bin's frequency, at least two FFT bins wide, rows of sum one."""
    f = cqt_frequencies(n_bins, fmin, bins_per_octave)
    q = 1 / (2 ** (1 / bins_per_octave) - 1)
    width = np.maximum(f / q + gamma, 2 * sr / n_fft)[:, None]
    fb = np.maximum(0, 1 - np.abs(fft_frequencies(sr, n_fft)[None, :] - f[:, None]) / (width / 2))
    total = fb.sum(axis=1, keepdims=True)
    return np.where(total > 0, fb / np.maximum(total, 1e-300), 0)


def constant_q(sr: float, n_fft: int, n_bins: int = 84, bins_per_octave: int = 12, fmin: float = 32.70319566257483, gamma: float = 0.0) -> np.ndarray:
    return variable_q(sr, n_fft, n_bins, bins_per_octave, fmin, 0.0)


def constant_q_wavelets(sr: float, n_bins: int = 84, bins_per_octave: int = 12, fmin: float = 32.70319566257483, norm: int = 1) -> list[np.ndarray]:
    """Windowed complex exponentials of constant Q."""
    q = 1 / (2 ** (1 / bins_per_octave) - 1)
    out = []
    for f in cqt_frequencies(n_bins, fmin, bins_per_octave):
        n = int(np.ceil(q * sr / f))
        t = np.arange(n) - n // 2
        w = np.hanning(n) * np.exp(2j * np.pi * f / sr * t)
        out.append(w / max(np.linalg.norm(w, norm), 1e-12))
    return out


def chroma(sr: float, n_fft: int, n_chroma: int = 12, tuning: float = 0.0, ctroct: float = 5.0, octwidth: float = 2.0, norm: float | None = 2, base_c: bool = True) -> np.ndarray:
    """Gaussian bumps around each pitch class, weighted by octave."""
    f = np.arange(1, n_fft) * sr / n_fft
    bins = n_chroma * np.log2(f / (440.0 * 2 ** (tuning / n_chroma) / 16))
    bins = np.concatenate(([bins[0] - 1.5 * n_chroma], bins))
    widths = np.concatenate((np.maximum(np.diff(bins), 1.0), [1]))
    d = bins[None, :] - np.arange(n_chroma)[:, None]
    half = round(n_chroma / 2)
    d = np.remainder(d + half + 10 * n_chroma, n_chroma) - half
    w = np.exp(-0.5 * (2 * d / widths[None, :]) ** 2)
    if norm:
        w = w / np.maximum(np.linalg.norm(w, norm, axis=0, keepdims=True), 1e-12)
    w = w * np.exp(-0.5 * ((bins / n_chroma - ctroct) / octwidth) ** 2)[None, :]
    if base_c:
        w = np.roll(w, -3 * (n_chroma // 12), axis=0)
    return w[:, : n_fft // 2 + 1]


def dct(n: int, size: int) -> np.ndarray:
    """The first n rows of the orthonormal DCT-II."""
    k, i = np.arange(n)[:, None], np.arange(size)[None, :]
    d = np.cos(np.pi * k * (2 * i + 1) / (2 * size)) * np.sqrt(2 / size)
    d[0] /= np.sqrt(2)
    return d


def tonnetz(n_chroma: int = 12) -> np.ndarray:
    """Fifths, minor thirds and major thirds, each as sine and cosine, of radius 1, 1 and 1/2."""
    c = np.arange(n_chroma)
    rows = []
    for step, radius in ((7, 1.0), (3, 1.0), (4, 0.5)):
        angle = np.pi * c * {7: 7 / 6, 3: 3 / 2, 4: 2 / 3}[step]
        rows += [radius * np.sin(angle), radius * np.cos(angle)]
    return np.array(rows)


def savgol(width: int, order: int, degree: int | None = None) -> np.ndarray:
    """Weights of the Savitzky-Golay derivative of an order over a centred window."""
    half = width // 2
    degree = order if degree is None else degree
    a = np.arange(-half, half + 1)[:, None] ** np.arange(degree + 1)[None, :]
    return np.linalg.pinv(a.astype(float))[order] * float(np.prod(np.arange(1, order + 1)))


def a_weighting(f):
    f2 = np.asarray(f, float) ** 2
    c = np.array([12194.0, 20.6, 107.7, 737.9]) ** 2
    with np.errstate(divide="ignore"):
        return 2.0 + 20 * (np.log10(c[0]) + 2 * np.log10(f2) - np.log10(f2 + c[0]) - np.log10(f2 + c[1]) - 0.5 * np.log10(f2 + c[2]) - 0.5 * np.log10(f2 + c[3]))


def semitone_biquads(freq: float, sr: float, order: int = 4) -> np.ndarray:
    """order/2 equal band-pass sections (b0, b1, b2, a1, a2) one semitone wide; passes all near Nyquist."""
    if freq >= 0.95 * sr / 2:
        return np.tile([1.0, 0, 0, 0, 0], (order // 2, 1))
    q = 1 / (2 ** (1 / 12) - 2 ** (-1 / 12))
    w = 2 * np.pi * freq / sr
    alpha = np.sin(w) / (2 * q)
    a0 = 1 + alpha
    return np.tile([alpha / a0, 0, -alpha / a0, -2 * np.cos(w) / a0, (1 - alpha) / a0], (order // 2, 1))


def semitone_frequencies(low: int = 24, high: int = 119) -> np.ndarray:
    return 440 * 2.0 ** ((np.arange(low, high + 1) - 69) / 12)
