"""Effect kernels (numpy)."""

from __future__ import annotations

import numpy as np

from ..functions import banks
from . import features, spectral


def preemphasis(y, coef=0.97):
    return np.append(y[:1], y[1:] - coef * y[:-1])


def deemphasis(y, coef=0.97):
    out = np.array(y, float)
    for i in range(1, len(out)):
        out[i] += coef * out[i - 1]
    return out


def median_filter(x, size, axis):
    """Upper median of a window that is cut at the edges."""
    half, n = size // 2, x.shape[axis]
    x = np.moveaxis(x, axis, 0)
    return np.moveaxis(np.stack([(lambda w: np.sort(w, axis=0)[len(w) // 2])(x[max(0, i - half) : i + half + 1]) for i in range(n)]), 0, axis) if n else np.moveaxis(x, 0, axis)


def soft_mask(a, b, exponent=2.0, margin=1.0):
    p, q = (margin * a) ** exponent, b**exponent
    return p / (p + q + 1e-10)


def hpss_masks(m, kernel=31, exponent=2.0, margin=1.0):
    h, p = median_filter(m, kernel, 0), median_filter(m, kernel, 1)
    return soft_mask(h, p, exponent, margin), soft_mask(p, h, exponent, margin)


def hpss(y, n_fft=2048, hop=None, kernel=31, exponent=2.0, margin=1.0):
    """(harmonic, percussive)."""
    s = spectral.stft_complex(y, n_fft, hop)
    h, p = hpss_masks(np.abs(s), kernel, exponent, margin)
    return spectral.istft(s * h, hop, length=len(y)), spectral.istft(s * p, hop, length=len(y))


def time_stretch(y, rate, n_fft=2048, hop=None):
    hop = hop or n_fft // 4
    return spectral.istft(spectral.phase_vocoder(spectral.stft_complex(y, n_fft, hop), rate, hop), hop)


def pitch_shift(y, sr, steps, bpo=12):
    """Stretched, then resampled, then cut or filled to the input's length; no steps give the input."""
    if steps == 0:
        return np.array(y, float)
    rate = 2.0 ** (steps / bpo)
    out = spectral.resample(time_stretch(y, rate), sr, round(sr / rate))
    return np.pad(out, (0, max(0, len(y) - len(out))))[: len(y)]


def _loud(y, top_db, size, hop):
    r = features.rms(y, size, hop, center=False)
    return r >= r.max() * 10 ** (-top_db / 20) if len(r) and r.max() > 0 else np.zeros(len(r), bool)


def trim(y, top_db=60.0, size=2048, hop=512):
    """(start, end) in samples."""
    on = np.flatnonzero(_loud(y, top_db, size, hop))
    return (int(on[0] * hop), int(min(len(y), on[-1] * hop + size))) if len(on) else (0, 0)


def split(y, top_db=60.0, size=2048, hop=512):
    on = np.concatenate(([0], _loud(y, top_db, size, hop).astype(int), [0]))
    d = np.diff(on)
    return [(int(a * hop), int(min(len(y), (b - 1) * hop + size))) for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]


def biquad_cascade(y, sections):
    out = np.array(y, float)
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        for i, x in enumerate(out):
            v = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, x, y1, v
            out[i] = v
    return out


def semitone_filterbank(y, sr, low=24, high=119, order=4):
    """One filtered signal for each semitone; all are filtered together, sample by sample."""
    sections = np.stack([banks.semitone_biquads(f, sr, order) for f in banks.semitone_frequencies(low, high)])
    out = np.repeat(np.asarray(y, float)[None, :], len(sections), axis=0)
    for k in range(sections.shape[1]):
        b0, b1, b2, a1, a2 = sections[:, k].T
        x1 = x2 = y1 = y2 = np.zeros(len(sections))
        for i in range(out.shape[1]):
            x = out[:, i].copy()
            v = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, x, y1, v
            out[:, i] = v
    return out
