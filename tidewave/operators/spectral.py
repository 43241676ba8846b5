"""Spectral kernels over one signal (numpy). Matrices are (frame, bin)."""

from __future__ import annotations

import numpy as np

from ..functions import banks
from ..functions.windows import hann


def frames(y: np.ndarray, size: int, hop: int, center: bool = False) -> np.ndarray:
    """Overlapping windows; a trailing partial one is dropped. Centred: zeros on both sides."""
    if center:
        y = np.pad(y, size // 2)
    if len(y) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop]


def origin_frames(y: np.ndarray, size: int = 2048, hop: int = 441, origin: str = "center") -> np.ndarray:
    """Framing with zeros on both sides (center), at the end (left) or nowhere (right)."""
    pad = {"center": (size // 2, size // 2), "left": (0, size), "right": (0, 0)}[origin]
    return frames(np.pad(y, pad), size, hop)


def stft_complex(y, n_fft=2048, hop=None, win=None, center=True, window=None) -> np.ndarray:
    """Empty unless n_fft is a power of two."""
    hop, win = hop or n_fft // 4, win or n_fft
    if n_fft & (n_fft - 1):
        return np.zeros((0, n_fft // 2 + 1), complex)
    w = hann(win) if window is None else window
    left = (n_fft - win) // 2
    w = np.pad(w, (left, n_fft - win - left))
    return np.fft.rfft(frames(np.asarray(y, float), n_fft, hop, center) * w, axis=1)


def stft(y, n_fft=2048, hop=None, win=None, center=True) -> np.ndarray:
    return np.abs(stft_complex(y, n_fft, hop, win, center))


def power(y, n_fft=2048, hop=None, win=None, center=True) -> np.ndarray:
    s = stft_complex(y, n_fft, hop, win, center)
    return s.real**2 + s.imag**2


def istft(s: np.ndarray, hop=None, win=None, center=True, length=None) -> np.ndarray:
    """Overlap-add of windowed inverse transforms, divided by the windows' squares where they aren't tiny."""
    n_fft = 2 * (s.shape[1] - 1)
    hop, win = hop or n_fft // 4, win or n_fft
    left = (n_fft - win) // 2
    w = np.pad(hann(win), (left, n_fft - win - left))
    size = n_fft + hop * max(len(s) - 1, 0)
    y, total = np.zeros(size), np.zeros(size)
    parts = np.fft.irfft(s, n_fft, axis=1) * w
    for t, part in enumerate(parts):
        y[t * hop : t * hop + n_fft] += part
        total[t * hop : t * hop + n_fft] += w * w
    y = np.where(total > 1e-10, y / np.maximum(total, 1e-300), y)
    if center:
        y = y[n_fft // 2 : size - n_fft // 2 if length is None else None]
    return y if length is None else np.pad(y, (0, max(0, length - len(y))))[:length]


def reassigned(y, sr, n_fft=2048, hop=None, center=True):
    """Magnitudes, and each cell's reassigned frequency and time; nominal ones where there is no energy."""
    hop = hop or n_fft // 4
    w = hann(n_fft)
    slope = np.gradient(w)
    ramp = (np.arange(n_fft) - n_fft // 2) * w
    h, dh, th = (stft_complex(y, n_fft, hop, None, center, x) for x in (w, slope, ramp))
    p = np.abs(h) ** 2
    loud = p > 1e-10
    safe = np.where(loud, p, 1)
    f = np.broadcast_to(banks.fft_frequencies(sr, n_fft), h.shape)
    t = np.broadcast_to((np.arange(len(h)) * hop / sr)[:, None], h.shape)
    freq = np.where(loud, f - (dh * h.conj()).imag / safe * sr / (2 * np.pi), f)
    time = np.where(loud, t + (th * h.conj()).real / safe / sr, t)
    return np.abs(h), freq, time


def _vq(y, sr, hop, fmin, fmax, bpo, gamma, n_fft):
    fmax = fmax or sr / 2
    n_bins = max(1, int(np.floor(np.log2(fmax / fmin) * bpo)))
    q = 1 / (2 ** (1 / bpo) - 1)
    if n_fft is None:
        n_fft = int(np.clip(2 ** int(np.ceil(np.log2(q * sr / fmin))), 2048, 65536))
    fb = banks.variable_q(sr, n_fft, n_bins, bpo, fmin, gamma)
    return power(y, n_fft, hop or n_fft // 4) @ fb.T, n_fft, q


def cqt(y, sr, hop=None, fmin=32.70319566257483, fmax=None, bpo=12, n_fft=None):
    return np.sqrt(_vq(y, sr, hop, fmin, fmax, bpo, 0.0, n_fft)[0])


def vqt(y, sr, hop=None, fmin=32.70319566257483, fmax=None, bpo=12, gamma=0.0, n_fft=None):
    return np.sqrt(_vq(y, sr, hop, fmin, fmax, bpo, gamma, n_fft)[0])


def hybrid_cqt(y, sr, hop=None, fmin=32.70319566257483, fmax=None, bpo=12, n_fft=None):
    """Log bins below the frequency at which they get as narrow as FFT bins, FFT bins above it."""
    p, n_fft, q = _vq(y, sr, hop, fmin, fmax, bpo, 0.0, n_fft)
    cut = q * sr / n_fft
    f = banks.cqt_frequencies(p.shape[1], fmin, bpo)
    linear = stft(y, n_fft, hop or n_fft // 4)
    upper = (banks.fft_frequencies(sr, n_fft) >= cut) & (banks.fft_frequencies(sr, n_fft) <= (fmax or sr / 2))
    return np.concatenate((np.sqrt(p)[:, f < cut], linear[:, upper]), axis=1)


def phase_vocoder(s: np.ndarray, rate: float, hop: int) -> np.ndarray:
    steps = np.arange(0, len(s), rate)
    n_fft = 2 * (s.shape[1] - 1)
    advance = 2 * np.pi * hop * np.arange(s.shape[1]) / n_fft
    padded = np.concatenate((s, np.zeros((2, s.shape[1]), complex)))
    phase = np.angle(s[0]) if len(s) else np.zeros(s.shape[1])
    out = np.zeros((len(steps), s.shape[1]), complex)
    for k, at in enumerate(steps):
        i, a = int(at), at - int(at)
        m = (1 - a) * np.abs(padded[i]) + a * np.abs(padded[i + 1])
        out[k] = m * np.exp(1j * phase)
        d = np.angle(padded[i + 1]) - np.angle(padded[i]) - advance
        phase = phase + advance + d - 2 * np.pi * np.round(d / (2 * np.pi))
    return out


def griffinlim(m: np.ndarray, n_iter: int = 32, hop=None, length=None, seed: int = 0) -> np.ndarray:
    """Seeded random phases, refined by turns of inverse and forward transform."""
    n_fft = 2 * (m.shape[1] - 1)
    s = m * np.exp(2j * np.pi * np.random.default_rng(seed).random(m.shape))
    for _ in range(n_iter):
        again = stft_complex(istft(s, hop), n_fft, hop)
        again = np.concatenate((again, np.zeros((max(0, len(m) - len(again)), m.shape[1]), complex)))[: len(m)]
        s = m * again / np.maximum(np.abs(again), 1e-12)
    return istft(s, hop, length=length)


def griffinlim_cqt(c: np.ndarray, sr, n_fft, hop=None, n_iter=32, fmin=32.70319566257483, bpo=12, seed=0):
    fb = banks.variable_q(sr, n_fft, c.shape[1], bpo, fmin)
    inverse = fb / np.maximum(fb.sum(axis=0, keepdims=True), 1e-10)
    return griffinlim(np.sqrt(c**2 @ inverse), n_iter, hop, seed=seed)


def power_to_db(s, ref=1.0, amin=1e-10, top_db=80.0):
    db = 10 * np.log10(np.maximum(s, amin) / ref)
    return np.maximum(db, db.max() - top_db) if top_db and top_db > 0 and db.size else db


def amplitude_to_db(s, ref=1.0, amin=1e-5, top_db=80.0):
    db = 20 * np.log10(np.maximum(s, amin) / ref)
    return np.maximum(db, db.max() - top_db) if top_db and top_db > 0 and db.size else db


def melspectrogram(y, sr, n_fft=2048, hop=512, n_mels=128, exponent=2.0, fmin=0.0, fmax=None, center=True):
    p = power(y, n_fft, hop, None, center)
    return (p if exponent == 2 else p ** (exponent / 2)) @ banks.mel(sr, n_fft, n_mels, fmin, fmax).T


def mfcc(y, sr, n_mfcc=20, n_fft=2048, hop=512, n_mels=128, center=True):
    return power_to_db(melspectrogram(y, sr, n_fft, hop, n_mels, center=center)) @ banks.dct(min(n_mfcc, n_mels), n_mels).T


def mel_to_stft(m, sr, n_fft=2048, exponent=1.0):
    """Regularised pseudo-inverse of the mel bank, negative values cut off."""
    fb = banks.mel(sr, n_fft, m.shape[1])
    s = np.maximum(m @ np.linalg.solve(fb @ fb.T + 1e-6 * np.eye(len(fb)), fb), 0)
    return s ** (1 / exponent) if exponent > 1 else s


def mel_to_audio(m, sr, n_fft=2048, hop=512, exponent=2.0, n_iter=32, seed=0):
    return griffinlim(mel_to_stft(m, sr, n_fft, exponent), n_iter, hop, seed=seed)


def mfcc_to_mel(c, n_mels=128):
    return 10 ** (c @ banks.dct(c.shape[1], n_mels) / 10)


def mfcc_to_audio(c, sr, n_mels=128, n_fft=2048, hop=512, n_iter=32, seed=0):
    return mel_to_audio(mfcc_to_mel(c, n_mels), sr, n_fft, hop, 2.0, n_iter, seed)


def pcen(s, sr, hop, gain=0.98, bias=2.0, exponent=0.5, time_constant=0.06, eps=1e-6):
    """Per-channel energy normalisation: an automatic gain by a first-order mean, then a root."""
    t = sr / (hop * 2 * np.pi * time_constant)
    b = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    m = np.empty_like(s)
    for k in range(len(s)):
        m[k] = s[0] if k == 0 else (1 - b) * m[k - 1] + b * s[k]
    return (s / (eps + m) ** gain + bias) ** exponent - bias**exponent


def resample(y, sr, target, zeros=64, beta=6.0):
    """Windowed sinc interpolation."""
    ratio = target / sr
    scale = min(1.0, ratio)
    n = int(np.ceil(len(y) * ratio))
    span = int(np.ceil(zeros / scale))
    at = np.arange(n) / ratio
    base = np.floor(at).astype(int)
    out = np.zeros(n)
    for k in range(-span + 1, span + 1):
        i = base + k
        d = (at - i) * scale
        ok = (i >= 0) & (i < len(y)) & (np.abs(d) <= zeros)
        u = np.clip(d / zeros, -1, 1)
        out += np.where(ok, y[np.clip(i, 0, max(len(y) - 1, 0))] * np.sinc(d) * np.i0(beta * np.sqrt(1 - u * u)) / np.i0(beta), 0) if len(y) else 0
    return out * scale


def autocorrelate(y, max_size=None):
    n = len(y)
    f = np.fft.rfft(y, 1 << int(np.ceil(np.log2(max(2 * n, 2)))))
    return np.fft.irfft(f * f.conj())[: min(max_size or n, n)]


def lpc(y, order):
    """Burg's recursion; the first coefficient is 1."""
    a = np.array([1.0])
    f, b = np.array(y[1:], float), np.array(y[:-1], float)
    for _ in range(order):
        den = (f @ f) + (b @ b)
        k = -2 * (f @ b) / den if den > 1e-300 else 0.0
        a = np.append(a, 0) + k * np.append(a, 0)[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def tone(frequency, sr=22050.0, length=None, duration=None, phi=0.0):
    n = int(duration * sr) if duration is not None else (length or int(sr))
    return np.sin(2 * np.pi * frequency * np.arange(n) / sr + phi)


def chirp(fmin, fmax, sr=22050.0, length=None, duration=None, linear=True):
    n = int(duration * sr) if duration is not None else (length or int(sr))
    t, total = np.arange(n) / sr, n / sr
    if linear:
        return np.sin(2 * np.pi * (fmin * t + (fmax - fmin) * t * t / (2 * total)))
    if fmin <= 0 or fmax <= 0:
        return np.zeros(n)
    k = np.log(fmax / fmin) / total
    return np.sin(2 * np.pi * fmin * (np.expm1(k * t) / k if abs(k) > 1e-12 else t))


def clicks(times=None, sr=22050.0, length=None, freq=1000.0, duration=0.1, frames=None):
    """Sines that fall to e^-5 over `duration`, added at times (cut to whole samples), or at samples `frames`; without either, every half second of `length` samples, or of 5 seconds."""
    if times is None and frames is None:
        times = np.arange(int((length / sr if length is not None else 5.0) / 0.5)) * 0.5
    at = (np.asarray(times, float) * sr).astype(int) if times is not None else np.asarray(frames, int)
    n = int(duration * sr)
    y = np.zeros(length if length is not None else (int(at.max()) if len(at) else 0) + n)
    t = np.arange(n) / sr
    click = np.sin(2 * np.pi * freq * t) * np.exp(-5 * t / duration)
    for a in at[(at >= 0) & (at < len(y))]:
        part = y[a : a + n]
        part += click[: len(part)]
    return y
