"""Window functions, as numpy arrays made once on the driver."""

from __future__ import annotations

import numpy as np


def general_cosine(n: int, coefficients, periodic: bool = True) -> np.ndarray:
    """Sum of cosines with alternating signs."""
    if n == 1:
        return np.ones(1)
    x = 2 * np.pi * np.arange(n) / (n if periodic else n - 1)
    return sum((-1) ** k * a * np.cos(k * x) for k, a in enumerate(coefficients))


def hann(n: int, periodic: bool = True) -> np.ndarray:
    return general_cosine(n, (0.5, 0.5), periodic)


def hamming(n: int, periodic: bool = True) -> np.ndarray:
    return general_cosine(n, (0.54, 0.46), periodic)


def blackman(n: int, periodic: bool = True) -> np.ndarray:
    return general_cosine(n, (0.42, 0.5, 0.08), periodic)


def bartlett(n: int, periodic: bool = True) -> np.ndarray:
    m = n + 1 if periodic else n
    return np.ones(1) if n == 1 else 1 - np.abs(2 * np.arange(n) / (m - 1) - 1)


def kaiser(n: int, beta: float = 12.0, periodic: bool = True) -> np.ndarray:
    m = n + 1 if periodic else n
    return np.ones(1) if n == 1 else np.kaiser(m, beta)[:n]


def rectangular(n: int) -> np.ndarray:
    return np.ones(n)


def triangular(n: int, periodic: bool = True) -> np.ndarray:
    m = n + 1 if periodic else n
    return 1 - np.abs(2 * (np.arange(n) - (m - 1) / 2) / (m + 1))


WINDOWS = {f.__name__: f for f in (hann, hamming, blackman, bartlett, kaiser, rectangular, triangular)}
