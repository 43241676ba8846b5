"""Evaluation kernels (numpy)."""

from __future__ import annotations

import numpy as np


def onset_scores(ref, est, window=0.05):
    """(precision, recall, F): references in time order each take the nearest unused estimate within the window."""
    ref, est = np.sort(ref), np.sort(est)
    if not len(ref) or not len(est):
        return 0.0, 0.0, 0.0
    free, hits = np.ones(len(est), bool), 0
    for r in ref:
        d = np.where(free, np.abs(est - r), np.inf)
        k = int(d.argmin())
        if d[k] <= window:
            free[k] = False
            hits += 1
    p, q = hits / len(est), hits / len(ref)
    return p, q, 2 * p * q / (p + q) if hits else 0.0


def cemgil(ref, est, sigma=0.04):
    if not len(ref) or not len(est):
        return 0.0
    return float(np.exp(-((np.asarray(ref)[:, None] - np.asarray(est)[None, :]) ** 2) / (2 * sigma**2)).max(axis=1).mean())


def p_score(ref, est, window=0.02, rate=100):
    """Cosine of pulse trains, each pulse a Gaussian over the samples within three deviations of the one it falls on."""
    if not len(ref) or not len(est):
        return 0.0
    trains, reach = np.zeros((2, int((max(max(ref), max(est)) + 1) * rate) + 1)), int(window * rate * 3)
    for train, beats in zip(trains, (ref, est)):
        for x in beats:
            i = np.arange(max(0, int(x * rate) - reach), min(len(train), int(x * rate) + reach + 1))
            train[i] += np.exp(-0.5 * ((i - x * rate) / (window * rate)) ** 2)
    size = np.linalg.norm(trains[0]) * np.linalg.norm(trains[1])
    return float(trains[0] @ trains[1] / size) if size > 0 else 0.0


def continuity(ref, est, window=0.175):
    """Longest run of references that are met, over their number.

    A reference is met by the first estimate, going on from the one before, that isn't
    earlier than a share of the local period before it, if that lies within the same
    share of it; the last estimate is never passed.
    """
    ref, est = np.sort(np.asarray(ref, float)), np.sort(np.asarray(est, float))
    if len(ref) < 2 or len(est) < 2:
        return 0.0
    gap = np.diff(ref)
    reach = window * np.append(gap, gap[-1])
    at = np.minimum(np.searchsorted(est, np.maximum.accumulate(ref - reach)), len(est) - 1)
    met = np.abs(est[at] - ref) <= reach
    best = run = 0
    for x in met:
        run = run + 1 if x else 0
        best = max(best, run)
    return best / len(ref)


def continuity_any(ref, est, window=0.175):
    """The best over the estimates as they are, with one more halfway between any two, and, of four or more, every other one."""
    est = np.sort(np.asarray(est, float))
    if len(est) < 2:
        return 0.0
    tried = [est, np.sort(np.concatenate((est, (est[1:] + est[:-1]) / 2)))]
    return max(continuity(ref, e, window) for e in (tried + [est[::2], est[1::2]] if len(est) >= 4 else tried))


def beat_scores(ref, est, window=0.07):
    c, a = continuity(ref, est), continuity_any(ref, est)
    return {"f_measure": onset_scores(ref, est, window)[2], "cemgil": cemgil(ref, est), "p_score": p_score(ref, est), "cml_c": c, "cml_t": c, "aml_c": a, "aml_t": a}


def tempo_scores(ref, est, tolerance=0.08):
    """(1 if within the tolerance of the reference or its double, triple, half or third, the same as p score)."""
    ok = float(any(abs(est - ref * k) <= tolerance * ref * k for k in (1, 2, 3, 1 / 2, 1 / 3)))
    return ok, ok
