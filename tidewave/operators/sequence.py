"""Sequence decoding kernels: hidden Markov models, linear-chain CRFs, dynamic time warping (numpy)."""

from __future__ import annotations

import numpy as np

TINY = 1e-10


def viterbi_log(obs, init, trans):
    """(path, log probability) from log scores; ties go to the lower state."""
    n, states = obs.shape
    if n == 0:
        return np.zeros(0, np.int64), 0.0
    best, back = init + obs[0], np.zeros((n, states), np.int64)
    for t in range(1, n):
        m = best[:, None] + trans
        back[t] = m.argmax(axis=0)
        best = m.max(axis=0) + obs[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(best.max())


def _log(p):
    return np.log(np.maximum(p, TINY))


def viterbi(prob, transition=None, initial=None):
    k = prob.shape[1]
    t = np.full((k, k), 1 / k) if transition is None else np.asarray(transition, float)
    i = np.full(k, 1 / k) if initial is None else np.asarray(initial, float)
    return viterbi_log(_log(prob), _log(i), _log(t))


def viterbi_discriminative(prob, transition=None):
    k = prob.shape[1]
    t = np.full((k, k), 1 / k) if transition is None else np.asarray(transition, float)
    return crf_viterbi(_log(prob), _log(t))


def viterbi_binary(prob, loop=0.9):
    p = np.asarray(prob, float)
    return viterbi(np.stack([1 - p, p], axis=1), transition_loop(2, loop))


def crf_viterbi(unary, pairwise):
    return viterbi_log(unary, np.zeros(unary.shape[1]), pairwise)


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward(obs, init, trans):
    a = np.zeros_like(obs)
    a[0] = init + obs[0]
    for t in range(1, len(obs)):
        a[t] = _lse(a[t - 1][:, None] + trans, 0) + obs[t]
    return a


def backward(obs, trans):
    b = np.zeros_like(obs)
    for t in range(len(obs) - 2, -1, -1):
        b[t] = _lse(trans + obs[t + 1] + b[t + 1], 1)
    return b


def posteriors(obs, init, trans):
    g = forward(obs, init, trans) + backward(obs, trans)
    return np.exp(g - _lse(g, 1)[:, None])


def crf_log_partition(unary, pairwise):
    return float(_lse(forward(unary, np.zeros(unary.shape[1]), pairwise)[-1], 0))


def crf_marginals(unary, pairwise):
    return posteriors(unary, np.zeros(unary.shape[1]), pairwise)


def transition_uniform(n):
    return np.full((n, n), 1 / n)


def transition_loop(n, p):
    return np.where(np.eye(n, dtype=bool), p, (1 - p) / max(n - 1, 1))


def transition_cycle(n, p):
    m = np.zeros((n, n))
    i = np.arange(n)
    m[i, i] += p
    m[i, (i + 1) % n] += 1 - p
    return m


def transition_local(n, width, window="triangle", wrap=False):
    """Steps to the states around each, weighted by a window as wide as `width` (one number, or one for each state): triangle (0 at both ends), hann, or even."""
    m = np.zeros((n, n))
    for i, w in enumerate(np.broadcast_to(np.asarray(width, int), n)):
        weights = {"triangle": np.bartlett, "hann": np.hanning}.get(window, np.ones)(int(w))
        to = i + np.arange(w) - w // 2
        to, inside = (to % n, np.ones(w, bool)) if wrap else (to, (to >= 0) & (to < n))
        m[i, to[inside]] = weights[inside]
    total = m.sum(axis=1, keepdims=True)
    return np.divide(m, total, out=m, where=total > 0)


def left_to_right(n, p=0.9):
    m = np.diag(np.full(n, p)) + np.diag(np.full(n - 1, 1 - p), 1)
    m[-1, -1] = 1
    return m


def dtw(cost, band=None, symmetric2=False):
    """Cumulative cost; infinite outside a Sakoe-Chiba band of so many cells of the longer side, each place taken as a share of its own side."""
    n, m = cost.shape
    d = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(m):
            if band is not None and abs(i / n - j / m) > band / max(n, m):
                continue
            if i == j == 0:
                d[0, 0] = cost[0, 0]
                continue
            w = 2 if symmetric2 else 1
            d[i, j] = min(d[i - 1, j - 1] + cost[i, j] if i and j else np.inf, d[i - 1, j] + w * cost[i, j] if i else np.inf, d[i, j - 1] + w * cost[i, j] if j else np.inf)
    return d


def dtw_path(d):
    """Backwards along the least cumulative cost; diagonal first, then up, then left."""
    i, j = d.shape[0] - 1, d.shape[1] - 1
    path = [(i, j)]
    while i or j:
        steps = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        i, j = min((s for s in steps if s[0] >= 0 and s[1] >= 0), key=lambda s: d[s])
        path.append((i, j))
    return path[::-1]


def pairwise(x, y, metric="euclidean"):
    if metric == "cosine":
        a, b = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        return 1 - (x @ y.T) / np.maximum(a[:, None] * b[None, :], TINY)
    # by differences, so that equal rows are at distance 0; in blocks of rows that bound memory
    step = max(1, (1 << 22) // max(1, y.size))
    return np.concatenate([np.sqrt(((x[i : i + step, None, :] - y[None]) ** 2).sum(axis=2)) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, len(y)))


def runs(labels):
    """(start, end, label) of runs of equal labels, end exclusive."""
    x = np.asarray(labels)
    if not len(x):
        return []
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    s = np.concatenate(([0], cut))
    return [(int(a), int(b), x[a].item()) for a, b in zip(s, np.concatenate((cut, [len(x)])))]


def gmm_log_likelihood(x, weights, means, variances):
    """(log likelihood, log responsibilities) of rows under Gaussians of diagonal covariance."""
    g = -0.5 * (np.log(2 * np.pi * variances).sum(1)[None, :] + (((x[:, None, :] - means) ** 2) / variances).sum(2)) + np.log(weights)
    total = _lse(g, 1)
    return total, g - total[:, None]
