"""Network layers, ensembles and chunked inference (numpy)."""

from __future__ import annotations

import numpy as np

ACTIVATIONS = {
    "linear": lambda x: x, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh, "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "softmax": lambda x: (lambda e: e / e.sum(axis=-1, keepdims=True))(np.exp(x - x.max(axis=-1, keepdims=True))),
}
_sig = ACTIVATIONS["sigmoid"]


def dense(x, w, b, activation="linear"):
    return ACTIVATIONS[activation](x @ w + b)


def rnn(x, wx, wh, b, activation="tanh"):
    h, out = np.zeros(wh.shape[0]), []
    for row in x @ wx + b:
        h = ACTIVATIONS[activation](row + h @ wh)
        out.append(h)
    return np.array(out).reshape(len(x), -1)


def lstm(x, wx, wh, b):
    """Gates in the order input, forget, output, cell."""
    n = wh.shape[0]
    h = c = np.zeros(n)
    out = []
    for row in x @ wx + b:
        g = row + h @ wh
        i, f, o = _sig(g[:n]), _sig(g[n : 2 * n]), _sig(g[2 * n : 3 * n])
        c = f * c + i * np.tanh(g[3 * n :])
        h = o * np.tanh(c)
        out.append(h)
    return np.array(out).reshape(len(x), -1)


def gru(x, wx, wh, b):
    """Gates in the order update, reset, candidate."""
    n = wh.shape[0]
    h, out = np.zeros(n), []
    for row in x @ wx + b:
        z, r = _sig(row[:n] + h @ wh[:, :n]), _sig(row[n : 2 * n] + h @ wh[:, n : 2 * n])
        h = z * h + (1 - z) * np.tanh(row[2 * n :] + (r * h) @ wh[:, 2 * n :])
        out.append(h)
    return np.array(out).reshape(len(x), -1)


def bidirectional(layer, x, ahead, back):
    return np.concatenate((layer(x, *ahead), layer(x[::-1], *back)[::-1]), axis=1)


def conv2d(x, kernels, bias=0.0, activation="linear", stride=1):
    """x (channel, row, column), kernels (out, in, row, column); no padding."""
    w = np.lib.stride_tricks.sliding_window_view(x, kernels.shape[2:], axis=(1, 2))[:, ::stride, ::stride]
    return ACTIVATIONS[activation](np.einsum("crsij,ocij->ors", w, kernels) + np.reshape(bias, (-1, 1, 1)))


def conv1d(x, kernel, same=False):
    out = np.correlate(np.pad(x, (len(kernel) // 2, len(kernel) - 1 - len(kernel) // 2)) if same else x, kernel, "valid")
    return out


def batch_norm(x, mean, var, gamma=1.0, beta=0.0, eps=1e-5):
    return (x - mean) / np.sqrt(var + eps) * gamma + beta


def max_pool(x, size):
    r, c = x.shape[-2] // size * size, x.shape[-1] // size * size
    return x[..., :r, :c].reshape(*x.shape[:-2], r // size, size, c // size, size).max(axis=(-3, -1))


def pad2d(x, size):
    return np.pad(x, ((0, 0),) * (x.ndim - 2) + ((size, size),) * 2)


def combine(outputs, strategy="mean"):
    return {"mean": np.mean, "median": np.median, "max": np.max}[strategy](np.stack(outputs), axis=0)


def ensemble(models, x, strategy="mean"):
    """(combined, each model's own output)."""
    own = [m(x) for m in models]
    return combine(own, strategy), own


def chunked(function, x, size, hop, merge="average"):
    """A function over overlapping chunks of rows, which begin at every multiple of `hop`; what fits one chunk is given whole.

    Each chunk's output is joined to what is there already: it begins `size - hop` rows before
    the end of that, and these rows are averaged with it, crossfaded linearly (overlap) or maximised
    (max). A chunk behind one that the end has cut short is therefore put before its own rows.
    """
    n = len(x)
    if n <= size:
        return function(x)
    made = np.zeros((0,))
    end = 0
    for start in range(0, n, hop):
        y = np.asarray(function(x[start : start + size]), float)
        if start == 0:
            made = np.zeros((n, *y.shape[1:]))
            made[: len(y)] = y
            end = len(y)
            continue
        at = end - (size - hop)
        both = min(size - hop, end, len(y))
        here, new = made[at : at + both], y[:both]
        if merge == "max":
            made[at : at + both] = np.maximum(here, new)
        else:
            share = (np.arange(both) / max(both, 1)).reshape(-1, *(1,) * (y.ndim - 1)) if merge == "overlap" else 0.5
            made[at : at + both] = (1 - share) * here + share * new
        room = max(min(len(y) - both, n - at - both), 0)
        made[at + both : at + both + room] = y[both : both + room]
        end = at + len(y)
    return made
