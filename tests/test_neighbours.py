"""The candidates of a cell, against all distances."""

import numpy as np
import pytest

from tidewave.operators import neighbours
from tidewave.operators.sequence import pairwise


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("m, k", [(1, 5), (4, 5), (70, 5), (700, 5), (1603, 20)])
@pytest.mark.parametrize("odd", [False, True])
def test_candidates_hold_the_nearest(metric, m, k, odd):
    rng = np.random.default_rng(m)
    y = np.round(rng.normal(size=(m, 3)), 1)  # many are equal
    if odd:
        y[: m // 2 : 2] = np.nan
    x, own = y[: min(m, 40)], np.arange(min(m, 40)) + 100
    with np.errstate(invalid="ignore"):
        q, near = neighbours._searcher(y, np.arange(m) + 100, k, metric)(x, own)
        d = np.round(pairwise(x, y, metric), 8)
    for i in range(len(x)):
        want = [j for j in np.lexsort((np.arange(m), d[i])) if j != i][:k]
        got = near[q == i]
        assert i not in got and set(want) <= set(got.tolist()) and len(got) == len(set(got.tolist()))
