"""Logistic models over hashed counts, fitted by numpy on the driver from a bounded number of rows."""

from __future__ import annotations

import numpy as np


def fit(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, weight: np.ndarray, dims: int, l2: float, steps: int, rate: float, diffs: list[tuple[np.ndarray, np.ndarray]] = (), fair: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows: rows i hold idx[ptr[i]:ptr[i+1]] with values val.

    y may be any probability.  diffs: (indices, values) of score changes that the penalty fair * change² / count pushes towards 0.
    """
    w, b = np.zeros(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    n = len(y)
    total = weight.sum() or 1.0
    row = np.repeat(np.arange(n), np.diff(ptr))
    d_row = np.repeat(np.arange(len(diffs)), [len(i) for i, _ in diffs]) if diffs else np.zeros(0, int)
    d_idx = np.concatenate([i for i, _ in diffs]) if diffs else np.zeros(0, int)
    d_val = np.concatenate([x for _, x in diffs]) if diffs else np.zeros(0)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[idx] * val, minlength=n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        g = np.bincount(idx, weights=err[row] * val, minlength=dims) + l2 * w
        if diffs:
            change = np.bincount(d_row, weights=w[d_idx] * d_val, minlength=len(diffs))
            g += np.bincount(d_idx, weights=2 * fair / len(diffs) * change[d_row] * d_val, minlength=dims)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, float(b)
