"""Matrix exponentials and their integrals (Van Loan, 1978), in numpy."""

from __future__ import annotations

import math

import numpy as np


def expm(a: np.ndarray, terms: int = 18) -> np.ndarray:
    """exp of a matrix or of a stack of matrices, by scaling, Taylor series and squaring."""
    norm = float(np.abs(a).sum(axis=-1).max()) if a.size else 0.0
    s = max(0, math.ceil(math.log2(norm / 0.25))) if norm > 0.25 else 0
    b = a / 2.0**s
    out = np.broadcast_to(np.eye(a.shape[-1]), a.shape).copy()
    term = out.copy()
    for k in range(1, terms + 1):
        term = term @ b / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def integral(q: np.ndarray, c: np.ndarray, t: float) -> np.ndarray:
    """The integral over s from 0 to t of exp(q s) c exp(q (t - s))."""
    n = len(q)
    block = np.zeros((2 * n, 2 * n))
    block[:n, :n] = block[n:, n:] = q * t
    block[:n, n:] = c * t
    return expm(block)[:n, n:]


def generator(rates: np.ndarray) -> np.ndarray:
    """Rates with the diagonal that makes rows sum to zero."""
    q = rates.copy()
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


def log_sum_exp(v: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(v, axis=axis, keepdims=True)
    out = m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))
    return out.squeeze() if axis is None else np.squeeze(out, axis=axis)
