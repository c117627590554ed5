"""Savitzky-Golay weights by least squares (NumPy)."""

from __future__ import annotations

import numpy as np

#: difference stencils of order 0 to 3: (offsets of value, weights)
STENCILS = {0: ([0], [1.0]), 1: ([1, -1], [0.5, -0.5]), 2: ([2, 0, -2], [0.25, -0.5, 0.25]), 3: ([3, 1, -1, -3], [0.125, -0.375, 0.375, -0.125])}


def order(m: int, fc: float, fs: float) -> int:
    """Polynomial degree that puts the cutoff of a window of 2m + 1 samples at fc."""
    return round(fc / (fs / 2) * (3.2 * m - 4.6) - 1)


def weights(m: int, degree: int, derivative: int = 0) -> np.ndarray:
    """Weights for lags -m..m: sum of w[lag] * x[t + lag] is the smoothed derivative, per sample.

    The smoothing kernel is the least-squares fit of a polynomial to an impulse;
    derivatives fit the difference stencil instead.
    """
    t = np.arange(-m, m + 1) / max(m, 1)
    target = np.zeros(2 * m + 1)
    for at, w in zip(*STENCILS[derivative]):
        target[m + at] += w
    basis, _ = np.linalg.qr(np.vander(t, degree + 1, increasing=True))
    return basis @ (basis.T @ target)
