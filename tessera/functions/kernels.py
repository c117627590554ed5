"""Prior covariance kernels of grid maps and their retained spectra (NumPy)."""

from __future__ import annotations

import numpy as np

from tessera.functions.numerics import J0_ZEROS, convolve, gaussian, j0, offsets


def grid_kernel(
    period: float,
    shape: tuple[int, int],
    style: str = "radial",
    angle: float = 0.0,
    clip: bool = True,
    zero: int = 3,
    window: str = "square",
    blur: bool = True,
    eps: float = 1e-9,
    basis: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (0.0, 1.0)),
    normalise: bool = True,
) -> np.ndarray:
    """Periodic kernel with its peak at bin (0, 0).

    style: radial (J0), grid (three cosines 60 degrees apart), band (one cosine), square (two at right angles) or rbf
    (exp(-r^2/4), never blurred), of the wave number 2 pi / period.  Offsets are turned by +angle, so the waves run along
    x cos(angle) - y sin(angle), then mapped by the inverse of `basis`.  The kernel is tapered by a symmetric Hann window
    about the grid's middle, cut at the zero-th zero of J0 by a square, parzen, triangle or gaussian window, blurred by
    period / (pi sqrt 2), scaled to a peak of one, and its spectrum is kept at eps or above.
    """
    if period < 2:
        raise ValueError("a period below two bins cannot be resolved")
    h, w = shape
    dy, dx = offsets(h, w)
    m = np.linalg.pinv(np.array(basis, dtype=float))
    wave = 2 * np.pi / period
    tx, ty = (dx * np.cos(angle) - dy * np.sin(angle)) * wave, (dx * np.sin(angle) + dy * np.cos(angle)) * wave
    x, y = m[0, 0] * tx + m[0, 1] * ty, m[1, 0] * tx + m[1, 1] * ty
    r = np.hypot(x, y)
    along = lambda turn: np.cos(x * np.cos(turn) - y * np.sin(turn))
    if style == "radial":
        k = j0(r)
    elif style == "grid":
        k = along(0.0) + along(np.pi / 3) + along(-np.pi / 3)
    elif style == "band":
        k = along(0.0)
    elif style == "square":
        k = along(0.0) + along(np.pi / 2)
    elif style == "rbf":
        k, blur = np.exp(-0.25 * r**2), False
    else:
        raise ValueError(f"unknown style {style}")
    k = k * np.outer(np.fft.ifftshift(np.hanning(h)), np.fft.ifftshift(np.hanning(w)))
    if clip:
        edge = J0_ZEROS[zero - 1]
        if window == "square":
            k = k * (r < edge)
        elif window == "gaussian":
            k = k * np.exp(-0.5 * (r * np.sqrt(2) / edge) ** 2)
        elif window in ("parzen", "triangle"):
            disk = (r < (edge / np.sqrt(2) if window == "parzen" else edge)).astype(float)
            taper = disk
            for _ in range(3 if window == "parzen" else 1):
                taper = convolve(taper, disk)
            k = k * taper
        else:
            raise ValueError(f"unknown window {window}")
    if blur:
        k = convolve(k, gaussian(h, w, period / (np.pi * np.sqrt(2))))
    if normalise:
        k = k / k.max()
    return np.fft.ifft2(np.maximum(np.fft.fft2(k).real, eps)).real


def ensure_psd(kernel: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """The kernel of any rank with its spectrum kept at eps or above."""
    return np.fft.ifftn(np.maximum(np.fft.fftn(kernel).real, eps)).real


def block_covariance(kernel: np.ndarray) -> np.ndarray:
    """The covariance between all bins (row-major) of a periodic kernel with its peak at bin 0: block-circulant, for checks on
    small grids."""
    at = np.indices(kernel.shape).reshape(kernel.ndim, -1)
    return kernel[tuple((at[d][:, None] - at[d][None, :]) % s for d, s in enumerate(kernel.shape))]


def spectrum(shape: tuple[int, int], period: float, variance: float, angle: float = 0.0, style: str = "radial", dc: float = 1e3, noise: float = 0.0, least: float = 0.1, kept: np.ndarray | None = None, **options) -> np.ndarray:
    """Spectrum of variance * grid_kernel with dc added at frequency 0; frequencies below `least` of the largest other one
    (or outside `kept`) are zero, and `noise` is added to the others."""
    f = np.fft.fft2(grid_kernel(period, shape, style, angle, **options)).real * variance
    f[0, 0] += dc
    if kept is None:
        other = f.copy()
        other[0, 0] = 0
        kept = f >= least * other.max()
    return np.where(kept, f + noise, 0.0)


def early_spectrum(size: int, period: float, variance: float, zero: int = 3, eps: float = 1e-7, dc: float = 1e3, least: float = 0.1) -> np.ndarray:
    """Spectrum of the earlier radial kernel on a square grid: J0 cut at its zero-th zero, Hann-tapered, blurred by the unit-sum
    kernel exp(-d^2 pi^2 / period^2), eigenvalues at eps or above; dc at frequency 0, and only frequencies above `least` of
    the second-largest value, or whose transpose is, are kept."""
    dy, dx = offsets(size, size)
    r = np.hypot(dx, dy) * 2 * np.pi / period
    hann = np.fft.ifftshift(np.hanning(size))
    k = j0(r) * np.outer(hann, hann) * (r < J0_ZEROS[zero - 1])
    soft = np.exp(-(dx**2 + dy**2) * (np.pi / period) ** 2)
    k = convolve(k, soft / soft.sum())
    f = np.maximum(np.fft.fft2(k / k.max()).real, eps) * variance
    f[0, 0] += dc
    kept = f > np.sort(f, axis=None)[-2] * least
    return np.where(kept | kept.T, f, 0.0)


def banded_spectrum(shape: tuple[int, int], period: float, variance: float, dc: float = 1e3, least: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(spectrum without dc, kept frequencies) of the radial kernel with frequencies at a hundredth of the largest value kept;
    dc counts for what is kept but never reaches the solver."""
    f = np.fft.fft2(grid_kernel(period, shape)).real * variance
    whole = f.copy()
    whole[0, 0] += dc
    other = whole.copy()
    other[0, 0] = 0
    kept = whole >= least * other.max()
    return np.where(kept, f, 0.0), kept


def joint_spectrum(layers: int, space: np.ndarray, keep: int = 1000) -> np.ndarray:
    """Spectrum of heading x space: the tensor product with the heading kernel; values above the quantile that leaves about
    `keep` frequencies are kept."""
    f = np.fft.fft(heading_kernel(layers)).real[:, None, None] * space[None]
    f = 0.5 * (f + np.roll(f[::-1, ::-1, ::-1], (1, 1, 1), (0, 1, 2)))  # a frequency and its mirror image stay together
    share = 100 * (1 - (min(keep, f.size) - 1) / max(f.size - 1, 1))
    return np.where(f > np.percentile(f.ravel()[1:], min(max(share, 0), 100)), f, 0.0)


def heading_kernel(size: int) -> np.ndarray:
    """max(0, cos)^2 over a turn, with a non-negative spectrum."""
    k = np.maximum(np.cos(np.arange(size) * 2 * np.pi / size), 0) ** 2
    return np.fft.ifft(np.maximum(np.fft.fft(k).real, 1e-6)).real


def draw(field_spectrum: np.ndarray, seed: int) -> np.ndarray:
    """A sample of the prior."""
    noise = np.random.default_rng(seed).standard_normal(field_spectrum.shape)
    return np.fft.ifftn(np.fft.fftn(noise) * np.sqrt(np.maximum(field_spectrum, 0))).real
