"""Small NumPy numerics: hulls, Bessel J0, periodic convolution, spectra, profiles and linear Gaussian processes."""

from __future__ import annotations

import numpy as np

#: zeros of the Bessel functions J0 and J1 (fixed values)
J0_ZEROS = [2.404825557695773, 5.520078110286311, 8.653727912911013]
J1_ZEROS = [3.831705970207512, 7.015586669815619]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise from the lowest-leftmost, collinear points left out (monotone chain)."""
    p = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax) > 0:
                    break
                out.pop()
            out.append((q[0], q[1]))
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def j0(x: np.ndarray, nodes: int = 256) -> np.ndarray:
    """Bessel J0 as the mean of cos(x sin t) over [0, pi], midpoint rule."""
    t = (np.arange(nodes) + 0.5) * np.pi / nodes
    return np.cos(np.asarray(x, dtype=float)[..., None] * np.sin(t)).mean(axis=-1)


def offsets(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed periodic offsets (dy, dx) from bin (0, 0)."""
    dy, dx = np.fft.fftfreq(height, 1 / height), np.fft.fftfreq(width, 1 / width)
    return np.meshgrid(dy, dx, indexing="ij")


def gaussian(height: int, width: int, sigma: float | np.ndarray) -> np.ndarray:
    """Peak-one periodic Gaussian at bin (0, 0); sigma: deviation or 2 x 2 covariance of (x, y)."""
    dy, dx = offsets(height, width)
    if np.ndim(sigma) == 0:
        return np.exp(-0.5 * (dx**2 + dy**2) / float(sigma) ** 2)
    v = np.asarray(sigma, dtype=float)
    p = np.linalg.pinv((v + v.T) / 2)
    return np.exp(-0.5 * (p[0, 0] * dx**2 + 2 * p[0, 1] * dx * dy + p[1, 1] * dy**2))


def convolve(field: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution over the last two axes."""
    return np.fft.irfft2(np.fft.rfft2(field) * np.fft.rfft2(kernel), s=field.shape[-2:])


def kde(n: np.ndarray, k: np.ndarray, sigma: float) -> np.ndarray:
    g = gaussian(*n.shape, sigma)
    mean = k.sum() / max(n.sum(), 1e-300)
    return (convolve(k, g) + 0.5 * mean) / (convolve(n, g) + 0.5)


def autocorrelation(field: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of the field less its masked mean, Hann-tapered; zero lag in the middle, peak equal to the masked variance."""
    x = np.where(mask, field - field[mask].mean(), 0.0) * np.hanning(field.shape[0])[:, None] * np.hanning(field.shape[1])
    a = np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(x)) ** 2).real)
    return a * (field[mask].var() / max(a.max(), 1e-300))


def radial_profile(field: np.ndarray) -> np.ndarray:
    h, w = field.shape
    r = np.rint(np.hypot(np.arange(h)[:, None] - h // 2, np.arange(w) - w // 2)).astype(int)
    return np.bincount(r.ravel(), field.ravel()) / np.bincount(r.ravel())


def upsample(profile: np.ndarray, factor: int) -> np.ndarray:
    """Band-limited interpolation of a mirrored profile."""
    both = np.concatenate([profile, profile[::-1]])
    n = len(both)
    spectrum = np.fft.rfft(both)
    return np.fft.irfft(spectrum, n * factor)[: len(profile) * factor] * factor


def first_extreme(profile: np.ndarray, sign: int) -> float:
    """Index of the first strict local maximum (sign 1) or minimum (-1) after 0, a plateau's middle; NaN if none."""
    y, k = sign * np.asarray(profile), 1
    while k < len(y) - 1:
        if y[k] > y[k - 1]:
            e = k
            while e + 1 < len(y) and y[e + 1] == y[k]:
                e += 1
            if e + 1 < len(y) and y[e + 1] < y[k]:
                return (k + e) / 2
            k = e + 1
        else:
            k += 1
    return float("nan")


def period(field: np.ndarray, mask: np.ndarray, factor: int = 8) -> float:
    """Grid period in bins from the radial autocorrelation: the mean of what its first peak and trough imply for a
    J0-shaped profile."""
    a = autocorrelation(field, mask)
    h, w = field.shape
    profile = upsample(radial_profile(a)[: min(h, w) // 2], factor)
    peak, trough = first_extreme(profile, 1) / factor, first_extreme(profile, -1) / factor
    guesses = [v for v in (peak * 2 * np.pi / J1_ZEROS[1], trough * 2 * np.pi / J1_ZEROS[0]) if np.isfinite(v)]
    return float(np.mean(guesses)) if guesses else float("nan")


def orientation(field: np.ndarray, mask: np.ndarray, p: float) -> float:
    """Angle (mod 60 degrees, in radians) for `grid_kernel` of a hexagonal map, whose waves run along minus that angle: the
    sixfold harmonic of the autocorrelation on the first ring points at its peaks, which lie 30 degrees off the waves."""
    a = autocorrelation(field, mask)
    h, w = field.shape
    y, x = np.meshgrid(np.arange(h) - h // 2, np.arange(w) - w // 2, indexing="ij")
    r, phi = np.hypot(x, y), np.arctan2(y, x)
    ring = np.abs(r - p * J1_ZEROS[1] / (2 * np.pi)) <= np.sqrt(2) / 2 + 1e-9
    return float((np.pi / 6 - np.angle((a * ring * np.exp(6j * phi)).sum()) / 6) % (np.pi / 3))


def upsample_2d(field: np.ndarray, factor: int) -> np.ndarray:
    """Band-limited interpolation of a periodic field; frequencies beyond a circle of half the band are dropped."""
    h, w = field.shape
    y, x = (np.arange(h) - (h - 1) / 2) / h, (np.arange(w) - (w - 1) / 2) / w
    f = np.fft.fftshift(np.fft.fft2(field)) * (np.hypot(y[:, None], x) < 0.5)
    wide = np.zeros((h * factor, w * factor), dtype=complex)
    a, b = (h * factor + 1) // 2 - h // 2, (w * factor + 1) // 2 - w // 2
    wide[a : a + h, b : b + w] = f
    return np.fft.ifft2(np.fft.ifftshift(wide)).real * factor**2


def bessel_variance(mean: float, observed: float, rounds: int = 10) -> float:
    """Prior variance whose log-normal map of that mean has a first peak of the autocovariance `observed` above its first
    trough, if the log rate's covariance is J0-shaped; fixed-point rounds from 1."""
    trough, peak = (float(j0(np.array(z))) for z in J1_ZEROS)
    s = 1.0
    for _ in range(rounds):
        low, high = (np.expm1(v * s) * np.exp(2 * (np.log(mean) - s / 2) + s) for v in (trough, peak))
        s *= observed / (high - low)
    return float(s)


def linear_gp(n: np.ndarray, k: np.ndarray, kernel: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Posterior mean rate of a stationary Gaussian process with noise variance y / n per bin: solves
    (S + 1/T) a = y - m by conjugate gradients on visited bins, with S by FFT, and returns m + S a."""
    mean = k.sum() / max(n.sum(), 1e-300)
    seen = n > 0
    y = np.where(seen, k / np.where(seen, n, 1) - mean, 0.0)
    noise = np.where(seen, mean / np.where(seen, n, 1), 0.0)
    spectrum = np.fft.rfft2(kernel)
    times = lambda v: np.fft.irfft2(np.fft.rfft2(v) * spectrum, s=n.shape)
    a, r = np.zeros_like(y), y.copy()
    p, rr = r.copy(), (r * r).sum()
    for _ in range(rounds):
        if rr <= tol**2:
            break
        q = np.where(seen, times(p), 0.0) + noise * p
        step = rr / max((p * q).sum(), 1e-300)
        a += step * p
        r -= step * q
        new = (r * r).sum()
        p, rr = r + p * (new / rr), new
    return mean + times(a)


def wiener_gp(n: np.ndarray, k: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The closed form for even visits: mean + filter k^ mu T / (k^ mu T + 1) of the deviations."""
    mean, visits = k.sum() / max(n.sum(), 1e-300), n.mean()
    y = np.where(n > 0, k / np.where(n > 0, n, 1) - mean, 0.0)
    gain = np.fft.rfft2(kernel).real * visits / max(mean, 1e-300)
    return mean + np.fft.irfft2(np.fft.rfft2(y) * gain / (gain + 1), s=n.shape)
