"""Variational log-Gaussian Cox process regression on a grid of any rank (NumPy).

The log rate is z0 + F'u with u over R retained frequencies of an orthonormal
real basis, prior precision 1 / spectrum; visits n and counts k enter on visited
bins only.  Newton steps for the mean alternate with a fixed point for the
marginal variances, and the evidence lower bound scores the fit.

The R x bins basis is never formed.  Its products with vectors are transforms of the
grid; for functions cos - sin of two frequencies the product is
cos(difference) - sin(sum), so F diag(w) F' is read from one transform of w at the R x R
differences and sums of frequencies, and the variance of every bin under a covariance
of u is two transforms of that covariance added up by difference and by sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

LIMIT = 1000
#: with more frequencies than this, Newton steps come from conjugate gradients
KRYLOV = 300
#: least move of mean or variance for which a fit goes on; Newton steps need one or two more for it than for 1e-5
TOL = 1e-8


def sexp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x, -10, 10))


def basis(kept: np.ndarray, visited: np.ndarray | None = None) -> np.ndarray:
    """R x M real functions (cos - sin of the phase, over the root of the size) at visited bins, all bins if None: for
    small grids and for checks; fits use `Waves`."""
    at = np.argwhere(np.ones(kept.shape, bool) if visited is None else visited)
    return Waves(kept).at(at)


class Waves:
    """The retained real functions of a grid, applied by transforms of the grid."""

    def __init__(self, kept: np.ndarray) -> None:
        self.kept, self.shape, self.size = kept, kept.shape, kept.size
        self.places = np.flatnonzero(kept)

    def __len__(self) -> int:
        return len(self.places)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat grid indices of the difference and of the sum of every two frequencies (R x R each)."""
        less, more = np.zeros((2, len(self), len(self)), np.int32)
        for f, s in zip(np.unravel_index(self.places, self.shape), self.shape):
            f = f.astype(np.int32)
            less = less * np.int32(s) + (f[:, None] - f) % s
            more = more * np.int32(s) + (f[:, None] + f) % s
        return less, more

    def field(self, u: np.ndarray) -> np.ndarray:
        """F'u on the grid; u may have leading axes."""
        x = np.zeros((*u.shape[:-1], self.size))
        x[..., self.places] = u
        f = np.fft.fftn(x.reshape(*u.shape[:-1], *self.shape), axes=tuple(range(-len(self.shape), 0)))
        return (f.real + f.imag) / np.sqrt(self.size)

    def weights(self, x: np.ndarray) -> np.ndarray:
        """F x of a field on the grid."""
        f = np.fft.fftn(x).ravel()[self.places]
        return (f.real + f.imag) / np.sqrt(self.size)

    def gram(self, w: np.ndarray) -> np.ndarray:
        """F diag(w) F' of a field of weights."""
        f = np.fft.fftn(w).ravel()
        less, more = self.pairs
        return (f.real[less] + f.imag[more]) / self.size

    def variance(self, covariance: np.ndarray) -> np.ndarray:
        """Diagonal of F' covariance F on the grid."""
        less, more = self.pairs
        at = lambda i: np.fft.fftn(np.bincount(i.ravel(), covariance.ravel(), self.size).reshape(self.shape))
        return (at(less).real + at(more).imag) / self.size

    def at(self, bins: np.ndarray) -> np.ndarray:
        """R x P values at bins (P rows of coordinates, which may lie between bins: there frequencies above half the band
        count as negative)."""
        freq = np.stack([np.fft.fftfreq(s)[f] for f, s in zip(np.unravel_index(self.places, self.shape), self.shape)], axis=1)
        phase = 2 * np.pi * (freq @ np.asarray(bins, dtype=float).T)
        return (np.cos(phase) - np.sin(phase)) / np.sqrt(self.size)


@dataclass
class Fit:
    """u: frequency weights; z: log rate less the prior mean and v its variance (visited bins); elbo; factor C with C'C the
    posterior covariance of u; precision of the prior."""

    u: np.ndarray
    z: np.ndarray
    v: np.ndarray
    elbo: float
    factor: np.ndarray
    kept: np.ndarray
    spectrum: np.ndarray
    visited: np.ndarray
    mean: np.ndarray
    rounds: int = 0
    trace: list[float] = field(default_factory=list)
    steps: int = 0

    @cached_property
    def waves(self) -> Waves:
        return Waves(self.kept)

    def log_rate(self) -> np.ndarray:
        return self.mean + self.waves.field(self.u)

    def variance(self) -> np.ndarray:
        return self.waves.variance(self.factor.T @ self.factor)

    def rate(self) -> np.ndarray:
        return sexp(self.log_rate() + 0.5 * self.variance())

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Log rate less the prior mean, and its variance, on the grid: what another fit of the map can start from."""
        return self.waves.field(self.u), self.variance()

    def samples(self, count: int, seed: int) -> np.ndarray:
        """count x shape draws of the log rate less the prior mean."""
        noise = np.random.default_rng(seed).standard_normal((count, len(self.u)))
        return self.waves.field(self.u + noise @ self.factor)


def alternate(u: np.ndarray, v: np.ndarray, mean_update: Callable, variance_update: Callable, rounds: int = 10, steps: int = 10, variance_steps: int = 1, tol: float = 1e-5, damping: float = 1.0, after: Callable | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Alternate mean_update(u, v) and variance_update(u, v), which return what to add to u and to v, until neither moves by
    `tol`; returns u, v and the rounds and mean steps made.  `after`: called with u and v at the end of each round."""
    made = done = 0
    for done in range(1, rounds + 1):
        old = u
        for _ in range(steps):
            du = mean_update(u, v)
            u, made = u + du, made + 1
            if np.abs(du).max(initial=0.0) < tol:
                break
        for _ in range(variance_steps):
            dv = variance_update(u, v)
            v = v + damping * dv
            if np.abs(dv).max(initial=0.0) < tol:
                break
        if after is not None:
            after(u, v)
        if max(np.abs(u - old).max(initial=0.0), np.abs(dv).max(initial=0.0)) < tol:
            break
    return u, v, done, made


def conjugate_gradients(times: Callable, b: np.ndarray, diagonal: np.ndarray, tol: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """x with times(x) = b for a symmetric positive definite operator, preconditioned by a diagonal."""
    x, r = np.zeros_like(b), b.copy()
    y = r / diagonal
    p, ry = y.copy(), r @ y
    goal = tol**2 * ry
    for _ in range(rounds):
        if ry <= goal or ry <= 0:
            break
        q = times(p)
        step = ry / (p @ q)
        x += step * p
        r -= step * q
        y = r / diagonal
        new = r @ y
        p, ry = y + p * (new / ry), new
    return x


class Problem:
    """One map's data and prior: the terms from which mean and variance updates are made.  Fields are on the whole grid, with
    no visits and no counts where there are none."""

    def __init__(self, spectrum: np.ndarray, n: np.ndarray, k: np.ndarray, mean: np.ndarray | float, dispersion: float = 1.0) -> None:
        self.waves, self.seen = Waves(spectrum > 0), n > 0
        self.mean = np.broadcast_to(np.asarray(mean, dtype=float), n.shape)
        self.prior = np.maximum(spectrum[spectrum > 0], 1e-12)
        self.precision = 1 / self.prior
        self.visits, self.counts = np.where(self.seen, n, 0) / dispersion, np.where(self.seen, k, 0) / dispersion

    def intensity(self, z: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Expected counts for a log rate less the prior mean z with variance v."""
        return self.visits * sexp(z + self.mean + 0.5 * v)

    def loss(self, u: np.ndarray, z: np.ndarray, v: np.ndarray) -> float:
        return float((self.intensity(z, v) - self.counts * (z + self.mean))[self.seen].sum() + 0.5 * (u * u * self.precision).sum())

    def newton(self, method: str | None = None) -> Callable:
        """Mean update: a Newton step, halved while the loss grows.  method "direct": by the R x R Hessian; "krylov": by
        conjugate gradients on transforms; None: by the number of frequencies."""
        krylov = method == "krylov" if method else len(self.waves) > KRYLOV

        def update(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            z = self.waves.field(u)
            lam = self.intensity(z, v)
            gradient = self.precision * u + self.waves.weights(lam - self.counts)
            if krylov:
                times = lambda x: self.precision * x + self.waves.weights(lam * self.waves.field(x))
                step = conjugate_gradients(times, gradient, self.precision + lam.sum() / lam.size)
            else:
                step = np.linalg.solve(self.hessian(lam), gradient)
            dz, before, size = self.waves.field(step), self.loss(u, z, v), 1.0
            before += 1e-12 * abs(before)  # near the optimum losses differ by rounding only
            while size > 1e-4 and self.loss(u - size * step, z - size * dz, v) > before:
                size /= 2
            return -size * step

        return update

    def hessian(self, lam: np.ndarray) -> np.ndarray:
        h = self.waves.gram(lam)
        h[np.diag_indices(len(h))] += self.precision
        return h

    def factor(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """C with C'C the posterior covariance of u."""
        return np.linalg.inv(np.linalg.cholesky(self.hessian(self.intensity(self.waves.field(u), v))))

    def elbo(self, u: np.ndarray, v: np.ndarray, factor: np.ndarray) -> float:
        """Minus the expected negative log likelihood and the divergence from the prior (up to a constant of the data)."""
        z = self.waves.field(u)
        likelihood = (self.intensity(z, v) - self.counts * (z + self.mean))[self.seen].sum()
        trace = ((factor**2).sum(axis=0) / self.prior).sum()
        divergence = 0.5 * (np.log(self.prior).sum() - len(u) + (u * u / self.prior).sum() + trace) - np.log(np.diag(factor)).sum()
        return float(-(likelihood + divergence))


def fit(
    spectrum: np.ndarray, n: np.ndarray, k: np.ndarray, mean: np.ndarray | float = 0.0, rounds: int = 10, steps: int = 10, tol: float = TOL, dispersion: float = 1.0, variance: str = "exact",
    start: np.ndarray | tuple[np.ndarray, np.ndarray] | None = None, method: str | None = None, mean_update: Callable | None = None, variance_update: Callable | None = None, damping: float = 1.0,
) -> Fit:
    """Fit counts k under visits n; variance 'compat' uses C C' in place of the covariance C'C.

    `start`: frequency weights, or another fit's `state()`.  mean_update(problem) and variance_update(problem) may give
    updates of one's own for `alternate`, in place of Newton steps (by `method`) and the fixed point."""
    kept = spectrum > 0
    if kept.sum() > LIMIT:
        raise ValueError(f"{int(kept.sum())} frequencies are kept, more than {LIMIT}")
    problem = Problem(spectrum, n, k, mean, dispersion)
    u, v = np.zeros(len(problem.waves)), np.zeros(n.shape)
    if isinstance(start, tuple):
        u, v = problem.waves.weights(start[0].reshape(n.shape)), np.where(problem.seen, start[1].reshape(n.shape), 0.0)
    elif start is not None:
        u = start.copy()
    trace: list[float] = []
    last: list[np.ndarray] = [np.diag(np.sqrt(problem.prior))]

    def fixed_point(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        c = problem.factor(u, v)
        last[0] = c
        return np.where(problem.seen, problem.waves.variance(c.T @ c if variance == "exact" else c @ c.T) - v, 0.0)

    def scored(u: np.ndarray, v: np.ndarray) -> None:
        trace.append(problem.elbo(u, v, last[0]))

    if variance_update is not None:
        own = variance_update(problem)

        def own_update(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            last[0] = problem.factor(u, v)
            return own(u, v)

    u, v, done, made = alternate(
        u, v, (mean_update or (lambda p: p.newton(method)))(problem), fixed_point if variance_update is None else own_update, rounds, steps, tol=tol, damping=damping, after=scored
    )
    return Fit(u, problem.waves.field(u)[problem.seen], v[problem.seen], trace[-1], last[0], kept, spectrum, problem.seen, np.array(problem.mean), done, trace, made)


def heuristics(n: np.ndarray, k: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """Period (bins), prior variance, orientation and prior mean log rate from a kernel-density map."""
    from tessera.functions import numerics

    mask = n > 0
    smooth = np.log(np.maximum(numerics.kde(n, k, 2.0), 1e-10))
    p = numerics.period(np.exp(smooth), mask)
    if not np.isfinite(p):
        p = min(n.shape) / 2.0
    p = float(np.clip(p, 3.0, min(n.shape)))
    wide = np.log(np.maximum(numerics.kde(n, k, 5 * p / np.pi), 1e-10))
    near = np.log(np.maximum(numerics.kde(n, k, p / (np.pi * np.sqrt(2))), 1e-10))
    variance = float(np.var((near - wide)[mask])) if mask.any() else 1.0
    return p, max(variance, 1e-3), numerics.orientation(np.exp(near), mask, p), wide


def peak_gradients(result: Fit, peaks: np.ndarray) -> np.ndarray:
    """P x D x R central differences of the retained functions at bins (P rows of coordinates), axis by axis."""
    out = []
    for d in range(peaks.shape[1]):
        step = np.eye(peaks.shape[1], dtype=int)[d]
        out.append((result.waves.at(peaks + step) - result.waves.at(peaks - step)).T / 2)
    return np.stack(out, axis=1)


def peak_hessians(surface: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """P x D x D central second differences of a periodic field of any rank at bins."""
    rank = surface.ndim
    at = lambda move: surface[tuple(((peaks + move) % surface.shape).T)]
    e = np.eye(rank, dtype=int)
    out = np.zeros((len(peaks), rank, rank))
    for a in range(rank):
        for b in range(rank):
            if a == b:
                out[:, a, a] = at(e[a]) - 2 * at(0 * e[a]) + at(-e[a])
            else:
                out[:, a, b] = (at(e[a] + e[b]) + at(-e[a] - e[b]) - at(e[a] - e[b]) - at(e[b] - e[a])) / 4
    return out


def peak_covariance(result: Fit, iy: int, ix: int) -> tuple[float, float, float]:
    """Laplace covariance (xx, xy, yy, in bins) of a peak's place: H^-1 cov(gradient) H^-1 with the Hessian of the log rate."""
    at = np.array([[iy, ix]])
    j = peak_gradients(result, at)[0] @ result.factor.T
    inverse = np.linalg.pinv(-peak_hessians(result.log_rate(), at)[0])
    s = inverse @ j @ j.T @ inverse.T
    return float(s[1, 1]), float(s[0, 1]), float(s[0, 0])


def hill_climb(shape: tuple[int, ...], evaluate, start: tuple[int, ...] | None = None, carry: bool = False) -> tuple[tuple[int, ...], dict]:
    """Best index found by a climb from the middle, every point evaluated once: from a point that is the best so far the
    climb first goes on in the direction it came from, then tries the other axis directions while it stays the best.

    `carry`: evaluate(index, state) gets the state of the point that the climb comes from (None at first) and returns a
    score and its own state; states are kept while the climb may still go on from their point."""
    seen: dict[tuple[int, ...], float] = {}
    best: list = [None]
    ways = [tuple(step if d == axis else 0 for d in range(len(shape))) for axis in range(len(shape)) for step in (-1, 1)]
    todo = [(tuple(start or (s // 2 for s in shape)), None, False, None)]
    while todo:  # a stack of (point, direction, whether the point must still be the best to go there, state to start from)
        at, way, returned, state = todo.pop()
        if returned:  # the point has been left in one direction; go on with the next while it is the best
            if best[0] == at and way:
                todo.append((at, way[1:], True, state))
                todo.append((tuple(a + w for a, w in zip(at, way[0])), way[0], False, state))
            continue
        if at in seen or not all(0 <= a < s for a, s in zip(at, shape)):
            continue
        seen[at], state = evaluate(at, state) if carry else (evaluate(at), None)
        if best[0] is None or seen[at] > seen[best[0]]:
            best[0] = at
        order = ([way] if way else []) + [w for w in ways if w != way]
        todo.append((at, order, True, state))
    return best[0], seen
