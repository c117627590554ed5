"""Column helpers that stay finite: clipped exponentials, guarded logarithms and quotients, log-normal moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, HUGE = 2.0**-63, 2.0**64


def sexp(x: Column) -> Column:
    """exp of x clipped to [-10, 10]."""
    return F.exp(F.least(F.greatest(x, F.lit(-10.0)), F.lit(10.0)))


def slog(x: Column) -> Column:
    """Natural logarithm of x, at least 1e-10."""
    return F.log(F.greatest(x, F.lit(1e-10)))


def sdiv(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a / b; where |b| is below 2**-63, fill for a zero numerator and +-2**64 for another."""
    zero = F.abs(b) < TINY
    return F.when(~zero, a / F.when(zero, F.lit(1.0)).otherwise(b)).when(F.abs(a) < TINY, F.lit(fill)).otherwise(F.signum(a) * HUGE)


def missing(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def null_mask(condition: Column) -> Column:
    """1 where the condition holds, else null."""
    return F.when(condition, F.lit(1.0))


def skip_sum(x: Column) -> Column:
    return F.coalesce(F.sum(missing(x)), F.lit(0.0))


def skip_mean(x: Column, default: float = math.nan) -> Column:
    return F.coalesce(F.avg(missing(x)), F.lit(default))


def normal_pdf(x: Column, mean: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    z = (x - mean) / sigma
    return F.exp(z * z * -0.5) / (sigma * math.sqrt(2 * math.pi))


def decibel(log_rate: Column, fs: float) -> Column:
    return F.log10(F.exp(log_rate) * fs) * 10


def hertz(rate: Column, fs: float) -> Column:
    return rate * fs


def lognormal(mu: Column, v: Column, fs: float = 1.0) -> dict[str, Column]:
    """Mean rate, variance and coefficient of variation of exp of a normal, per sample and in Hz."""
    mean = F.exp(mu + v / 2)
    variance = F.exp(mu * 2 + v) * (F.exp(v) - 1)
    return {
        "mean_rate": mean,
        "variance": variance,
        "cv": F.sqrt(F.exp(v) - 1),
        "mean_hz": mean * fs,
        "variance_hz": variance * fs * fs,
    }


def zscore(x: Column, mean: Column, std: Column, reg: float = 1e-10) -> Column:
    return (x - mean) / (std + reg)


def rescaled(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) clipped to [0, 1]; 0 where low equals high."""
    return F.least(F.greatest(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def heading_weight(angle: Column, phi: Column | float, power: int = 1) -> Column:
    """max(0, cos(angle - phi)) to the power."""
    return F.pow(F.greatest(F.cos(angle - phi), F.lit(0.0)), F.lit(float(power)))


#: Lanczos coefficients for g = 7 (fixed values)
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5 by Lanczos's sum."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return F.log(t) * (z + 0.5) - t + F.log(total) + 0.5 * math.log(2 * math.pi)
