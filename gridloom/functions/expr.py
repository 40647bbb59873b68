"""Column expressions: transforms, floors, scores, filters. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def transform_count(x: Column, mode: str = "log", offset: float = 1.0, scale: float = 1.0, shape: float = 1.0) -> Column:
    """Variance-stabilising count transforms; arguments below 0 count as 0."""
    v = F.greatest(x * scale, F.lit(0.0))
    return {
        "identity": lambda: x * scale,
        "log": lambda: F.log2(v + offset),
        "sqrt": lambda: 2 * F.sqrt(v + offset),
        "anscombe": lambda: 2 * F.sqrt(v + 3.0 / 8.0),
        "asinh": lambda: F.asinh(v / shape),
        "asinhSqrt": lambda: 2 * F.asinh(F.sqrt(v / shape)),
        "generalizedLog": lambda: F.log((v + F.sqrt(v * v + shape * shape)) / 2),
    }[mode]()


def log_ratio(treatment: Column, control: Column, offset: float = 1.0) -> Column:
    return F.log2((treatment + offset) / (control + offset))


def count_floor_log(raw: Column, scale: Column, mass: Column, offset: float = 1.0) -> Column:
    """Delta-method variance of log2(scale * count + offset) for a count with noise mass ``mass``."""
    slope = scale / (math.log(2) * ((raw + 0.5) * scale + offset))
    return slope * slope * (mass + 0.5)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def clip_variance(v: Column, floor: float, cap: float) -> Column:
    return F.least(F.greatest(F.coalesce(F.nanvl(v, F.lit(None)), F.lit(cap)), F.lit(floor)), F.lit(cap))


def keep_read(flag: Column, mapq: Column, tlen: Column, exclude: int = 3844, least_mapq: int = 20, shortest: int = 0, longest: int = 2**31) -> Column:
    return (flag.bitwiseAND(exclude) == 0) & (mapq >= least_mapq) & F.abs(tlen).between(shortest, longest)


def five_prime(flag: Column, start: Column, end: Column, shift: int = 0) -> Column:
    return F.when(flag.bitwiseAND(16) == 0, start + shift).otherwise(end - 1 - shift)


def eb_blend(local: Column, prior: Column, nu_local: float, nu_prior: float, floor: Column, low: float, high: float) -> Column:
    """Precision-weighted blend, clamped, the count floor added, clamped again."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return clamp(clamp((nu_local * local + nu_prior * prior) / (nu_local + nu_prior)) + floor)


def slab_posterior_mean(x: Column, var: Column, null_share: float, slabs: list[tuple[float, float]]) -> Column:
    """Posterior mean of a level under a spike at 0 and normal slabs (weight, variance), by log-sum-exp."""
    logs = [math.log(null_share) - 0.5 * F.log(var) - 0.5 * x * x / var]
    for w, s in slabs:
        logs.append(math.log((1 - null_share) * w) - 0.5 * F.log(var + s) - 0.5 * x * x / (var + s))
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(p - top) for p in logs), F.lit(0.0))
    mean = sum((F.exp(p - top) * x * (s / (var + s)) for p, (_, s) in zip(logs[1:], slabs, strict=True)), F.lit(0.0))
    return mean / total


def autosome(contig: Column) -> Column:
    return contig.rlike(r"^(chr)?([1-9]|1[0-9]|2[0-2])$")


def minus_log10(p: Column) -> Column:
    return F.when(p.isNull() | (p <= 0), F.lit(-1.0)).otherwise(-F.log10(p))
