"""Intervals and agreement as columns over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z, empty: tuple[float, float] | None = (0.0, 1.0)) -> tuple[Column, Column]:
    """Bounds of a proportion; for n = 0 those of ``empty``, or null."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)
    none = [F.lit(x).cast("double") for x in (empty or (None, None))]
    return F.when(n == 0, none[0]).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, none[1]).otherwise(F.least(high, F.lit(1.0)))


def mean_interval(x: Column, z: float = Z) -> dict[str, Column]:
    """n, mean and its bounds; one value has no bounds, none has no mean."""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))
    two = n > 1
    return {"n": n, "mean": m, "low": F.when(two, m - z * s), "high": F.when(two, m + z * s)}


def kappa(observed: Column, expected: Column) -> Column:
    """Agreement beyond chance; 1 if chance alone explains everything."""
    return F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))


def bits_a_byte(nats: Column, n_bytes: Column) -> Column:
    return nats / F.lit(0.6931471805599453) / n_bytes
