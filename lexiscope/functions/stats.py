"""Scalar statistics as column arithmetic; undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963985


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, within 0 and 1."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.try_divide(tp * tn - fp * fn, den)


def kappa2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table (a: both true, d: both false); null where chance agreement is 1."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    po = F.try_divide(a + d, n)
    pe = F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n * n)
    return F.try_divide(po - pe, 1 - pe)


def ac1(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Gwet's AC1 of a 2 x 2 table."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    q = F.try_divide((a + b) + (a + c), 2 * n)
    pe = 2 * q * (1 - q)
    return F.try_divide(F.try_divide(a + d, n) - pe, 1 - pe)


def finite_sample(n: float, population: Column, limit: int = 5000) -> Column:
    """Sample size with finite-population correction below ``limit`` rows."""
    corrected = F.ceil(F.lit(n) / (1 + (F.lit(n) - 1) / population))
    return F.when(population < limit, F.least(corrected, population)).otherwise(F.least(F.lit(int(n)).cast("bigint"), population))


def kappa_band(k: Column) -> Column:
    return (
        F.when(k < 0, "poor").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").when(k.isNotNull(), "almost perfect")
    )
