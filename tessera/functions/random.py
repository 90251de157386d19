"""Counter-based random numbers as column expressions: a value depends on seed, table, column, purpose and position, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: object) -> Column:
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def uniform(*parts: object) -> Column:
    """In [0, 1) with 52 bits, from the digest of the parts."""
    return F.conv(F.substring(F.md5(key(*parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform_sql(*parts: str) -> str:
    """The same in DuckDB; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(*parts: object) -> Column:
    """Standard normal by Box and Muller from two counter uniforms, neither of them 0."""
    u = uniform(*parts, "r") + 2.0**-54
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*parts, "a"))


def phi(x: Column) -> Column:
    """Normal distribution function by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)


#: Coefficients of Acklam's approximation of the normal quantile, centre and tail, numerators and denominators.
CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out: Column = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def phi_inverse(p: Column) -> Column:
    """Normal quantile, error below 4e-9; p is kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    q = p - 0.5
    middle = q * _horner(q * q, CENTRE[0]) / _horner(q * q, CENTRE[1])
    side = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(side, TAIL[0]) / _horner(side, TAIL[1])
    return F.when(F.abs(q) <= 0.47575, middle).when(q < 0, tail).otherwise(-tail)
