"""Normal and chi-square tails as column expressions, so test p-values stay inside the JVM.

Rational approximation of the normal tail by Hart in the form published by West (2005),
"Better approximations to cumulative normal functions"; absolute error about 1e-15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published approximation (numerator, denominator, split point, sqrt(2 pi)).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
               296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631


def _horner(z: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for value in coefficients[1:]:
        out = out * z + F.lit(value)
    return out


def normal_tail(x: Column) -> Column:
    """P(Z > |x|)."""
    z = F.abs(x)
    density = F.exp(-z * z / 2)
    near = density * _horner(z, NUMERATOR) / _horner(z, DENOMINATOR)
    far = density / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / ROOT_TWO_PI
    return F.when(z > 37, F.lit(0.0)).when(z < SPLIT, near).otherwise(far)


def normal_cdf(x: Column) -> Column:
    return F.when(x > 0, 1 - normal_tail(x)).otherwise(normal_tail(x))


def chi2_tail_1(h: Column) -> Column:
    """Upper tail of the chi-square law with one degree of freedom."""
    tail = F.least(F.lit(1.0), 2 * normal_tail(F.sqrt(F.greatest(h, F.lit(0.0)))))
    return F.when(h.isNotNull(), tail)


def _horner_sql(z: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for value in coefficients[1:]:
        out = f"({out} * {z} + {value!r})"
    return out


def normal_tail_sql(x: str) -> str:
    z = f"abs({x})"
    density = f"exp(-{z} * {z} / 2)"
    near = f"{density} * {_horner_sql(z, NUMERATOR)} / {_horner_sql(z, DENOMINATOR)}"
    far = f"{density} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / {ROOT_TWO_PI}"
    return f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < {SPLIT!r} THEN {near} ELSE {far} END)"
