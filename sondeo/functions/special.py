"""Special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of Stirling's series: B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: Arguments are raised to at least this before the series is used.
RAISED = 10


def log_gamma(a: Column) -> Column:
    """The logarithm of the gamma function of a positive number."""
    z = a + RAISED
    tail = sum((F.lit(c) / F.pow(z, 2 * k + 1) for k, c in enumerate(STIRLING)), F.lit(0.0))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(0.0), lambda s, i: s + F.ln(a + i))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail - down


def gamma_q(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for positive a: from the series
    of P where x < a + 1, else from the continued fraction.  The number of terms follows
    the root of a, as their convergence does.  1 for x = 0, null for a negative x."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(-x + a * F.ln(x) - log_gamma(a))
    steps = F.sequence(F.lit(1), F.ceil(60 + 12 * F.sqrt(a)).cast("int"))
    pair = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    series = F.aggregate(steps, pair, lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")), lambda s: s["total"])
    # Lentz's rule; b grows by 2 a step, so no denominator is 0 where x >= a + 1
    b0 = x + 1 - a
    begin = F.struct((1 / b0).alias("d"), F.lit(1e300).alias("c"), (1 / b0).alias("h"))

    def lentz(s, n):
        an, b = -n * (n - a), b0 + 2 * n
        d, c = 1 / (an * s["d"] + b), b + an / s["c"]
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(steps, begin, lentz, lambda s: s["h"])
    return F.when(x == 0, 1.0).when((x > 0) & (x < a + 1), 1 - front * series).when(x > 0, front * fraction)


def chi_square_p(chi2: Column, df: Column) -> Column:
    """The chance of a chi-square of at least ``chi2`` with ``df`` degrees of freedom; null
    without a degree."""
    return F.when(df > 0, gamma_q(df / 2, chi2 / 2))
