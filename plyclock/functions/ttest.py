"""Two-sided p-value of a t statistic, as a column expression.

Spark has no Student t distribution.  The tail is the integral of the density, taken by
the trapezoid rule after the substitution ``x = exp(pi/2 sinh u)``, under which tails of
any kind die out fast: one formula, with the same number of steps, for every number of
degrees of freedom.
"""

import math

from pyspark.sql import functions as F

#: Steps a unit and reach of the quadrature; finer or wider changes no digit that is shown.
STEPS, REACH = 64, 5
#: The asymptotic series of the gamma ratio has converged in doubles from here on.
SERIES_FROM = 20


def log_gamma_ratio(a):
    """log(Gamma(a + 1/2) / Gamma(a)) of a column.

    A difference of two log-gammas loses its digits when they are large.  The ratio is
    moved up by steps of one until the asymptotic series serves.
    """
    moved = F.aggregate(
        F.sequence(F.lit(0), F.lit(SERIES_FROM - 1)), F.lit(0.0),
        lambda s, j: s + F.when(a + j < SERIES_FROM, F.log1p(0.5 / (a + j))).otherwise(0.0))
    high = a + F.greatest(F.lit(0.0), F.ceil(SERIES_FROM - a).cast("double"))
    y = 1 / high
    series = y * (-1.0 / 8 + y * y * (1.0 / 192 + y * y * (
        -1.0 / 640 + y * y * (17.0 / 14336 + y * y * (-31.0 / 18432)))))
    return 0.5 * F.log(high) + series - moved


def two_sided_p(t, degrees_of_freedom):
    """Column of P(|T| > |t|); NULL where either is missing or there is no freedom."""
    size, df = F.abs(t.cast("double")), degrees_of_freedom.cast("double")

    def term(i):
        u = i / STEPS
        x = F.exp(math.pi / 2 * F.sinh(u))
        s = size + x
        return x * F.cosh(u) * F.exp(-(df + 1) / 2 * F.log1p(s * s / df))

    reach = STEPS * REACH
    total = F.aggregate(F.sequence(F.lit(-reach), F.lit(reach)), F.lit(0.0), lambda s, i: s + term(i))
    peak = F.exp(log_gamma_ratio(df / 2)) / F.sqrt(math.pi * df)
    return F.when((df > 0) & (size < float("inf")), F.least(F.lit(1.0), math.pi / STEPS * peak * total)) \
        .when((df > 0) & (size == float("inf")), F.lit(0.0))
