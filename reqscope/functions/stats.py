"""Test-statistic expressions: Student-t tail, signed-rank null distribution, normal tail.

The t tail and the exact signed-rank distribution are written with
Spark higher-order functions, so they run inside whole-stage codegen. The
normal tail needs ``erfc``, which Spark SQL lacks; it is built from the same
kind of expressions (a positive power series and a continued fraction), so no
Python worker is started for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _series_sum(count: Column, c0: Column, cos2: Column, num_off: int, den_off: int) -> Column:
    """sum_{k<count} c_k with c_{k+1} = c_k * cos2 * (2k+num_off)/(2k+den_off)."""
    init = F.struct(c0.alias("c"), F.lit(0.0).alias("s"))
    seq = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    acc = F.aggregate(
        seq,
        init,
        lambda a, k: F.struct(
            (a["c"] * cos2 * (2 * k + num_off) / (2 * k + den_off)).alias("c"),
            (a["s"] + a["c"]).alias("s"),
        ),
    )
    return acc["s"]


def t_two_sided_p(t, df) -> Column:
    """Two-sided Student-t p-value for integer degrees of freedom (closed form)."""
    t, v = _c(t).cast("double"), _c(df).cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(v.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    cos2 = c * c
    even = s * _series_sum((v / 2).cast("int"), F.lit(1.0), cos2, 1, 2)
    odd = (2.0 / math.pi) * (theta + s * _series_sum(((v - 1) / 2).cast("int"), c, cos2, 2, 3))
    a = F.when(v == 1, 2.0 * theta / math.pi).when(v % 2 == 0, even).otherwise(odd)
    return F.when(v >= 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - a)))


def signed_rank_p(doubled_ranks, doubled_stat) -> Column:
    """Two-sided exact p of the signed-rank statistic: ``min(1, 2 * P(W <= stat))``.

    ``doubled_ranks`` are twice the mid-ranks of the non-zero differences, as
    whole numbers, so that ties need no other rule. The distribution of W under
    random signs is built by one convolution a rank, in probabilities: an array
    of ``m * (m + 1) + 1`` doubles for m ranks.
    """
    r, stat = _c(doubled_ranks), _c(doubled_stat).cast("int")
    top = F.aggregate(r, F.lit(0), lambda a, x: a + x)
    start = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    spread = F.aggregate(
        r, start,
        lambda p, x: F.transform(p, lambda v, i: (v + F.when(i >= x, F.element_at(p, i - x + 1)).otherwise(F.lit(0.0))) / 2.0),
    )
    below = F.aggregate(F.slice(spread, 1, stat + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2.0 * below)


# Switch point between the series and the continued fraction, and their depths.
# At x < 5 the series terms peak near n = x^2 < 25 and are below 1e-17 of the
# sum well before n = 160; at x >= 5 the continued fraction is exact to double
# precision after far fewer than 80 levels.
ERFC_SWITCH = 5.0
ERFC_SERIES_TERMS = 160
ERFC_CF_DEPTH = 80


def erfc(x) -> Column:
    """erfc(x) for x >= 0 as built-in column expressions.

    x < 5: erf(x) = 2/sqrt(pi) e^{-x^2} sum_n 2^n x^{2n+1} / (2n+1)!!, whose
    terms are all positive (no cancellation), and erfc = 1 - erf; the absolute
    error is about 1e-16. x >= 5: Laplace's continued fraction
    erfc(x) = e^{-x^2}/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + (3/2)/(x + ...)))),
    evaluated from the bottom up. Null x gives null. Each branch sees a clamped argument, so
    neither divides by zero nor overflows on the rows of the other branch.
    """
    x = _c(x)
    xs = F.least(x, F.lit(ERFC_SWITCH))
    x2 = xs * xs
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(ERFC_SERIES_TERMS - 1)),
        F.struct(xs.alias("t"), F.lit(0.0).alias("s")),
        lambda a, n: F.struct((a["t"] * 2.0 * x2 / (2 * n + 3)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    low = 1.0 - (2.0 / math.sqrt(math.pi)) * F.exp(-x2) * series
    xc = F.greatest(x, F.lit(ERFC_SWITCH))
    tail = F.aggregate(
        F.sequence(F.lit(ERFC_CF_DEPTH), F.lit(1), F.lit(-1)),
        xc,
        lambda t, k: xc + (k / 2.0) / t,
    )
    high = F.exp(-xc * xc) / math.sqrt(math.pi) / tail
    return F.when(x < ERFC_SWITCH, low).when(x >= ERFC_SWITCH, high)


def normal_two_sided_p(z) -> Column:
    """Two-sided normal tail erfc(|z| / sqrt 2) (L4); null z gives null."""
    return erfc(F.abs(_c(z)) / math.sqrt(2.0))
