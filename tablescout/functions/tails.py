"""Tail probabilities of test statistics as Spark expressions.

Continued fractions and series of a fixed number of terms run in ``aggregate``, so a p-value
stays an expression of its row. Beyond the sizes that these terms reach, expansions for large
degrees of freedom take over; both agree to better than 1e-9 where they meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 400
LARGE_SHAPE = 4000.0  # from here the gamma tail is expanded; fractions below converge in TERMS
LARGE_DOF = 2000.0  # from here Student's t is carried to the normal distribution
TINY = 1e-300


def _let(body: Callable, **values: Column) -> Column:
    """``body`` of the values, each of which is evaluated, and planned, once."""
    names = list(values)
    held = F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()]))
    return F.get(F.transform(held, lambda s: body(*[s[k] for k in names])), F.lit(0))


def _safe(x: Column) -> Column:
    """``x``, or a tiny number in place of zero, to divide by."""
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, numerator: Callable, denominator: Callable, terms: int) -> Column:
    """1 / (first + n1 / (d1 + n2 / (d2 + ...))) by its convergents' ratios."""
    d = 1.0 / _safe(first)
    start = F.struct(F.lit(1 / TINY).alias("c"), d.alias("d"), d.alias("h"))

    def step(s, i):
        n, b = numerator(i), denominator(i)
        d = 1.0 / _safe(n * s["d"] + b)
        c = _safe(b + n / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    places = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda i: i.cast("double"))
    return F.aggregate(places, start, step, lambda s: s["h"])


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series from 8 on."""
    return _let(_log_gamma, x=x, y=x + 8.0)


def _log_gamma(x: Column, y: Column) -> Column:
    shifted = F.lit(1.0)
    for k in range(8):
        shifted = shifted * (x + float(k))
    # Bernoulli numbers over 2k (2k - 1).
    series = F.lit(0.0)
    for k, b in enumerate([1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]):
        series = series + b / F.pow(y, F.lit(2.0 * k + 1))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shifted)


def _small_gamma_q(a: Column, x: Column, front: Column) -> Column:
    places = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda i: i.cast("double"))
    first = 1.0 / a
    series = F.aggregate(
        places,
        F.struct(first.alias("t"), first.alias("s")),
        lambda s, i: F.struct(
            (s["t"] * x / (a + i)).alias("t"), (s["s"] + s["t"] * x / (a + i)).alias("s")
        ),
        lambda s: s["s"],
    )
    fraction = _fraction(
        x + 1.0 - a, lambda i: i * (a - i), lambda i: x + 1.0 - a + 2.0 * i, TERMS
    )
    return F.when(x < a + 1.0, 1.0 - front * series).otherwise(front * fraction)


def _large_gamma_q(a: Column, x: Column) -> Column:
    """Expansion that holds evenly around ``x = a``: a normal tail and a small correction."""

    def deviation(m):
        # eta^2 / 2 = m - ln(1 + m); for small m by its series, where the difference loses digits.
        near = F.lit(0.0)
        for k in range(14, 1, -1):
            near = near * m + (1.0 if k % 2 == 0 else -1.0) / k
        half = F.when(F.abs(m) < 0.05, near * m * m).otherwise(m - F.ln(1.0 + m))
        return _let(lambda half: expanded(m, half, F.signum(m) * F.sqrt(2.0 * half)), half=half)

    def expanded(m, half, eta):
        return _let(lambda eta: corrected(m, half, eta), eta=eta)

    def corrected(m, half, eta):
        c0 = F.when(
            F.abs(eta) < 0.05,
            -1 / 3 + eta * (1 / 12 + eta * (-2 / 135 + eta * (1 / 864 + eta * (1 / 2835)))),
        ).otherwise(1.0 / _safe(m) - 1.0 / _safe(eta))
        c1 = F.when(F.abs(eta) < 0.3, -1 / 540 + eta * (-1 / 288 + eta * (25 / 12096))).otherwise(
            1.0 / F.pow(_safe(eta), F.lit(3.0))
            - 1.0 / F.pow(_safe(m), F.lit(3.0))
            - 1.0 / F.pow(_safe(m), F.lit(2.0))
            - 1.0 / (12.0 * _safe(m))
        )
        tail = normal_two_sided(eta * F.sqrt(a)) / 2.0
        upper = _let(lambda tail: F.when(eta >= 0, tail).otherwise(1.0 - tail), tail=tail)
        return upper + F.exp(-a * half) / F.sqrt(2 * math.pi * a) * (c0 + c1 / a)

    return _let(deviation, m=x / a - 1.0)


def gamma_q(a: Column, x: Column) -> Column:
    """Upper share of the gamma distribution of shape ``a`` beyond ``x``; 1 at zero or below."""

    def share(a, x):
        q = F.when(a < LARGE_SHAPE, _gamma_q(a, x)).otherwise(_large_gamma_q(a, x))
        return F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))

    return _let(share, a=a, x=x)


def _gamma_q(a: Column, x: Column) -> Column:
    return _let(_small_gamma_q, a=a, x=x, front=F.exp(a * F.ln(x) - x - log_gamma(a)))


def normal_two_sided(z: Column) -> Column:
    """Share of the standard normal distribution further from zero than ``z``."""
    return _let(lambda x: F.when(x == 0, 1.0).otherwise(_gamma_q(F.lit(0.5), x)), x=z * z / 2.0)


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """P-value of a chi-square statistic; missing without degrees of freedom."""
    p = gamma_q(dof.cast("double") / 2.0, statistic.cast("double") / 2.0)
    return F.when((dof > 0) & statistic.isNotNull(), p)


def student_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; missing without degrees of freedom."""

    def fraction(a, b, x):
        def numerator(i):
            m = F.floor(i / 2.0).cast("double")
            even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
            return F.when(i % 2.0 == 0, even).otherwise(odd)

        return _fraction(F.lit(1.0), numerator, lambda i: F.lit(1.0), TERMS)

    def small(a, x, rest):
        b = F.lit(0.5)
        logs = log_gamma(a + 0.5) - log_gamma(a) - log_gamma(b) + a * F.ln(x)
        return _let(
            lambda front: F.when(x < (a + 1.0) / (a + 2.5), front * fraction(a, b, x) / a).otherwise(
                1.0 - front * fraction(b, a, rest) / b
            ),
            front=F.exp(logs) * F.sqrt(rest),
        )

    def large(c, w2):
        # The normal deviate of the same tail, to terms of 1 / n^2.
        d = 48.0 * c * c
        w = F.sqrt(w2)
        last = 4.0 * w2 * w2 * w2 + 33.0 * w2 * w2 + 240.0 * w2 + 855.0
        z = w + (w2 * w + 3.0 * w) / d - w * last / (10.0 * d * (d + 0.8 * w2 * w2 + 100.0))
        return normal_two_sided(z)

    def share(t, n):
        square = t * t
        p = F.when(
            n < LARGE_DOF, _let(small, a=n / 2.0, x=n / (n + square), rest=square / (n + square))
        ).otherwise(_let(large, c=n - 0.5, w2=(n - 0.5) * F.log1p(square / n)))
        p = F.when(t == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
        return F.when((n > 0) & t.isNotNull(), p)

    return _let(share, t=t, n=dof)


def kolmogorov_p(distance: Column, first: Column, second: Column) -> Column:
    """P-value of the two-sample distance for samples of the given sizes (limit distribution,
    with the usual correction for small samples); missing for an empty sample."""
    size = F.try_divide(first.cast("double") * second, first.cast("double") + second)
    root = F.sqrt(size)

    def share(z):
        terms = F.sequence(F.lit(1), F.lit(100))
        far = F.aggregate(
            terms,
            F.lit(0.0),
            lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * z * z),
        )
        near = 1.0 - math.sqrt(2 * math.pi) / _safe(z) * F.aggregate(
            terms,
            F.lit(0.0),
            lambda s, j: s + F.exp(-F.pow(2.0 * j - 1.0, F.lit(2.0)) * (math.pi**2 / 8) / _safe(z * z)),
        )
        p = F.when(z < 0.04, 1.0).when(z < 1.0, near).otherwise(far)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    known = (first > 0) & (second > 0) & distance.isNotNull()
    return F.when(known, _let(share, z=(root + 0.12 + F.try_divide(F.lit(0.11), root)) * distance))
