"""P-values against closed forms and fine quadrature."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.functions import tails


def simpson(f, low, high, n=200_001):
    x = np.linspace(low, high, n)
    y = f(x)
    return float((x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def chi(x, k):
    """Upper tail: closed forms for 1 and even degrees, quadrature for others."""
    if k == 1:
        return math.erfc(math.sqrt(x / 2))
    if k % 2 == 0 and k < 300:
        logs = [-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1) for i in range(k // 2)]
        return math.fsum(map(math.exp, logs))
    a = k / 2
    top = max(x / 2, a) + 40 * math.sqrt(a) + 100
    return simpson(lambda t: np.exp((a - 1) * np.log(t) - t - math.lgamma(a)), x / 2, top, 2_000_001)


def student(t, n):
    if n == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if n == 2:
        return 1 - t / math.sqrt(2 + t * t)
    # Differences of large logarithms lose digits; their series does not.
    ratio = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) if n < 1000 else (
        math.sqrt(n / 2) * (1 - 1 / (4 * n) + 1 / (32 * n * n) + 5 / (128 * n**3))
    )
    c = ratio / math.sqrt(math.pi)
    low = math.atan(t / math.sqrt(n))
    high = min(math.pi / 2, low + 40 / math.sqrt(n))
    return 2 * c * simpson(lambda a: np.exp((n - 1) * np.log(np.maximum(np.cos(a), 1e-300))), low, high)


def ks(d, n, m):
    e = math.sqrt(n * m / (n + m))
    z = (e + 0.12 + 0.11 / e) * d
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 2000))))


CHI = [(x, k) for k in (1, 2, 3, 7, 24, 57, 298, 3001, 7990, 8010, 40_000) for r in (0.3, 0.9, 0.99, 1.0, 1.02, 1.3, 3) if (x := float(r * k)) < 60_000]
T = [(t, n) for n in (1, 2, 3, 5, 17, 100, 1990, 2010, 50_000, 10**7) for t in (1e-3, 0.4, 1.0, 2.5, 6.0, 15.0)]
KS = [(d, n, m) for n, m in ((5, 9), (100, 70), (10_000, 333)) for d in (0.02, 0.1, 0.2, 0.5, 1.0)]


def values(spark, rows, kind, p):
    return [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(p).collect()]


def test_chi_square(spark):
    got = values(spark, CHI, "x double, k long", tails.chi_square_p(F.col("x"), F.col("k")))
    assert got == pytest.approx([chi(*c) for c in CHI], abs=1e-9)


def test_student(spark):
    got = values(spark, T, "t double, n long", tails.student_two_sided(F.col("t"), F.col("n")))
    assert got == pytest.approx([student(*c) for c in T], abs=1e-9)


def test_kolmogorov(spark):
    got = values(spark, KS, "d double, n long, m long", tails.kolmogorov_p(*map(F.col, "dnm")))
    assert got == pytest.approx([ks(*c) for c in KS], abs=1e-9)


def test_ends(spark):
    rows = [(0.0, 0), (0.0, 5), (1e9, 5), (None, 5)]
    assert values(spark, rows, "x double, k long", tails.chi_square_p(F.col("x"), F.col("k"))) == [None, 1.0, 0.0, None]
    found = values(spark, rows, "x double, k long", tails.student_two_sided(F.col("x"), F.col("k")))
    assert found[:2] == [None, 1.0] and 0 < found[2] < 1e-30 and found[3] is None
    ends = [(0.0, 3, 4), (0.5, 0, 4), (1.0, 10**9, 10**9)]
    assert values(spark, ends, "d double, n long, m long", tails.kolmogorov_p(*map(F.col, "dnm"))) == [1.0, None, 0.0]
