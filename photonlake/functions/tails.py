"""Tails of distributions as Columns: the complementary error function and incomplete gamma functions, by series and continued fractions.

Sums have a fixed number of terms, so that they stay expressions of the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(n: int, start: Column, step, finish=None) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, finish) if finish else F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)


def given(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _erfc_positive(x: Column) -> Column:
    square = x * x
    start = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda s, n: given(s["term"] * 2 * square / (2 * n + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * _fold(60, start, step, lambda s: s["sum"])
    fraction = F.exp(-square) / math.sqrt(math.pi) / _fold(60, x, lambda f, n: x + (61 - n) / 2 / f)
    return F.when(x < 2.5, series).otherwise(fraction)


def erfc(x: Column) -> Column:
    """The complementary error function, to about 14 digits, relative in the upper tail."""
    return given(x, lambda v: F.when(v < 0, 2 - _erfc_positive(-v)).otherwise(_erfc_positive(v)))


def log_gamma(a: Column) -> Column:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from twelve on and the recurrence below."""

    def stirling(x: Column) -> Column:
        y = 1 / (x * x)
        return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x

    small = stirling(a + 12) - F.log(a * (a + 1) * (a + 2) * (a + 3) * (a + 4) * (a + 5)) - F.log((a + 6) * (a + 7) * (a + 8) * (a + 9) * (a + 10) * (a + 11))
    return F.when(a < 12, small).otherwise(stirling(a))


def gamma_tail(a: Column, x: Column, terms: int = 500) -> Column:
    """The regularised upper incomplete gamma function Q(a, x); ``terms`` serve up to an ``a`` of some thousands."""

    def tail(v: Column) -> Column:
        a, x, head = v["a"], v["x"], v["a"] * F.log(v["x"]) - v["x"]
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
        step = lambda s, n: given(s["term"] * x / (a + n), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
        lower = F.exp(head - log_gamma(a)) * _fold(terms, start, step, lambda s: s["sum"])
        fraction = _fold(terms, x + 2 * terms + 1 - a, lambda f, n: x + 2 * (terms + 1 - n) - 1 - a - (terms + 1 - n) * (terms + 1 - n - a) / f)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - lower).otherwise(F.exp(head - log_gamma(a)) / fraction)

    return given(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), tail)


def chi2_tail(ts: Column, df: Column) -> Column:
    """Probability of a chi-square above ``ts`` with ``df`` degrees of freedom."""
    return gamma_tail(df / 2, ts / 2)


def one_sided_p(ts: Column) -> Column:
    """Half the probability of a chi-square of one degree of freedom above ``ts``."""
    return 0.5 * erfc(F.sqrt(F.greatest(ts, F.lit(0.0)) / 2))


def erfc_sql(x: str) -> str:
    """The same from the whole series, good to an absolute 1e-15."""
    y = f"least(abs({x}), 6.5::double)"
    series = f"exp(-{y} * {y}) * list_sum(list_transform(range(130), lambda n: power({y}, 2 * n + 1) / gamma(n + 1.5::double)))"
    return f"(1 - case when {x} < 0 then -1 else 1 end * {series})"


def gamma_tail_sql(a: str, x: str) -> str:
    """The same from the whole series, good to an absolute 1e-12."""
    return f"(case when {x} <= 0 then 1 else 1 - list_sum(list_transform(range(700), lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1)))) end)"
