"""Vectorised special functions and root finders for Arrow UDFs: numpy arrays in, numpy arrays out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x: np.ndarray) -> np.ndarray:
    return _erfc(np.asarray(x, float)).astype(float)


def chi2_sf(ts: np.ndarray, df: np.ndarray | int = 1) -> np.ndarray:
    """Upper tail of chi-square: closed forms, by the recurrence that raises the degrees of freedom by two."""
    ts, df = np.broadcast_arrays(np.asarray(ts, float), np.asarray(df))
    half = np.maximum(ts, 0) / 2
    out = np.where(df % 2 == 1, erfc(np.sqrt(half)), np.exp(-half))
    start = np.where(df % 2 == 1, 1, 2)
    term = np.where(df % 2 == 1, 2 * np.sqrt(half / math.pi) * np.exp(-half), half * np.exp(-half))
    for k in range(int(df.max()) if df.size else 0):
        live = start + 2 * k < df
        if not live.any():
            break
        out = np.where(live, out + term, out)
        term = term * half / (start / 2 + k + 1)
    return out


def one_sided_p(ts: np.ndarray) -> np.ndarray:
    return 0.5 * chi2_sf(ts, 1)


def bisect(f, low: np.ndarray, high: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Root of each element's increasing or decreasing function; NaN where the ends have one sign."""
    low, high = np.array(low, float), np.array(high, float)
    at_low, at_high = f(low), f(high)
    bad = ~(np.sign(at_low) * np.sign(at_high) <= 0)
    for _ in range(rounds):
        mid = (low + high) / 2
        same = np.sign(f(mid)) == np.sign(at_low)
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    return np.where(bad, np.nan, (low + high) / 2)


def _xlogy(x, y):
    return np.where(x > 0, x * np.log(np.maximum(y, 1e-300)), 0.0)


def cash(n, mu):
    mu = np.maximum(mu, 1e-25)
    return 2 * (mu - _xlogy(n, mu))


def wstat(n, off, alpha, mu):
    c = alpha * (n + off) - (1 + alpha) * mu
    d = np.sqrt(np.maximum(c * c + 4 * alpha * (alpha + 1) * off * mu, 0))
    b = np.maximum((c + d) / (2 * alpha * (alpha + 1)), 0)
    fit = mu + (1 + alpha) * b - _xlogy(n, mu + alpha * b) - _xlogy(off, b)
    perfect = n - _xlogy(n, n) + off - _xlogy(off, off)
    return 2 * (fit - perfect)


class CountsFunction:
    """Statistic of a signal given counts: a known background (off is None) or one measured in off regions."""

    def __init__(self, n, background=None, off=None, alpha=None):
        self.n = np.asarray(n, float)
        self.background, self.off, self.alpha = background, off, alpha
        self.excess = self.n - (background if off is None else alpha * off)
        self.error = np.sqrt(self.n if off is None else self.n + alpha**2 * off)

    def stat(self, mu):
        return cash(self.n, self.background + mu) if self.off is None else wstat(self.n, self.off, self.alpha, mu)

    def errors(self, n_sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(errn, errp): distances to where the statistic has risen by n_sigma^2; without a root below, errn is the counts."""
        best = self.stat(self.excess)
        span = 2 * n_sigma * (self.error + 1)
        f = lambda mu: self.stat(mu) - best - n_sigma**2
        floor = -(self.background if self.off is None else np.zeros_like(self.n)) + 0.0
        low = bisect(f, np.maximum(self.excess - span, floor), self.excess)
        high = bisect(f, self.excess, self.excess + span)
        return np.where(np.isnan(low), self.n, self.excess - low), high - self.excess

    def upper_limit(self, n_sigma: float = 3.0) -> np.ndarray:
        """Signal above the best one where the statistic has risen by n_sigma^2 from its value there, at least from no signal."""
        start = np.maximum(self.excess, 0)
        base = self.stat(start)
        return bisect(lambda mu: self.stat(mu) - base - n_sigma**2, start, start + 4 * n_sigma * (self.error + 1) + n_sigma**2)


def matching_excess(background, n_sigma, off=None, alpha=None, rounds: int = 100) -> np.ndarray:
    """Excess whose significance over the background is n_sigma."""
    background = np.asarray(alpha * off if off is not None else background, float)

    def f(excess):
        n = background + excess
        if off is None:
            ts = cash(n, background) - cash(n, n)
        else:
            ts = wstat(n, off, alpha, np.zeros_like(n)) - wstat(n, off, alpha, excess)
        return np.sqrt(np.maximum(ts, 0)) - n_sigma

    return bisect(f, np.full_like(background, 1e-9), background * 10 + n_sigma**2 * 20 + 100, rounds)


_ERRORS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("errn", "errp", "ul")])


@F.pandas_udf(T.DoubleType())
def p_value(ts: pd.Series) -> pd.Series:
    """One-sided p value of a test statistic."""
    return pd.Series(one_sided_p(ts.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(ts: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(ts.to_numpy(float), df.to_numpy(int)))


@F.pandas_udf(_ERRORS)
def cash_errors(n: pd.Series, background: pd.Series) -> pd.DataFrame:
    """Asymmetric errors at one sigma and the limit at three, over a known background."""
    f = CountsFunction(n.to_numpy(float), background=background.to_numpy(float))
    low, high = f.errors()
    return pd.DataFrame({"errn": low, "errp": high, "ul": f.upper_limit()})


@F.pandas_udf(_ERRORS)
def wstat_errors(n: pd.Series, off: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    f = CountsFunction(n.to_numpy(float), off=off.to_numpy(float), alpha=alpha.to_numpy(float))
    low, high = f.errors()
    return pd.DataFrame({"errn": low, "errp": high, "ul": f.upper_limit()})


@F.pandas_udf(T.DoubleType())
def sensitivity_excess(off: pd.Series, alpha: pd.Series, n_sigma: pd.Series) -> pd.Series:
    return pd.Series(matching_excess(None, n_sigma.to_numpy(float), off.to_numpy(float), alpha.to_numpy(float)))
