"""Counts statistics as Columns. Logarithms of zero counts are taken as zero terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonlake.functions import tails

#: Fixed value: predicted counts below this are raised to it.
TRUNCATION = 1e-25


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(y)).otherwise(0.0)


def cash(n: Column, mu: Column) -> Column:
    """2 (mu - n log mu), mu raised to the truncation value."""
    m = F.greatest(mu.cast("double"), F.lit(TRUNCATION))
    return 2.0 * (m - _xlogy(n.cast("double"), m))


def cstat(n: Column, mu: Column) -> Column:
    """Cash with the constant that makes a perfect prediction zero; both arguments are raised to the truncation value."""
    x, m = (F.greatest(v.cast("double"), F.lit(TRUNCATION)) for v in (n, mu))
    return 2.0 * (m - x + x * (F.log(x) - F.log(m)))


def wstat_background(n: Column, off: Column, alpha: Column, mu: Column) -> Column:
    """Background per off exposure that maximises the likelihood given the signal."""
    n, off = n.cast("double"), off.cast("double")
    c = alpha * (n + off) - (1 + alpha) * mu
    d = F.sqrt(c * c + 4 * alpha * (alpha + 1) * off * mu)
    return (c + d) / (2 * alpha * (alpha + 1))


def wstat(n: Column, off: Column, alpha: Column, mu: Column) -> Column:
    """Likelihood ratio of on and off counts with a profiled background, zero for a perfect fit."""
    b = wstat_background(n, off, alpha, mu)
    x, o = n.cast("double"), off.cast("double")
    fit = mu + (1 + alpha) * b - _xlogy(x, mu + alpha * b) - _xlogy(o, b)
    perfect = F.when(x > 0, x * (1 - F.log(x))).otherwise(0.0) + F.when(o > 0, o * (1 - F.log(o))).otherwise(0.0)
    return 2.0 * (fit - perfect)


def signed_root(excess: Column, ts: Column) -> Column:
    return F.signum(excess) * F.sqrt(F.greatest(ts, F.lit(0.0)))


def cash_counts(n: Column, mu: Column) -> dict[str, Column]:
    """excess, error, ts and sqrt_ts of counts over a known background."""
    n = n.cast("double")
    excess = n - mu
    ts = cash(n, mu) - cash(n, n)
    return {"excess": excess, "error": F.sqrt(n), "ts": ts, "sqrt_ts": signed_root(excess, ts)}


def wstat_counts(n: Column, off: Column, alpha: Column, mu: Column | None = None) -> dict[str, Column]:
    """excess, error, ts and sqrt_ts of counts over a background measured in off regions, beyond a signal ``mu``."""
    n, off = n.cast("double"), off.cast("double")
    mu = F.lit(0.0) if mu is None else mu
    excess = n - alpha * off - mu
    ts = wstat(n, off, alpha, mu) - wstat(n, off, alpha, excess + mu)
    return {"excess": excess, "error": F.sqrt(n + alpha * alpha * off), "ts": ts, "sqrt_ts": signed_root(excess, ts)}


def chi2_asymmetric(flux: Column, model: Column, errn: Column, errp: Column) -> Column:
    """Squared residual in units of the error on the model's side."""
    pull = (flux - model) / F.when(flux > model, errn).otherwise(errp)
    return pull * pull


def chi2_with_limits(flux: Column, model: Column, errn: Column, errp: Column, limit: Column) -> Column:
    """As ``chi2_asymmetric``; a point with an upper ``limit`` (else null) counts by the complementary error function of the model's distance from it."""
    share = tails.erfc((limit - model) / limit) / tails.erfc(F.lit(1.0))
    return F.when(limit.isNull(), chi2_asymmetric(flux, model, errn, errp)).otherwise(2 * F.log(share))


def nan_to_null(x: Column) -> Column:
    """Values that were not measured, as aggregates skip them."""
    return F.when(~F.isnan(x), x)
