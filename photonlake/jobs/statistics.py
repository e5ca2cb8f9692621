"""Queries on counts statistics, responses, quality checks, all-sky pixels and norm fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from photonlake.functions import healpix, sky, special, stats, tails
from photonlake.jobs.datasets import _RUN_BINS, run_bins, wstat_sql
from photonlake.jobs.selections import sep_sql
from photonlake.operators import crossmatch, fits, fluxes
from photonlake.operators import irf as I
from photonlake.operators import maps as M
from photonlake.operators import quality
from photonlake.operators import responses as R
from photonlake.operators import selection as S
from photonlake.registry import query
from photonlake.sources import domain as D
from photonlake.sources import store
from photonlake.streaming.stacking import StackStore, binned

_CB = ", cb as (select px, py, e, counts::double as n, 0.3::double + (px % 5) * 0.5::double as mu from cube)"

_CBASE = D.SQL + _CB


def _counts(spark, sf):
    return D.counts_map(D.photons(spark, sf)).select("px", "py", "e", F.col("counts").alias("n"), (F.lit(0.3) + F.col("px") % 5 * 0.5).alias("mu"))


@query("s1_cash", _CB + " select px, py, e, round(2 * (mu - n * ln(mu)), 6) as stat from cb", D.SQL)
def s1(spark, sf):
    return _counts(spark, sf).select("px", "py", "e", F.round(stats.cash(F.col("n"), F.col("mu")), 6).alias("stat"))


@query("s2_cstat", _CB + " select px, py, e, round(2 * (mu - n + n * (ln(n) - ln(mu))), 6) as stat from cb", D.SQL)
def s2(spark, sf):
    return _counts(spark, sf).select("px", "py", "e", F.round(stats.cstat(F.col("n"), F.col("mu")), 6).alias("stat"))


_W = ", wb as (select obs_id, e, counts::double as n, counts_off::double as o, 0.4::double + (obs_id % 3) * 0.2::double as a, 0.7::double as mu from runs)"


def _wbins(spark, sf):
    return run_bins(spark, sf).withColumn("a", F.lit(0.4) + F.col("obs_id") % 3 * 0.2)


@query("s3_wstat", _RUN_BINS + _W + f" select obs_id, e, round({wstat_sql('n', 'o', 'a', 'mu')}, 6) as stat from wb", D.SQL)
def s3(spark, sf):
    return _wbins(spark, sf).select("obs_id", "e", F.round(stats.wstat(F.col("counts"), F.col("counts_off"), F.col("a"), F.lit(0.7)), 6).alias("stat"))


@query("s4_cash_counts", _CB + " select px, py, e, round(n - mu, 6) as excess, round(sqrt(n), 6) as error, round(2 * (mu - n + n * ln(n / mu)), 5) as ts, round(sign(n - mu) * sqrt(greatest(2 * (mu - n + n * ln(n / mu)), 0)), 5) as sqrt_ts from cb", D.SQL)
def s4(spark, sf):
    c = stats.cash_counts(F.col("n"), F.col("mu"))
    return _counts(spark, sf).select("px", "py", "e", F.round(c["excess"], 6).alias("excess"), F.round(c["error"], 6).alias("error"), F.round(c["ts"], 5).alias("ts"), F.round(c["sqrt_ts"], 5).alias("sqrt_ts"))


_LIMA = "2 * (n * ln((1 + a) / a * n / (n + o)) + o * ln((1 + a) * o / (n + o)))"


@query("s5_wstat_counts", _RUN_BINS + _W + f" select obs_id, e, round(n - a * o, 6) as excess, round(sqrt(n + a * a * o), 6) as error, round(sign(n - a * o) * sqrt(greatest({_LIMA}, 0)), 4) as sqrt_ts from wb where n > 0 and o > 0", D.SQL)
def s5(spark, sf):
    """The likelihood ratio of on and off counts equals the closed form of Li and Ma, which the SQL uses."""
    c = stats.wstat_counts(F.col("counts"), F.col("counts_off"), F.col("a"))
    return _wbins(spark, sf).filter("counts > 0 and counts_off > 0").select("obs_id", "e", F.round(c["excess"], 6).alias("excess"), F.round(c["error"], 6).alias("error"), F.round(c["sqrt_ts"], 4).alias("sqrt_ts"))


@query("s6_summed_counts", _RUN_BINS + _W + ", t as (select e, sum(n) as n, sum(o) as o, sum(a * o) / nullif(sum(o), 0) as a from wb group by e) select e, n::bigint as counts, o::bigint as counts_off, round(a, 7) as alpha, round(n - a * o, 6) as excess from t", D.SQL)
def s6(spark, sf):
    t = _wbins(spark, sf).groupBy("e").agg(F.sum("counts").alias("counts"), F.sum("counts_off").alias("counts_off"), F.sum(F.col("a") * F.col("counts_off")).alias("b"))
    alpha = F.col("b") / F.nullif("counts_off", F.lit(0))
    return t.select("e", "counts", "counts_off", F.round(alpha, 7).alias("alpha"), F.round(F.col("counts") - alpha * F.col("counts_off"), 6).alias("excess"))


_TS = "2 * (mu - n + n * ln(n / mu))"


@query("s7_p_values", _CB + f", t as (select px, py, e, greatest({_TS}, 0) as ts from cb) select px, py, e, round(0.5::double * {tails.erfc_sql('sqrt(ts / 2)')}, 8) as p, round({tails.gamma_tail_sql('1.5::double', '(ts / 2)')}, 8) as p3 from t", D.SQL)
def s7(spark, sf):
    ts = stats.cash_counts(F.col("n"), F.col("mu"))["ts"]
    return _counts(spark, sf).select("px", "py", "e", F.round(tails.one_sided_p(ts), 8).alias("p"), F.round(tails.chi2_tail(ts, F.lit(3)), 8).alias("p3"))


def _halved(rows: str, keys: str, f: str, steps: int = 70) -> str:
    """SQL for roots by halving: ``rows`` (keys, low, high) with ``f`` of ``x`` below zero on the low side; the middle is ``x``."""
    return (
        f"select {keys}, (low + high) / 2 as x from (with recursive r as (select {keys}, 0 as step, low, high from {rows} union all select {keys}, step + 1, case when f < 0 then x else low end, case when f < 0 then high else x end "
        f"from (select *, {f} as f from (select *, (low + high) / 2 as x from r where step < {steps}))) select * from r where step = {steps})"
    )


#: How far the statistic of n counts has risen where the prediction is y.
_RISE = "2 * (y - n - case when n > 0 then n * ln(y / n) else 0 end)"
_S8 = (
    _CB
    + f", k as (select distinct n, mu from cb), up as ({_halved('(select n, mu, 0.0::double as low, 2 * (sqrt(n) + 1) as high from k)', 'n, mu', _RISE.replace('y', '(n + x)') + ' - 1')}), "
    + f"down as ({_halved('(select n, mu, 0.0::double as low, least(2 * (sqrt(n) + 1), n - 1e-12::double) as high from k where n > 0)', 'n, mu', _RISE.replace('y', '(n - x)') + ' - 1')}) "
)


@query("s8_asymmetric_errors", _S8 + "select px, py, e, n::bigint as n, mu, round(down.x, 6) as errn, round(up.x, 6) as errp from cb join up using (n, mu) join down using (n, mu)", D.SQL)
def s8(spark, sf):
    """Distinct (n, mu) pairs are solved once and joined back: a map of many bins has few of them."""
    c = _counts(spark, sf)
    solved = c.select("n", "mu").distinct().withColumn("x", special.cash_errors(F.col("n").cast("double"), F.col("mu"))).select("n", "mu", F.round("x.errn", 6).alias("errn"), F.round("x.errp", 6).alias("errp"))
    return c.join(solved, ["n", "mu"])


_START = "greatest(n - a * o, 0)"
_SPAN = "(2 * (sqrt(n + a * a * o) + 1))"
_S9 = (
    _RUN_BINS
    + _W
    + f", k as (select distinct n, o, a from wb), ul as ({_halved(f'(select n, o, a, {_START} as low, {_START} + 2 * 3 * {_SPAN} + 9 as high from k)', 'n, o, a', wstat_sql('n', 'o', 'a', 'x') + ' - ' + wstat_sql('n', 'o', 'a', _START) + ' - 9')}), "
    + f"ep as ({_halved(f'(select n, o, a, n - a * o as low, n - a * o + {_SPAN} as high from k)', 'n, o, a', wstat_sql('n', 'o', 'a', 'x') + ' - ' + wstat_sql('n', 'o', 'a', '(n - a * o)') + ' - 1')}) "
)


@query("s9_upper_limits", _S9 + "select obs_id, e, n::bigint as counts, o::bigint as counts_off, round(ul.x, 5) as ul, round(ep.x - (n - a * o), 5) as errp from wb join ul using (n, o, a) join ep using (n, o, a)", D.SQL)
def s9(spark, sf):
    c = _wbins(spark, sf).withColumn("x", special.wstat_errors(F.col("counts").cast("double"), F.col("counts_off").cast("double"), F.col("a")))
    return c.select("obs_id", "e", "counts", "counts_off", F.round("x.ul", 5).alias("ul"), F.round("x.errp", 5).alias("errp"))


_S10 = (
    _RUN_BINS
    + ", k as (select e, sum(counts_off)::double as o, 0.2::double as a from runs group by e)"
    + f", ex as ({_halved('(select e, o, a, 1e-9::double as low, a * o * 10 + 600 as high from k)', 'e, o, a', 'sqrt(greatest(' + wstat_sql('(a * o + x)', 'o', 'a', '0.0::double') + ' - ' + wstat_sql('(a * o + x)', 'o', 'a', 'x') + ', 0)) - 5')}) "
)


@query("s10_sensitivity_excess", _S10 + "select e, o as off, round(x, 5) as excess from ex", D.SQL)
def s10(spark, sf):
    t = _wbins(spark, sf).groupBy("e").agg(F.sum("counts_off").cast("double").alias("off"))
    return t.select("e", "off", special.sensitivity_excess(F.col("off"), F.lit(0.2), F.lit(5.0)).alias("excess")).withColumn("excess", F.round("excess", 5))


@query("s11_likelihood_sum", _CB + " select e, round(sum(case when (px + py) % 4 = 0 then 0 else 0.5::double + 0.5 * (px % 2) end * 2 * (mu - n * ln(mu))), 4) as stat from cb group by e", D.SQL)
def s11(spark, sf):
    weight = F.when((F.col("px") + F.col("py")) % 4 == 0, 0.0).otherwise(0.5 + 0.5 * (F.col("px") % 2))
    return _counts(spark, sf).groupBy("e").agg(F.round(F.sum(weight * stats.cash(F.col("n"), F.col("mu"))), 4).alias("stat"))


@query("s12_flux_chi2", "select series, round(sum(power((flux - 60000) / err, 2)), 2) as chi2 from curves group by series", D.SQL)
def s12(spark, sf):
    return D.light_curves(spark, sf).groupBy("series").agg(F.round(F.sum(F.pow((F.col("flux") - 60000) / F.col("err"), 2)), 2).alias("chi2"))


@query("s12_flux_chi2_asymmetric", "select series, round(sum(power((flux - 60000) / case when flux > 60000 then 0.8::double * err else 1.2::double * err end, 2)), 2) as chi2 from curves group by series", D.SQL)
def s12_asymmetric(spark, sf):
    """Each point's error towards the model: the lower one where the flux lies above it, else the upper one."""
    errn, errp = F.col("err") * 0.8, F.col("err") * 1.2
    return D.light_curves(spark, sf).groupBy("series").agg(F.round(F.sum(stats.chi2_asymmetric(F.col("flux"), F.lit(60000.0), errn, errp)), 2).alias("chi2"))


@query("s12_flux_chi2_limits", f", u as (select series, flux, err, case when day % 5 = 0 then flux + 2 * err end as ul from curves), v as (select *, (ul - 60000) / ul as a from u) select series, round(sum(case when ul is null then power((flux - 60000) / err, 2) else 2 * ln({tails.erfc_sql('a')} / {tails.erfc_sql('1.0::double')}) end), 2) as stat from v group by series", D.SQL)
def s12_limits(spark, sf):
    """Every fifth day is an upper limit, which counts by the complementary error function of its distance from the model."""
    c = D.light_curves(spark, sf).withColumn("ul", F.when(F.col("day") % 5 == 0, F.col("flux") + 2 * F.col("err")))
    return c.groupBy("series").agg(F.round(F.sum(stats.chi2_with_limits(F.col("flux"), F.lit(60000.0), F.col("err"), F.col("err"), F.col("ul"))), 2).alias("stat"))


_RECURSIVE = D.SQL.replace("with photons", "with recursive photons", 1)


def _fit_query(name: str, bins: str, keys: str):
    """Register a fit with its SQL; results are rounded where halvings in any order agree."""
    rounded = f"select {keys}, round(norm, 6) as norm, round(norm_err, 6) as norm_err, round(ts, 4) as ts from ("
    head, last = R.fit_sql(bins, keys).rsplit(" select ", 1)[0], R.fit_sql(bins, keys).rsplit(" select ", 1)[1]
    return query(name, f"{head} {rounded}select {last}) q", _RECURSIVE)


def _rounded(fits, *keys):
    return fits.select(*keys, F.round("norm", 6).alias("norm"), F.round("norm_err", 6).alias("norm_err"), F.round("ts", 4).alias("ts"))


@_fit_query("e2_test_statistic_map", "select (px + i)::int as cx, (py + j)::int as cy, counts::double as counts, 0.5::double + px % 3 as background, power(2.0::double, -(i * i + j * j)) * (1 + 0.25::double * (py % 4)) as signal from img, range(-1, 2) a(i), range(-1, 2) b(j)", "cx, cy")
def e2(spark, sf):
    """Best norm and its significance per pixel: counts in its kernel window against a background model, the source as kernel times exposure."""
    image = D.image(D.counts_map(D.photons(spark, sf)))
    kernel = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(2.0 ** -(i * i + j * j)).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    exposure = 1 + 0.25 * (F.col("py") % 4)
    spread = image.withColumn("k", kernel).select((F.col("px") + F.col("k.i")).alias("cx"), (F.col("py") + F.col("k.j")).alias("cy"), F.col("counts").cast("double").alias("counts"), (F.lit(0.5) + F.col("px") % 3).alias("background"), (F.col("k.w") * exposure).alias("signal"))
    return _rounded(fits.fit_norms(spread, ["cx", "cy"]), "cx", "cy")


@_fit_query("e2_test_statistic_tiles", "select px + i as cx, py + j as cy, counts::double as counts, 0.5::double + px % 3 + 0.013::double * py as background, power(2.0::double, -(i * i + j * j) / 4.0::double) * (1 + 0.25::double * (py % 4)) as signal from img, range(-3, 4) a(i), range(-3, 4) b(j)", "cx, cy")
def e2_tiles(spark, sf):
    """The same with a wide kernel and a background that differs in every row of pixels, by tiles with a halo."""
    image = D.image(D.counts_map(D.photons(spark, sf)))
    n = np.arange(-3, 4)
    kernel = 2.0 ** (-(n[:, None] ** 2 + n**2) / 4.0)
    pixels = image.select("px", "py", "counts", (F.lit(0.5) + F.col("px") % 3 + 0.013 * F.col("py")).alias("background"), (1 + 0.25 * (F.col("py") % 4)).alias("exposure"))
    found = fits.fit_map(pixels, kernel, tile=16).withColumnsRenamed({"px": "cx", "py": "cy"})
    return _rounded(found.withColumn("norm_err", F.nanvl("norm_err", F.lit(None))), "cx", "cy")


@_fit_query("e3_flux_points", "select e, counts::double as counts, 0.5::double + px % 3 as background, 1.0::double + py % 2 as signal from cube", "e")
def e3(spark, sf):
    """Joint norm of all pixels of an energy bin."""
    b = D.counts_map(D.photons(spark, sf)).select("e", F.col("counts").cast("double").alias("counts"), (F.lit(0.5) + F.col("px") % 3).alias("background"), (F.lit(1.0) + F.col("py") % 2).alias("signal"))
    return _rounded(fits.fit_norms(b, ["e"]), "e")


_E6 = (
    D.SQL
    + """, k as (
  select e, count(*) filter (where away < 0.90003)::double as n, greatest(count(*) filter (where away >= 0.90003 and away < 1.60003) * 0.46153::double, 1) as mu
  from (select floor(energy / 2.500013::double)::int as e, sqrt(lon * lon + lat * lat) as away from photons) where e between 0 and 3 group by e
)"""
    + f", up as ({_halved('(select e, n, 0.0::double as low, 2 * (sqrt(n) + 1) as high from k)', 'e, n', _RISE.replace('y', '(n + x)') + ' - 1')})"
    + f", down as ({_halved('(select e, n, 0.0::double as low, least(2 * (sqrt(n) + 1), n - 1e-12::double) as high from k where n > 0)', 'e, n', _RISE.replace('y', '(n - x)') + ' - 1')})"
    + f", lim as ({_halved('(select e, n, mu, greatest(n - mu, 0) as low, greatest(n - mu, 0) + 12 * (sqrt(n) + 1) + 9 as high from k)', 'e, n, mu', _RISE.replace('y', '(mu + x)') + ' - (' + _RISE.replace('y', '(mu + greatest(n - mu, 0))') + ') - 9')})"
    + """, q as (
  select k.e, k.n, k.mu, down.x as errn, up.x as errp, lim.x as ul, 2 * (k.mu - k.n + k.n * ln(k.n / k.mu)) as ts, 50.0::double * (k.e + 1) as npred, 0.5::double + 2.5::double * k.e as lo, 3.0::double + 2.5::double * k.e as hi
  from k join up using (e) join down using (e) join lim using (e)
), f as (select *, 2e-3::double * power(2.0::double, 2.3::double) * (power(hi, -1.3::double) - power(lo, -1.3::double)) / -1.3::double as flux1, 2e-3::double * power(sqrt(lo * hi) / 2, -2.3::double) as dnde1 from q)
select e, round((n - mu) / npred * flux1, 9) as flux, round(sqrt(n) / npred * flux1, 9) as flux_err, round(errn / npred * flux1, 9) as flux_errn, round(errp / npred * flux1, 9) as flux_errp, round(ul / npred * flux1, 9) as flux_ul,
  round(ul / npred * dnde1 * lo * hi, 8) as e2dnde_ul, round(errp / npred * dnde1, 9) as dnde_errp, round(case when n > mu then 1 else -1 end * sqrt(greatest(ts, 0)), 6) as sqrt_ts, case when n > mu then 1 else -1 end * sqrt(greatest(ts, 0)) < 2 as is_ul from f"""
)


@query("e6_flux_asymmetric", _E6)
def e6_asymmetric(spark, sf):
    """Flux points of the source region by energy: norms from counts over the background of a ring, with errors to both sides and limits where the likelihood has risen."""
    away = F.sqrt(F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat"))
    e = F.floor(F.col("energy") / 2.500013).cast("int")
    k = D.photons(spark, sf).select(e.alias("e"), away.alias("away")).filter("e between 0 and 3").groupBy("e").agg(F.count_if(F.col("away") < 0.90003).cast("double").alias("n"), F.greatest(F.count_if((F.col("away") >= 0.90003) & (F.col("away") < 1.60003)) * 0.46153, F.lit(1.0)).alias("mu"))
    n, mu, npred = F.col("n"), F.col("mu"), 50.0 * (F.col("e") + 1)
    points = k.filter("n > 0").withColumn("x", special.cash_errors(n, mu)).select("e", ((n - mu) / npred).alias("norm"), (F.sqrt(n) / npred).alias("norm_err"), (F.col("x.errn") / npred).alias("norm_errn"), (F.col("x.errp") / npred).alias("norm_errp"), (F.col("x.ul") / npred).alias("norm_ul"), stats.cash_counts(n, mu)["ts"].alias("ts"))
    model = fluxes.power_law(F.lit(2.3), F.lit(2e-3), F.lit(2.0), 0.5 + 2.5 * F.col("e"), 3.0 + 2.5 * F.col("e"))
    q = fluxes.quantities(points, ["e"], model)
    return q.select("e", *[F.round(c, 9).alias(c) for c in ("flux", "flux_err", "flux_errn", "flux_errp", "flux_ul")], F.round("e2dnde_ul", 8).alias("e2dnde_ul"), F.round("dnde_errp", 9).alias("dnde_errp"), F.round("sqrt_ts", 6).alias("sqrt_ts"), "is_ul")


@query("c3_pulse_profiles", ", b as (select event_type, least(floor(phase * 20), 19)::int as phase_bin, 0.5::double + (event_id % 4) * 0.1::double as w, unnest(list_filter([case when energy >= 0.1 then 'all' end, case when energy >= 0.1 and energy < 1 then 'low' end, case when energy >= 1 and energy < 5 then 'mid' end, case when energy >= 5 and energy < 1000 then 'high' end], lambda x: x is not null)) as band from photons where energy < 1000 and phase is not null) select event_type, band, phase_bin, round(sum(w), 6) as value, round(sqrt(sum(w * w)), 6) as unc from b group by all", D.SQL)
def c3_pulses(spark, sf):
    """Weighted counts by pulse phase in each energy band, with their uncertainties."""
    bands = [("all", 0.1, 1000.0), ("low", 0.1, 1.0), ("mid", 1.0, 5.0), ("high", 5.0, 1000.0)]
    events = D.photons(spark, sf).filter("phase is not null")
    out = fluxes.pulse_profiles(events, ["event_type"], "phase", "energy", bands, 20, 0.5 + F.col("event_id") % 4 * 0.1)
    return out.select("event_type", "band", "phase_bin", F.round("value", 6).alias("value"), F.round("unc", 6).alias("unc"))


@query("e9_combined_significance", _CB + f", t as (select px, py, sum(ts) as ts, count(*) filter (where ts > 0)::int as df, sum(n - mu) as x from (select *, {_TS} as ts from cb) group by px, py) select px, py, round(ts, 6) as ts, df, round({tails.gamma_tail_sql('(df / 2.0::double)', '(ts / 2)')}, 8) as p, sign(x)::double as sign from t where df > 0", D.SQL)
def e9(spark, sf):
    c = stats.cash_counts(F.col("n"), F.col("mu"))
    t = _counts(spark, sf).select("px", "py", c["ts"].alias("ts"), c["excess"].alias("x")).groupBy("px", "py").agg(F.sum("ts").alias("ts"), F.count_if(F.col("ts") > 0).cast("int").alias("df"), F.sum("x").alias("x"))
    return t.filter("df > 0").select("px", "py", F.round("ts", 6).alias("ts"), "df", F.round(tails.chi2_tail(F.col("ts"), F.col("df")), 8).alias("p"), F.signum("x").alias("sign"))


@query("e10_resampled_limits", ", g as (select i::int as i, i * 0.05::double as x from range(201) t(i)), p as (select (e > 1)::int as band, i, x, sum(2 * (mu + x - n * ln(mu + x))) as s from cb, g group by all), b as (select band, min(s) as least, min_by(x, (s, x)) as best from p group by band), q as (select p.*, least, best, s - least - 4 as d, lag(s - least - 4) over (partition by band order by i) as d0 from p join b using (band)) select band, round(min(best), 6) as best, round(min(x - 0.05::double * d / (d - d0)), 6) as ul from q where x > best and d >= 0 and d0 < 0 group by band", _CBASE)
def e10(spark, sf):
    """Profiles of two bands summed over all their bins; the limit is where the sum has risen by 4 from its least, linear between grid points."""
    g = F.explode(F.sequence(F.lit(0), F.lit(200))).alias("i")
    p = _counts(spark, sf).select((F.col("e") > 1).cast("int").alias("band"), "n", "mu").groupBy("band", "n", "mu").agg(F.count("*").alias("m"))
    p = p.select("band", "n", "mu", "m", g).withColumn("x", F.col("i") * 0.05)
    p = p.groupBy("band", "i", "x").agg(F.sum(F.col("m") * stats.cash(F.col("n"), F.col("mu") + F.col("x"))).alias("s"))
    best = p.groupBy("band").agg(F.min("s").alias("least"), F.min_by("x", F.struct("s", "x")).alias("best"))
    w = Window.partitionBy("band").orderBy("i")
    q = p.join(F.broadcast(best), "band").withColumn("d", F.col("s") - F.col("least") - 4).withColumn("d0", F.lag("d").over(w))
    crossing = F.col("x") - 0.05 * F.col("d") / (F.col("d") - F.col("d0"))
    return q.filter("x > best and d >= 0 and d0 < 0").groupBy("band").agg(F.round(F.min("best"), 6).alias("best"), F.round(F.min(crossing), 6).alias("ul"))


@query("e11_sensitivity_table", _S10 + "select e, off, round(greatest(sig, syst, 10), 5) as excess, case when greatest(sig, syst, 10) = sig then 'significance' when greatest(sig, syst, 10) = 10 then 'gamma' else 'bkg' end as criterion from (select e, o as off, x as sig, o * 0.2::double * 0.05::double as syst from ex)", D.SQL)
def e11(spark, sf):
    t = run_bins(spark, sf).groupBy("e").agg(F.sum("counts_off").cast("double").alias("off"))
    x = t.withColumn("significance", special.sensitivity_excess(F.col("off"), F.lit(0.2), F.lit(5.0))).withColumn("systematic", F.col("off") * 0.2 * 0.05)
    excess = F.greatest("significance", "systematic", F.lit(10.0))
    label = F.when(excess == F.col("significance"), "significance").when(excess == 10.0, "gamma").otherwise("bkg")
    return x.select("e", "off", F.round(excess, 5).alias("excess"), label.alias("criterion"))


@_fit_query("e12_flux_profile", "select floor(sqrt(power(px - 20, 2) + power(py - 20, 2)) / 3.0003::double)::int as ring, counts::double as counts, 2.0::double as background, 1.0::double as signal from img", "ring")
def e12(spark, sf):
    ring = F.floor(F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2)) / 3.0003).cast("int")
    b = D.image(D.counts_map(D.photons(spark, sf))).select(ring.alias("ring"), F.col("counts").cast("double").alias("counts"), F.lit(2.0).alias("background"), F.lit(1.0).alias("signal"))
    return _rounded(fits.fit_norms(b, ["ring"]), "ring")


KINDS = ["aeff", "bias", "bkg"]
#: Energies at which exposures are given, and the edges of the background's bins.
_CENTERS, _EDGES = [0.5, 5.0, 50.0], [0.5, 1.0, 2.0, 4.0, 8.0]


def runs_with_responses(spark, sf, obs, kinds=KINDS):
    """Each run with the node arrays of its own response."""
    return I.with_responses(D.run_responses(spark, sf, obs), I.folded(D.response_nodes(spark, sf), "irf_id", kinds), "irf_id")


_PIXEL_RUNS = (
    D.IRF_SQL
    + f", pr as (select px, py, obs_id, energy, livetime, ontime, away, en, off, aeff, bkg from (select x::int as px, y::int as py, x * 0.5::double - 2 as plon, y * 0.5::double - 2 as plat from range(9) a(x), range(9) b(y)) p join runs_irf o on {sep_sql('plon', 'plat', 'lon_pnt', 'lat_pnt')} < 2.00003, lateral (select {sep_sql('plon', 'plat', 'lon_pnt', 'lat_pnt')} as away), (select unnest({{energies}}) as energy) q)"
    + f", pv as (select *, {I.value_sql('aeff', 'energy', 'away')} as a, {I.value_sql('bkg', 'energy', 'away', log=True)} as b from {I.placed_sql('pr', 'energy', 'away')})"
    + f", ax as (select *, {I.value_sql('aeff', 'energy', '0.0::double')} as a0 from {I.placed_sql('(select * exclude (ii, jj) from pv)', 'energy', '0.0::double')})"
)
_CENTER_RUNS, _EDGE_RUNS = (_PIXEL_RUNS.replace("{energies}", f"{x}::double[]") for x in (_CENTERS, _EDGES))


def _pixel_runs(spark, sf, *kinds):
    """Pixels of half a degree with the runs within two degrees, and the responses of those."""
    runs = runs_with_responses(spark, sf, D.observations(D.photons(spark, sf)), list(kinds))
    pixels = M.grid(spark, 9, 9).withColumn("lon", F.col("px") * 0.5 - 2).withColumn("lat", F.col("py") * 0.5 - 2)
    return crossmatch.within(pixels, runs.withColumnsRenamed({"lon_pnt": "lon2", "lat_pnt": "lat2"}), 2.00003)


def _exposure(spark, sf):
    energy = F.get(F.array(*map(F.lit, _CENTERS)), F.col("e")).alias("energy")
    return I.exposure(_pixel_runs(spark, sf, "aeff"), ["px", "py"], _CENTERS).select("px", "py", energy, "exposure", "livetime")


@query("a23_exposure_map", _CENTER_RUNS + " select px, py, energy, round(sum(a * livetime) / 1e6, 5) as exposure from pv group by all", D.SQL)
def a23(spark, sf):
    return _exposure(spark, sf).select("px", "py", "energy", F.round(F.col("exposure") / 1e6, 5).alias("exposure"))


@query("a24_effective_livetime", _CENTER_RUNS + " select px, py, energy, round(sum(case when a0 > 0 then a / a0 else 0 end * livetime) / 1e6, 5) as livetime from ax group by all", D.SQL)
def a24(spark, sf):
    """Live time in 1e6 s that would give the exposure on the axis."""
    return _exposure(spark, sf).select("px", "py", "energy", F.round(F.col("livetime") / 1e6, 5).alias("livetime"))


_SOLID_SQL = "radians(0.5::double) * (sin(radians(py * 0.5::double - 2 + 0.25::double)) - sin(radians(py * 0.5::double - 2 - 0.25::double)))"


@query("a25_background_map", _EDGE_RUNS + f", bins as (select px, py, ontime, energy, b, lead(energy) over w as energy1, lead(b) over w as b1, (row_number() over w - 1)::int as e from pv window w as (partition by px, py, obs_id order by energy)) select px, py, e, round(sum({I.integral_sql('energy', 'b', 'energy1', 'b1')} * ontime) * {_SOLID_SQL}, 4) as background from bins where e < 4 group by px, py, e", D.SQL)
def a25(spark, sf):
    """Counts of the background in each pixel and energy bin: the rates of all runs, integrated by power laws between the bin's edges."""
    g = I.background(_pixel_runs(spark, sf, "bkg"), ["px", "py"], _EDGES)
    lat = F.col("py") * 0.5 - 2
    solid = F.radians(F.lit(0.5)) * (F.sin(F.radians(lat + 0.25)) - F.sin(F.radians(lat - 0.25)))
    return g.select("px", "py", "e", F.round(F.col("rate") * solid, 4).alias("background"))


_OFFS = f", off as (select event_id, energy, {sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} as away from photons p join obs o using (obs_id))"


@query("r1_response_lookup", _OFFS + " select event_id, case when energy >= 0.1 and energy < 1 and away < 1.00003 then 1.5 when energy >= 1 and energy < 10 and away < 1.00003 then 9.5 when energy >= 1 and energy < 10 and away < 2.00003 then 6.5 end::double as value from off", D.SQL)
def r1(spark, sf):
    table = spark.createDataFrame([(0.1, 1.0, 0.0, 1.00003, 1.5), (1.0, 10.0, 0.0, 1.00003, 9.5), (1.0, 10.0, 1.00003, 2.00003, 6.5)], "e_lo double, e_hi double, o_lo double, o_hi double, value double")
    events = D.photons(spark, sf)
    placed = S.with_pointing(events, D.observations(events), "lon_pnt", "lat_pnt").withColumn("away", sky.separation("lon", "lat", "lon_pnt", "lat_pnt"))
    return R.nearest_bin(placed, table, "energy", "away").select("event_id", "value")


@query("r1_response_interpolated", D.IRF_SQL + f", w as (select event_id, energy, {sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} as away, en, off, aeff, bias from photons p join runs_irf o using (obs_id)) select event_id, round({I.value_sql('aeff', 'energy', 'away')}, 6) as aeff, round({I.value_sql('bias', 'energy', 'away')}, 6) as bias from {I.placed_sql('w', 'energy', 'away')}", D.SQL)
def r1_interpolated(spark, sf):
    """The area and the bias of its run's own response at each photon's energy and offset."""
    events = D.photons(spark, sf)
    runs = runs_with_responses(spark, sf, D.observations(events), ["aeff", "bias"])
    placed = S.with_pointing(events, runs, "lon_pnt", "lat_pnt", "aeff", "bias").withColumn("away", sky.separation("lon", "lat", "lon_pnt", "lat_pnt"))
    return placed.select("event_id", *[F.round(I.value(F.col(c), F.col("energy"), F.col("away")), 6).alias(c) for c in ("aeff", "bias")])


@query("r2_psf_containment", ", p as (select vec_id, i as rad_i, i * 0.05::double + 0.025::double as rad, flux[i + 1] as v, (i * 0.05::double + 0.025::double) * 0.05::double as solid from bands, lateral (select unnest(range(len(flux))) as i) t), c as (select vec_id, rad, abs(sum(v * solid) over (partition by vec_id order by rad rows between unbounded preceding and current row) / sum(v * solid) over (partition by vec_id) - 0.68::double) as miss from p) select vec_id, round(min_by(rad, (miss, rad)), 6) as radius from c group by vec_id", D.SQL)
def r2(spark, sf):
    p = D.band_arrays(spark, sf).select("vec_id", F.posexplode("flux").alias("i", "value"))
    rad = F.col("i") * 0.05 + 0.025
    p = p.select("vec_id", rad.alias("rad"), "value", (rad * 0.05).alias("solid"))
    return R.psf_containment(p, ["vec_id"], 0.68).select("vec_id", F.round("radius", 6).alias("radius"))


_EDISP = ", d as (select vec_id, (i // 8 + 1)::double as e_true, (i % 8 + 1)::double * 0.7::double as e_reco, flux[i + 1] as p from bands, lateral (select unnest(range(len(flux))) as i) t)"
_MOMENTS = ", g as (select vec_id, e_true, sum(p) as n, sum(p * e_reco) as a, sum(p * e_reco * e_reco) as b from d group by all)"


def _edisp(spark, sf):
    p = D.band_arrays(spark, sf).select("vec_id", F.posexplode("flux").alias("i", "p"))
    return p.select("vec_id", (F.floor(F.col("i") / 8) + 1).cast("double").alias("e_true"), ((F.col("i") % 8 + 1) * 0.7).alias("e_reco"), "p")


@query("r3_dispersion_moments", _EDISP + _MOMENTS + " select vec_id, e_true, round(a / n, 6) as mean, round((a / n - e_true) / e_true, 6) as bias, round(sqrt(greatest(b / n - (a / n) * (a / n), 0)) / e_true, 6) as resolution from g", D.SQL)
def r3(spark, sf):
    m = R.dispersion_moments(_edisp(spark, sf), ["vec_id"])
    return m.select("vec_id", "e_true", *[F.round(c, 6).alias(c) for c in ("mean", "bias", "resolution")])


@query("r4_response_features", _EDISP + _MOMENTS + ", m as (select vec_id, (a / n - e_true) / e_true as bias from g where e_true = 2) select vec_id, round((bias - avg(bias) over ()) / stddev_pop(bias) over (), 5) as bias from m", D.SQL)
def r4(spark, sf):
    m = R.dispersion_moments(_edisp(spark, sf), ["vec_id"]).filter("e_true = 2")
    s = m.agg(F.avg("bias").alias("a"), F.stddev_pop("bias").alias("s"))
    return m.crossJoin(F.broadcast(s)).select("vec_id", F.round((F.col("bias") - F.col("a")) / F.col("s"), 5).alias("bias"))


@query("r5_background_slice", "select px - 20 as offset_bin, e, counts::bigint as value from cube where py = 20 and px >= 20", D.SQL)
def r5(spark, sf):
    return D.counts_map(D.photons(spark, sf)).filter("py = 20 and px >= 20").select((F.col("px") - 20).alias("offset_bin"), "e", F.col("counts").alias("value"))


@query("q1_event_checks", ", x as (select obs_id, count(*) filter (where d <= 0) as u, count(*) filter (where energy <= 0.01) as z from (select obs_id, energy, t_us - lag(t_us) over (partition by obs_id order by event_id) as d from photons) group by obs_id) select 'error' as level, obs_id, 'events not in order of time' as msg from x where u > 0 union all select 'warning', obs_id, 'energies too low' from x where z > 0 union all select 'warning', obs_id, 'few events' from obs where n_events < 55", D.SQL)
def q1(spark, sf):
    events = D.photons(spark, sf)
    step = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("obs_id").orderBy("event_id"))
    x = events.withColumn("d", step).groupBy("obs_id").agg(F.count_if(F.col("d") <= 0).alias("u"), F.count_if(F.col("energy") <= 0.01).alias("z"), F.count("*").alias("n"))
    checks = F.array(
        F.when(F.col("u") > 0, F.struct(F.lit("error").alias("level"), F.lit("events not in order of time").alias("msg"))),
        F.when(F.col("z") > 0, F.struct(F.lit("warning").alias("level"), F.lit("energies too low").alias("msg"))),
        F.when(F.col("n") < 55, F.struct(F.lit("warning").alias("level"), F.lit("few events").alias("msg"))),
    )
    return x.select("obs_id", F.explode(F.array_compact(checks)).alias("c")).select("c.level", "obs_id", "c.msg")


@query("q2_interval_checks", "select 'error' as level, obs_id, 'no interval' as msg from obs where obs_id not in (select obs_id from gti) union all select 'error', obs_id, 'interval is empty' from gti where stop <= start + 50000 group by obs_id", D.SQL)
def q2(spark, sf):
    obs, gti = D.observations(D.photons(spark, sf)), D.intervals(spark, sf)
    none = obs.join(gti.select("obs_id"), "obs_id", "left_anti").select(F.lit("error").alias("level"), "obs_id", F.lit("no interval").alias("msg"))
    empty = gti.filter(F.col("stop") <= F.col("start") + 50000).select("obs_id").distinct().select(F.lit("error").alias("level"), "obs_id", F.lit("interval is empty").alias("msg"))
    return none.union(empty)


#: Runs and events with a fault of each kind planted in some of them.
_FAULTY = f""", runs_q as (select obs_id, t0 / 1e6::double + case when obs_id % 7 = 1 then 1 else 0 end as start, t1 / 1e6::double - case when obs_id % 7 = 2 then 1 else 0 end as stop from obs where obs_id % 13 <> 5
), ev as (select obs_id, event_id, t_us / 1e6::double as time, 120 + 10 * lon as ra, 20 + 10 * lat as dec, case when event_id % 997 = 3 then -1 else energy end as en from photons where obs_id % 11 <> 4)"""
_FAULTS = """, w as (select obs_id, time, en, event_id, lag(time) over (partition by obs_id order by event_id, time) as b from ev
), g as (select obs_id, min(time) as a, max(time) as z, bool_or(time <= b) as d, bool_or(en is null or en <= 0) as bad, bool_or(event_id % 499 = 7) as apart from w group by obs_id
), j as (select coalesce(r.obs_id, g.obs_id) as obs_id, r.obs_id as run, start, stop, a, z, d, bad, apart from runs_q r full join g on r.obs_id = g.obs_id)
select 'error' as level, 'events' as "table", obs_id, 'no events' as msg from j where a is null union all select 'error', 'events', obs_id, 'events of no run' from j where run is null
union all select 'error', 'events', obs_id, 'events before the run''s start' from j where a < start - 1e-6 union all select 'error', 'events', obs_id, 'events after the run''s stop' from j where z > stop + 1e-6
union all select 'error', 'events', obs_id, 'events not in order of time' from j where d union all select 'error', 'events', obs_id, 'galactic and equatorial coordinates disagree' from j where apart
union all select 'warning', 'events', obs_id, 'energies that are not positive' from j where bad union all select 'error', 'events', null, 'missing column time_mjd'"""


@query("q1_event_rules", _FAULTY + _FAULTS, D.SQL)
def q1_rules(spark, sf):
    """Columns by the schema, then events against their runs, with faults planted in some: each is found, and nothing else."""
    photons = D.photons(spark, sf)
    k = F.col("obs_id")
    runs = D.observations(photons).filter(k % 13 != 5).select("obs_id", (F.col("t0") / 1e6 + F.when(k % 7 == 1, 1).otherwise(0)).alias("start"), (F.col("t1") / 1e6 - F.when(k % 7 == 2, 1).otherwise(0)).alias("stop"))
    energy = F.when(F.col("event_id") % 997 == 3, -1.0).otherwise(F.col("energy"))
    events = photons.filter(k % 11 != 4).select("obs_id", "event_id", (F.col("t_us") / 1e6).alias("time"), (120 + 10 * F.col("lon")).alias("ra"), (20 + 10 * F.col("lat")).alias("dec"), energy.alias("energy"))
    glon, glat = sky.to_galactic("ra", "dec")
    events = events.withColumn("glon", glon).withColumn("glat", glat + F.when(F.col("event_id") % 499 == 7, 0.01).otherwise(0.0))
    return quality.columns(spark, events, "events", quality.REQUIRED["events"] | {"time_mjd": ("double",)}).unionByName(quality.events(events, runs))


@query("q2_interval_rules", ", i as (select obs_id, start::double as start, (case when obs_id % 17 = 0 then start else stop end)::double as stop from gti), r as (select o_custkey as obs_id, min(epoch_us(o_orderdate) // 1000000)::double + case when o_custkey % 5 = 1 then 10 else 0 end as start, 4e9::double as stop from orders where o_custkey % 9 <> 2 group by o_custkey union all select -1, 0, 1), g as (select obs_id, min(start) as a, max(stop) as z, bool_or(stop <= start) as e from i group by obs_id), j as (select coalesce(r.obs_id, g.obs_id) as obs_id, r.obs_id as run, start, stop, a, z, e from r full join g on r.obs_id = g.obs_id) select 'error' as level, 'intervals' as \"table\", obs_id, 'no interval' as msg from j where a is null union all select 'error', 'intervals', obs_id, 'intervals of no run' from j where run is null union all select 'error', 'intervals', obs_id, 'interval is empty' from j where e union all select 'warning', 'intervals', obs_id, 'intervals reach out of the run' from j where a < start or z > stop", D.SQL)
def q2_rules(spark, sf):
    gti, k = D.intervals(spark, sf), F.col("obs_id")
    rows = gti.select("obs_id", F.col("start").cast("double").alias("start"), F.when(k % 17 == 0, F.col("start")).otherwise(F.col("stop")).cast("double").alias("stop"))
    runs = gti.filter(k % 9 != 2).groupBy("obs_id").agg(F.min("start").cast("double").alias("start")).select("obs_id", (F.col("start") + F.when(k % 5 == 1, 10).otherwise(0)).alias("start"), F.lit(4e9).alias("stop"))
    runs = runs.union(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(0.0), F.lit(1.0)))
    return quality.columns(spark, rows, "intervals").unionByName(quality.intervals(rows, runs))


@query("q3_duplicate_ids", "select obs_id, start, count(*)::bigint as n from gti group by all having count(*) > 1", D.SQL)
def q3(spark, sf):
    return D.intervals(spark, sf).groupBy("obs_id", "start").agg(F.count("*").alias("n")).filter("n > 1")


@query("io3_index_tables", "select obs_id, count(*)::bigint as files from (select obs_id, unnest(['events', 'gti']) as kind from obs) group by obs_id", D.SQL)
def io3(spark, sf):
    """The index of a store, written with a copy of all runs and read back."""
    events, path = D.photons(spark, sf), store.new_folder(spark, "store")
    store.copy_observations({"events": events, "gti": D.intervals(spark, sf)}, D.observations(events), path)
    return spark.read.parquet(f"{path}/index").groupBy("obs_id").agg(F.count("*").alias("files"))


@query("io7_copy_subset", "select obs_id, event_type, count(*)::bigint as n from photons where obs_id in (select obs_id from obs where n_events > 70) and event_type in ('click', 'view') group by all", D.SQL)
def io7(spark, sf):
    """A subset of runs and kinds copied to a new store, and counted there."""
    events, path = D.photons(spark, sf), store.new_folder(spark, "subset")
    wanted = D.observations(events).filter("n_events > 70").select("obs_id")
    store.copy_observations({"events": events.filter(F.col("event_type").isin("click", "view"))}, wanted, path)
    return store.read_copy(spark, path, "events").groupBy("obs_id", "event_type").agg(F.count("*").alias("n"))


_WIDE = "(select event_id, lon * 90 as wlon, lat * 44 as wlat from photons)"


@query("p13_sky_pixels", f" select event_id, ring, nest, nest as swapped, round(c_lon, 9) as lon, round(c_lat, 9) as lat from {healpix.pixel_sql(_WIDE, 'wlon', 'wlat', 64)}", D.SQL)
def p13(spark, sf):
    """Pixel numbers in both schemes, swapped back and forth, and the center."""
    e = D.photons(spark, sf).select("event_id", (F.col("lon") * 90).alias("lon"), (F.col("lat") * 44).alias("lat"))
    e = e.withColumn("ring", healpix.pixel_of(64)("lon", "lat")).withColumn("nest", healpix.pixel_of(64, True)("lon", "lat"))
    return e.withColumn("swapped", healpix.swap(64, True)("ring")).withColumn("c", healpix.center_of(64)("ring")).select("event_id", "ring", "nest", "swapped", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


@query("a2_fill_sky_pixels", f" select ring as ipix, count(*)::bigint as value from {healpix.pixel_sql(_WIDE, 'wlon', 'wlat', 32)} group by ring", D.SQL)
def a2(spark, sf):
    e = D.photons(spark, sf)
    return M.fill(e, {"ipix": healpix.pixel_of(32)(F.col("lon") * 90, F.col("lat") * 44)})


@query("a8_change_resolution", f" select nest >> 4 as ipix, count(*)::bigint as value from {healpix.pixel_sql(_WIDE, 'wlon', 'wlat', 32)} group by 1", D.SQL)
def a8(spark, sf):
    """Nested pixels two levels coarser, by shifting their numbers."""
    fine = M.fill(D.photons(spark, sf), {"ipix": healpix.pixel_of(32, True)(F.col("lon") * 90, F.col("lat") * 44)})
    return fine.groupBy(F.shiftright("ipix", 4).alias("ipix")).agg(F.sum("value").alias("value"))


_GRID = "(select x::int as px, y::int as py, x * 0.2::double - 2 as glon, y * 0.2::double - 2 as glat from range(21) a(x), range(21) b(y))"


@query("m8_sky_to_plane", f", m as (select ring, count(*)::bigint as value from {healpix.pixel_sql('photons', 'lon', 'lat', 64)} group by ring) select px, py, value from {healpix.pixel_sql(_GRID, 'glon', 'glat', 64)} g left join m using (ring)", D.SQL)
def m8(spark, sf):
    """A sky-pixel map looked up at the centers of a plane map."""
    sky_map = M.fill(D.photons(spark, sf), {"ipix": healpix.pixel_of(64)("lon", "lat")})
    target = M.grid(spark, 21, 21).withColumn("ipix", healpix.pixel_of(64)(F.col("px") * 0.2 - 2, F.col("py") * 0.2 - 2))
    return target.join(sky_map, "ipix", "left").select("px", "py", "value")


@query("x3_incremental_stack", "select time_bucket(interval '1 day', time)::timestamp as start, floor(energy / 2.500013::double)::int as e, count(*)::bigint as counts, round(sum(energy), 5) as energy from photons group by all", D.SQL)
def x3(spark, sf):
    """The events of four groups of runs, merged into a stored stack one after the other; the second is played twice, and a snapshot taken before the last."""
    events, path = D.photons(spark, sf), store.new_folder(spark, "stack")
    stack = StackStore(spark, path, ["start", "e"], ["counts", "energy"])
    for number, part in enumerate((0, 1, 1, 2, 3)):
        batch = number - (number > 1)
        stack.add(binned(events.filter(F.col("obs_id") % 4 == part), "1 day"), batch)
        if part == 2:
            stack.compact()
    return stack.read().select(F.col("start").cast("timestamp_ntz").alias("start"), "e", "counts", F.round("energy", 5).alias("energy"))
