"""Queries from observations to data sets: safe ranges, reduction, reflected regions, theta-squared and the light curve."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from photonlake.functions import sky, stats
from photonlake.jobs.datasets import RADIUS
from photonlake.jobs.selections import sep_sql
from photonlake.jobs.statistics import _LIMA, runs_with_responses
from photonlake.operators import crossmatch
from photonlake.operators import irf as I
from photonlake.operators import maps as M
from photonlake.operators import reduction as R
from photonlake.operators import selection as S
from photonlake.registry import query
from photonlake.sources import domain as D

E = 2.500013

_FROM = 0.1  # the first bin's background is integrated from here on
_AWAY = sep_sql("0.0", "0.0", "lon_pnt", "lat_pnt")
_RESP = (
    D.IRF_SQL
    + f"""
, rb as (select *, greatest(e_lo, {_FROM}::double) as x0, (e_lo + e_hi) / 2 as mid from (select *, i::int as e, i * {E}::double as e_lo, (i + 1) * {E}::double as e_hi, {_AWAY} as away from runs_irf, range(4) t(i))
), rm as (select *, {I.value_sql('aeff', 'mid', 'away')} as a, {I.value_sql('bias', 'mid', 'away')} as d from {I.placed_sql('rb', 'mid', 'away')}
), r0 as (select *, {I.value_sql('bkg', 'x0', 'away', log=True)} as y0 from {I.placed_sql('(select * exclude (ii, jj) from rm)', 'x0', 'away')}
), r1 as (select *, {I.value_sql('bkg', 'e_hi', 'away', log=True)} as y1 from {I.placed_sql('(select * exclude (ii, jj) from r0)', 'e_hi', 'away')}
), resp as (
  select obs_id, e, e_lo, e_hi, a as aeff, d as bias, {I.integral_sql('x0', 'y0', 'e_hi', 'y1')} as bkg, lo_thres, hi_thres from r1
), edge as (
  select *, max(aeff) over (partition by obs_id) as most, ln((e_lo + e_hi) / 2) as c, lead(bias) over w as nb, lead(ln((e_lo + e_hi) / 2)) over w as nc
  from resp window w as (partition by obs_id order by e)
), thr as (
  select obs_id, min(e_lo) filter (where aeff > 0.2::double * most) as area, max(exp(c + (bias - 0.1::double) / (bias - nb) * (nc - c))) filter (where bias > 0.1::double and nb <= 0.1::double) as crossing,
    min(bias) as least, exp(max(c)) as last, max_by(e_lo, (bkg, -e)) as peak from edge group by obs_id
), safe as (
  select r.obs_id, r.e, coalesce(e_lo >= lo_thres, true) and coalesce(e_hi <= hi_thres, true) as aeff_default, e_lo >= area as aeff_max,
    e_lo >= coalesce(crossing, case when least > 0.1::double then last else 0 end) as edisp_bias, e_lo >= peak as bkg_peak, bkg > 0 as bkg_invalid
  from resp r join thr using (obs_id)
)"""
)


def responses(runs):
    """The response of each run (with its node arrays) by energy bin, at the offset of the pointing from the source.

    Area and bias are those at the bin's center, the background is its rate over the bin.
    """
    away = sky.separation(0.0, 0.0, "lon_pnt", "lat_pnt")
    edges = [_FROM, *(E * i for i in range(1, 5))]
    mid = [(i * E + (i + 1) * E) / 2 for i in range(4)]
    values = [I.at_energies(F.col("aeff"), mid, away).alias("aeff"), I.at_energies(F.col("bias"), mid, away).alias("bias"), I.per_bin(F.col("bkg"), [_FROM, *(E * i for i in range(1, 5))], away).alias("bkg")]
    rows = runs.select("obs_id", "lo_thres", "hi_thres", F.posexplode(F.arrays_zip(*values)).alias("e", "b"))
    return rows.select("obs_id", "e", (F.col("e") * E).alias("e_lo"), ((F.col("e") + 1) * E).alias("e_hi"), "b.*", "lo_thres", "hi_thres")


def _safe(spark, sf):
    events = D.photons(spark, sf)
    return R.safe_bins(responses(runs_with_responses(spark, sf, D.observations(events))), ["obs_id"], aeff_percent=20.0)


def _by_method(method: str) -> None:
    @query(f"d5_{method}", _RESP + f" select obs_id, e, {method} as safe from safe", D.SQL)
    def one(spark, sf):
        return _safe(spark, sf).select("obs_id", "e", F.col(method).alias("safe"))


for _method in R.METHODS:
    _by_method(_method)

_ALL = " and ".join(R.METHODS)


@query("d5_safe_masks", _RESP + f" select event_id from photons join obs using (obs_id) join safe on safe.obs_id = photons.obs_id and safe.e = floor(energy / {E}::double) where {sep_sql('lon', 'lat', 'lon_pnt', 'lat_pnt')} < 1.20003 and {_ALL}", D.SQL)
def d5(spark, sf):
    """Events inside the offset limit and in bins that are safe by every method."""
    events = D.photons(spark, sf)
    obs = D.observations(events)
    placed = S.with_pointing(events, obs, "lon_pnt", "lat_pnt").withColumn("e", F.floor(F.col("energy") / E).cast("int"))
    near = placed.filter(sky.separation("lon", "lat", "lon_pnt", "lat_pnt") < 1.20003)
    return near.join(_safe(spark, sf).filter(_ALL).select("obs_id", "e"), ["obs_id", "e"], "left_semi").select("event_id")


_SOLID = "radians(0.5::double) * (sin(radians(py * 0.5::double - 1.75::double)) - sin(radians(py * 0.5::double - 2.25::double)))"
_D13 = _RESP + f"""
, ok as (select obs_id, e from safe where {_ALL}
), ev as (
  select floor((lon + 2.25013::double) / 0.5::double)::int as px, floor((lat + 2.25013::double) / 0.5::double)::int as py, ok.e, count(*) as n
  from photons join obs using (obs_id) join ok on ok.obs_id = photons.obs_id and ok.e = floor(energy / {E}::double)
  where {sep_sql('lon', 'lat', 'lon_pnt', 'lat_pnt')} < 1.00003 group by all
), pp as (
  select px, py, ok.e, livetime, ontime, away, en, off, aeff, bkg, (ok.e + 0.5::double) * {E}::double as mid, greatest(ok.e * {E}::double, {_FROM}::double) as x0, (ok.e + 1) * {E}::double as x1
  from (select x::int as px, y::int as py, x * 0.5::double - 2 as plon, y * 0.5::double - 2 as plat from range(9) a(x), range(9) b(y)) p
  join runs_irf o on {sep_sql('plon', 'plat', 'lon_pnt', 'lat_pnt')} < 1.00003 join ok using (obs_id), lateral (select {sep_sql('plon', 'plat', 'lon_pnt', 'lat_pnt')} as away)
), p1 as (select *, {I.value_sql('aeff', 'mid', 'away')} as a from {I.placed_sql('pp', 'mid', 'away')}
), p2 as (select *, {I.value_sql('bkg', 'x0', 'away', log=True)} as y0 from {I.placed_sql('(select * exclude (ii, jj) from p1)', 'x0', 'away')}
), p3 as (select *, {I.value_sql('bkg', 'x1', 'away', log=True)} as y1 from {I.placed_sql('(select * exclude (ii, jj) from p2)', 'x1', 'away')}
), ex as (select px, py, e, sum(a * livetime) / 1e6 as exposure, sum({I.integral_sql('x0', 'y0', 'x1', 'y1')} * ontime) as bg from p3 group by all)
select coalesce(ex.px, ev.px) as px, coalesce(ex.py, ev.py) as py, coalesce(ex.e, ev.e) as e, coalesce(n, 0)::bigint as counts, round(coalesce(exposure, 0), 4) as exposure,
  round(coalesce(bg, 0) * radians(0.5::double) * (sin(radians(coalesce(ex.py, ev.py) * 0.5::double - 1.75::double)) - sin(radians(coalesce(ex.py, ev.py) * 0.5::double - 2.25::double))), 4) as background, exposure is not null as mask_safe
from ex full join ev on ex.px = ev.px and ex.py = ev.py and ex.e = ev.e"""


@query("d13_reduce_observations", _D13, D.SQL)
def d13(spark, sf):
    """Counts, exposure and background of all runs on one map, each run inside its offset limit and its safe bins only, by its own response.

    A run's safe bins are an array on its row, so that a pixel meets a run once.
    """
    events = D.photons(spark, sf)
    obs = D.observations(events)
    responses_ = runs_with_responses(spark, sf, obs)
    safe = _safe(spark, sf).filter(_ALL).select("obs_id", "e")
    placed = S.with_pointing(events, obs, "lon_pnt", "lat_pnt").withColumn("e", F.floor(F.col("energy") / E).cast("int"))
    near = placed.filter(sky.separation("lon", "lat", "lon_pnt", "lat_pnt") < 1.00003).join(safe, ["obs_id", "e"], "left_semi")
    px, py = (F.floor((F.col(c) + 2.25013) / 0.5).cast("int") for c in ("lon", "lat"))
    counts = M.fill(near, {"px": px, "py": py, "e": F.col("e")}).withColumnRenamed("value", "counts")
    runs = responses_.join(safe.groupBy("obs_id").agg(F.collect_set("e").alias("safe")), "obs_id").withColumnsRenamed({"lon_pnt": "lon2", "lat_pnt": "lat2"})
    pixels = M.grid(spark, 9, 9).withColumn("lon", F.col("px") * 0.5 - 2).withColumn("lat", F.col("py") * 0.5 - 2)
    met = crossmatch.within(pixels, runs, 1.00003).withColumn("bg", I.per_bin(F.col("bkg"), [_FROM, *(E * i for i in range(1, 5))], F.col("separation")))
    areas = I.at_energies(F.col("aeff"), [(i + 0.5) * E for i in range(4)], F.col("separation"))
    met = met.select("px", "py", "livetime", "ontime", "safe", F.posexplode(F.arrays_zip(areas.alias("a"), F.col("bg").alias("b"))).alias("e", "v")).filter(F.array_contains("safe", F.col("e")))
    maps = met.groupBy("px", "py", "e").agg((F.sum(F.col("v.a") * F.col("livetime")) / 1e6).alias("exposure"), F.sum(F.col("v.b") * F.col("ontime")).alias("bg"))
    both = maps.join(counts, ["px", "py", "e"], "full_outer")
    lat = F.col("py") * 0.5 - 2
    solid = math.radians(0.5) * (F.sin(F.radians(lat + 0.25)) - F.sin(F.radians(lat - 0.25)))
    zero = F.lit(0.0)
    return both.select("px", "py", "e", F.coalesce("counts", F.lit(0)).cast("bigint").alias("counts"), F.round(F.coalesce("exposure", zero), 4).alias("exposure"), F.round(F.coalesce("bg", zero) * solid, 4).alias("background"), F.col("exposure").isNotNull().alias("mask_safe"))


_EX = (0.9, 0.3, 0.25)
_R = 0.2003
_D6 = f"""
, p as (select obs_id, lon_pnt, lat_pnt, 2 * asin({_R}::double / sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt)) as size from obs where sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt) > {_R}
), walk as (
  select obs_id, lon_pnt, lat_pnt, size, size + 0.1::double as angle, false as ok, 0.0::double as x, 0.0::double as y from p
  union all
  select obs_id, lon_pnt, lat_pnt, size, angle + case when clash then 0.1::double else size end, not clash, nx, ny from (
    select *, power(nx - {_EX[0]}, 2) + power(ny - {_EX[1]}, 2) < power({_R}::double + {_EX[2]}, 2) as clash from (
      select obs_id, lon_pnt, lat_pnt, size, angle, lon_pnt - cos(angle) * lon_pnt + sin(angle) * lat_pnt as nx, lat_pnt - sin(angle) * lon_pnt - cos(angle) * lat_pnt as ny
      from walk where angle < 2 * pi() - size - 0.1::double))
), regions as (select obs_id, x, y from walk where ok
), n as (select obs_id, count(*) as acceptance_off from regions group by obs_id
), ofs as (select obs_id, count(*) as counts_off from photons join regions using (obs_id) where power(lon - x, 2) + power(lat - y, 2) < {_R}::double * {_R}::double group by obs_id
), ons as (select obs_id, count(*) as counts from photons where lon * lon + lat * lat < {_R}::double * {_R}::double group by obs_id)"""
_RECURSIVE = D.SQL.replace("with photons", "with recursive photons", 1)


def _reflected(spark, sf):
    events = D.photons(spark, sf)
    return events, R.reflected(D.observations(events), _R, [_EX])


@query("d6_reflected_regions", _D6 + " select obs_id, round(x, 6) + 0.0::double as lon, round(y, 6) + 0.0::double as lat from regions", _RECURSIVE)
def d6_regions(spark, sf):
    """As many off regions as fit around each pointing beside an excluded circle."""
    spots = _reflected(spark, sf)[1].select("obs_id", F.explode("regions").alias("r"))
    return spots.select("obs_id", (F.round("r.x", 6) + 0.0).alias("lon"), (F.round("r.y", 6) + 0.0).alias("lat"))


@query("d6_reflected_counts", _D6 + f" select obs_id, coalesce(counts, 0)::bigint as counts, coalesce(counts_off, 0)::bigint as counts_off, 1.0::double as acceptance, coalesce(acceptance_off, 0)::double as acceptance_off, round(case when acceptance_off > 0 then coalesce(counts, 0) - coalesce(counts_off, 0) / acceptance_off::double end, 6) as excess from obs left join n using (obs_id) left join ofs using (obs_id) left join ons using (obs_id)", _RECURSIVE)
def d6_counts(spark, sf):
    """On and off counts of each run over all its reflected regions; a run without any has no excess."""
    events, regions = _reflected(spark, sf)
    c = R.on_off(events, regions, _R)
    excess = F.when(F.col("acceptance_off") > 0, F.col("counts") - F.col("counts_off") / F.nullif("acceptance_off", F.lit(0.0)))
    return c.withColumn("excess", F.round(excess, 6))


_THETA = f"""
, o as (select * from obs where sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt) > 0.4
), v as (select p.lon, p.lat, o.lon_pnt, o.lat_pnt, k from photons p join o using (obs_id), range(4) t(k)
), b as (
  select k, floor((power(lon - (lon_pnt - cos(k * pi() / 2) * lon_pnt + sin(k * pi() / 2) * lat_pnt), 2) + power(lat - (lat_pnt - sin(k * pi() / 2) * lon_pnt - cos(k * pi() / 2) * lat_pnt), 2)) / 0.0500007::double)::int as bin from v
), h as (select i::int as bin, (select count(*) from b where k = 0 and bin = i)::double as n, (select count(*) from b where k > 0 and bin = i)::double as o from range(6) r(i)
), r as (select count(*)::double as runs, sum(1.0::double / 3 * livetime) / sum(livetime) as a from o)
"""


@query("a19_theta_squared", _THETA + f"select bin, n::bigint as counts, o::bigint as counts_off, runs as acceptance, runs * 3 as acceptance_off, round(a, 7) as alpha, round(n - a * o, 6) as excess, round(case when n > 0 and o > 0 then sign(n - a * o) * sqrt(greatest({_LIMA}, 0)) end, 4) as sqrt_ts from h, r", D.SQL)
def a19(spark, sf):
    """Squared distances to the source and to three positions turned about each pointing, with the significance by bin."""
    events = D.photons(spark, sf)
    obs = D.observations(events).filter(F.sqrt(F.col("lon_pnt") * F.col("lon_pnt") + F.col("lat_pnt") * F.col("lat_pnt")) > 0.4)
    t = R.theta_squared(events, obs, [0.0500007 * i for i in range(7)], 3)
    c = stats.wstat_counts(F.col("counts"), F.col("counts_off"), F.col("alpha"))
    sure = (F.col("counts") > 0) & (F.col("counts_off") > 0)
    return t.select("bin", "counts", "counts_off", "acceptance", "acceptance_off", F.round("alpha", 7).alias("alpha"), F.round(c["excess"], 6).alias("excess"), F.round(F.when(sure, c["sqrt_ts"]), 4).alias("sqrt_ts"))


_T0, _WIDTH, _PART = 1704067200, 259200, 100000
_E5 = f"""{D.IRF_SQL}
, area as (select obs_id, {I.value_sql('aeff', '5.0::double', 'sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt)')} as area from {I.placed_sql('runs_irf', '5.0::double', 'sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt)')}
), sets as (
  select obs_id, floor(t_us / 1e6::double / {_PART}) as part, min(t_us)::double / 1e6::double as t0, max(t_us)::double / 1e6::double as t1,
    count(*) filter (where sqrt(lon * lon + lat * lat) < {RADIUS}) as n, count(*) filter (where sqrt(power(lon - 2 * lon_pnt, 2) + power(lat - 2 * lat_pnt, 2)) < {RADIUS}) as o,
    (max(t_us) - min(t_us))::double / 1e6::double * 0.95::double * area as x
  from photons join obs using (obs_id) join area using (obs_id) where sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt) > {RADIUS} and energy < 20 group by obs_id, part, lon_pnt, lat_pnt, area
), w as (select *, floor(((t0 + t1) / 2 - {_T0}) / {_WIDTH})::int as t_idx from sets
), s as (
  select t_idx, count(*) as n_sets, sum(n)::double as n, sum(o)::double as o, sum(x) as x, 1.0::double as a from w
  where t_idx between 0 and 9 and t0 >= {_T0} + t_idx * {_WIDTH} - 600 and t1 <= {_T0} + (t_idx + 1) * {_WIDTH} + 600 group by t_idx
)"""


@query("e5_light_curve", _E5 + f" select t_idx, n_sets::bigint as n_sets, n::bigint as counts, o::bigint as counts_off, round(x / 1e6, 6) as exposure, round((n - o) / x * 1e6, 5) as flux, round(sqrt(n + o) / x * 1e6, 5) as flux_err, round((greatest(n - o, 0) + 2 * sqrt(n + o)) / x * 1e6, 5) as flux_ul, round(case when n > 0 and o > 0 then sign(n - o) * sqrt(greatest({_LIMA}, 0)) end, 4) as sqrt_ts from s where x > 0", D.SQL)
def e5(spark, sf):
    """Data sets of parts of runs, stacked in bins of three days: flux in 1e-6 per area and second, its error, limit and significance."""
    events = D.photons(spark, sf).filter("energy < 20")
    away = F.sqrt(F.col("lon_pnt") * F.col("lon_pnt") + F.col("lat_pnt") * F.col("lat_pnt"))
    runs = runs_with_responses(spark, sf, D.observations(D.photons(spark, sf)).filter(away > RADIUS), ["aeff"]).withColumn("area", I.value(F.col("aeff"), F.lit(5.0), away))
    placed = S.with_pointing(events, runs, "lon_pnt", "lat_pnt", "area")
    on, off = sky.in_circle("lon", "lat", 0.0, 0.0, RADIUS), sky.in_circle("lon", "lat", F.col("lon_pnt") * 2, F.col("lat_pnt") * 2, RADIUS)
    part = F.floor(F.col("t_us") / 1e6 / _PART)
    sets = placed.groupBy("obs_id", part.alias("part"), "area").agg((F.min("t_us") / 1e6).alias("t0"), (F.max("t_us") / 1e6).alias("t1"), F.count_if(on).alias("counts"), F.count_if(off).alias("counts_off"))
    sets = sets.withColumn("exposure", (F.col("t1") - F.col("t0")) * D.LIVE_FRACTION * F.col("area"))
    s = R.light_curve(sets, _T0, _WIDTH, 10, 600.0).filter("exposure > 0")
    c = stats.wstat_counts(F.col("counts"), F.col("counts_off"), F.lit(1.0))
    per = lambda x: F.round(x / F.col("exposure") * 1e6, 5)
    sure = (F.col("counts") > 0) & (F.col("counts_off") > 0)
    return s.select("t_idx", "n_sets", "counts", "counts_off", F.round(F.col("exposure") / 1e6, 6).alias("exposure"), per(c["excess"]).alias("flux"), per(c["error"]).alias("flux_err"), per(F.greatest(c["excess"], F.lit(0.0)) + 2 * c["error"]).alias("flux_ul"), F.round(F.when(sure, c["sqrt_ts"]), 4).alias("sqrt_ts"))
