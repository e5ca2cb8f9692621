"""Queries on data sets: background estimation, stacking, folding, significance maps, and the flagship job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from photonlake.functions import sky, stats
from photonlake.jobs.selections import sep_sql
from photonlake.operators import datasets as DS
from photonlake.operators import reproject as RP
from photonlake.operators import maps as M
from photonlake.operators import selection as S
from photonlake.registry import query
from photonlake.sources import domain as D

#: Data sets per run and energy bin: on counts in a circle, off counts in its mirror about the pointing.
RADIUS = 0.30003
E_BIN = 2.500013
E_MAX = 11


def wstat_sql(n: str, o: str, a: str, mu: str) -> str:
    c = f"({a} * ({n} + {o}) - (1 + {a}) * {mu})"
    b = f"(({c} + sqrt({c} * {c} + 4 * {a} * ({a} + 1) * {o} * {mu})) / (2 * {a} * ({a} + 1)))"
    term = lambda x, y: f"case when {x} > 0 then {x} * ln({y}) else 0 end"
    perfect = f"(case when {n} > 0 then {n} * (1 - ln({n})) else 0 end + case when {o} > 0 then {o} * (1 - ln({o})) else 0 end)"
    return f"(2 * (({mu} + (1 + {a}) * {b} - {term(n, f'({mu} + {a} * {b})')} - {term(o, b)}) - {perfect}))"


_RUN_BINS = f"""
, d as (
  select obs_id, floor(energy / {E_BIN}::double)::int as e, sqrt(lon * lon + lat * lat) as r_on,
    sqrt(power(lon - 2 * lon_pnt, 2) + power(lat - 2 * lat_pnt, 2)) as r_off, lon_pnt, lat_pnt, livetime from photons join obs using (obs_id)
  where sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt) > {RADIUS}
), runs as (
  select obs_id, e, count(*) filter (where r_on < {RADIUS})::bigint as counts, count(*) filter (where r_off < {RADIUS})::bigint as counts_off
  from d where e between 0 and {E_MAX} and (r_on < {RADIUS} or r_off < {RADIUS}) group by obs_id, e
)"""


def run_bins(spark, sf):
    """(obs_id, e, counts, counts_off): on and mirrored off counts per run, for runs that point beside the region."""
    events = D.photons(spark, sf)
    obs = D.observations(events).filter(F.sqrt(F.col("lon_pnt") * F.col("lon_pnt") + F.col("lat_pnt") * F.col("lat_pnt")) > RADIUS)
    placed = S.with_pointing(events, obs, "lon_pnt", "lat_pnt")
    on = sky.in_circle("lon", "lat", 0.0, 0.0, RADIUS)
    off = sky.in_circle("lon", "lat", F.col("lon_pnt") * 2, F.col("lat_pnt") * 2, RADIUS)
    e = F.floor(F.col("energy") / E_BIN).cast("int")
    kept = placed.filter(on | off).withColumn("e", e).filter(F.col("e").between(0, E_MAX))
    return kept.groupBy("obs_id", "e").agg(F.count_if(on).alias("counts"), F.count_if(off).alias("counts_off"))


_TS = f"({wstat_sql('n', 'o', '1.0::double', '0.0::double')} - {wstat_sql('n', 'o', '1.0::double', '(n - o)')})"


@query("slice_zero_significance", _RUN_BINS + f", s as (select e, sum(counts)::double as n, sum(counts_off)::double as o from runs group by e) select e, n::bigint as counts, o::bigint as counts_off, round(n - o, 6) as excess, round(sqrt(n + o), 6) as error, round(sign(n - o) * sqrt(greatest({wstat_sql('n', 'o', '1.0::double', '0.0::double')} - case when n >= o then {wstat_sql('n', 'o', '1.0::double', '(case when n >= o then n - o else 0.0 end)')} else 2 * (n - n * case when n > 0 then ln(n) else 0 end + o - o * case when o > 0 then ln(o) else 0 end - (case when n > 0 then n * (1 - ln(n)) else 0 end + case when o > 0 then o * (1 - ln(o)) else 0 end)) end, 0)), 5) as sqrt_ts from s", D.SQL)
def slice_zero(spark, sf):
    """Significance per energy bin of the on region over the mirrored off region, all runs stacked."""
    s = run_bins(spark, sf).groupBy("e").agg(F.sum("counts").alias("counts"), F.sum("counts_off").alias("counts_off"))
    w = stats.wstat_counts(F.col("counts"), F.col("counts_off"), F.lit(1.0))
    return s.select("e", "counts", "counts_off", F.round(w["excess"], 6).alias("excess"), F.round(w["error"], 6).alias("error"), F.round(w["sqrt_ts"], 5).alias("sqrt_ts"))


@query("j7_on_off_events", f"select event_id, case when sqrt(lon * lon + lat * lat) < {RADIUS} then 0 else k end::int as region from photons join obs using (obs_id), (values (1), (2), (3)) v(k) where sqrt(power(lon - (lon_pnt + cos(k * pi() / 2) * -lon_pnt - sin(k * pi() / 2) * -lat_pnt), 2) + power(lat - (lat_pnt + sin(k * pi() / 2) * -lon_pnt + cos(k * pi() / 2) * -lat_pnt), 2)) < 0.2003", D.SQL)
def j7(spark, sf):
    """Events of the regions that turn about the pointing by quarters: a run's few regions meet its events by obs_id."""
    events = D.photons(spark, sf)
    obs = D.observations(events)
    t = F.col("k") * F.pi() / 2
    regions = obs.select("obs_id", "lon_pnt", "lat_pnt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    x = F.col("lon_pnt") - F.cos(t) * F.col("lon_pnt") + F.sin(t) * F.col("lat_pnt")
    y = F.col("lat_pnt") - F.sin(t) * F.col("lon_pnt") - F.cos(t) * F.col("lat_pnt")
    met = events.join(regions.select("obs_id", "k", x.alias("x"), y.alias("y")), "obs_id").filter(sky.in_circle("lon", "lat", "x", "y", 0.2003))
    return met.select("event_id", F.when(sky.in_circle("lon", "lat", 0.0, 0.0, RADIUS), 0).otherwise(F.col("k")).alias("region"))


_SETS = """
, sets as (
  select (obs_id % 4)::int as dataset, px, py, e, count(*)::bigint as counts, 0.5::double + (px % 3) as background, (px + py + obs_id % 4) % 5 <> 0 as mask_safe
  from (select obs_id, floor((lon + 2.0005::double) / 0.4::double)::int as px, floor((lat + 2.0005::double) / 0.4::double)::int as py, floor(energy / 2.500013::double)::int as e from photons)
  where e between 0 and 3 group by all
)"""


def _sets(spark, sf):
    """Four data sets of runs by their number, on coarse pixels."""
    px, py = (F.floor((F.col(c) + 2.0005) / 0.4).cast("int") for c in ("lon", "lat"))
    e = F.floor(F.col("energy") / 2.500013).cast("int")
    b = D.photons(spark, sf).select((F.col("obs_id") % 4).cast("int").alias("dataset"), px.alias("px"), py.alias("py"), e.alias("e")).filter("e between 0 and 3")
    b = b.groupBy("dataset", "px", "py", "e").agg(F.count("*").alias("counts"))
    return b.withColumn("background", F.lit(0.5) + F.col("px") % 3).withColumn("mask_safe", (F.col("px") + F.col("py") + F.col("dataset")) % 5 != 0)


@query("d1_stack_maps", _SETS + " select px, py, sum(counts * background)::double as value from sets group by all", D.SQL)
def d1(spark, sf):
    return DS.stack_maps(_sets(spark, sf).withColumnRenamed("counts", "value"), ["px", "py"], "background")


@query("d2_stack_datasets", _SETS + " select px, py, e, sum(case when mask_safe then counts else 0 end)::bigint as counts, sum(case when mask_safe then background else 0 end)::double as background, bool_or(mask_safe) as mask_safe from sets group by all", D.SQL)
def d2(spark, sf):
    return DS.stack(_sets(spark, sf), ["px", "py", "e"])


_WHOLE = (
    _SETS
    + """, image as (select dataset, px, py, bool_or(mask_safe) as safe from sets group by all
), ex as (select dataset, px, py, t::int as e_true, (1 + dataset + px + 0.5::double * t) as exposure from (select distinct dataset, px, py from sets), range(3) r(t)
), live as (select (obs_id % 4)::int as dataset, sum(livetime) as livetime from obs group by 1)"""
)


def _whole(spark, sf):
    """The four data sets with exposures in three true energies, live times and intervals."""
    sets = _sets(spark, sf)
    energies = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e_true")
    exposure = sets.select("dataset", "px", "py").distinct().select("dataset", "px", "py", energies).withColumn("exposure", 1 + F.col("dataset") + F.col("px") + 0.5 * F.col("e_true"))
    of = (F.col("obs_id") % 4).cast("int").alias("dataset")
    live = D.observations(D.photons(spark, sf)).groupBy(of).agg(F.sum("livetime").alias("livetime"))
    return DS.stack_whole(sets, ["px", "py"], "e", exposure, "e_true", live, D.intervals(spark, sf).select(of, "start", "stop"))


@query("d2_stack_exposure", _WHOLE + " select px, py, e_true, sum(case when safe then exposure else 0 end) as exposure from ex join image using (dataset, px, py) group by all", D.SQL)
def d2_exposure(spark, sf):
    return _whole(spark, sf)["exposure"]


@query("d2_stack_livetime", _WHOLE + " select round(sum(livetime), 4) as livetime, count(*)::bigint as n_sets from live where dataset in (select dataset from sets where mask_safe)", D.SQL)
def d2_livetime(spark, sf):
    return _whole(spark, sf)["livetime"].withColumn("livetime", F.round("livetime", 4))


@query("d2_stack_intervals", _WHOLE + ", g as (select * from gti where (obs_id % 4)::int in (select dataset from sets where mask_safe)), m as (select start, stop, max(stop) over (order by start, stop rows between unbounded preceding and 1 preceding) as reach from g), k as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (order by start, stop rows between unbounded preceding and current row) as island from m) select min(start) as start, max(stop) as stop from k group by island", D.SQL)
def d2_intervals(spark, sf):
    return _whole(spark, sf)["intervals"]


_ONOFF = _RUN_BINS + ", oo as (select obs_id, e, counts, counts_off, 1.0::double + (obs_id % 3) as acceptance, 2.0::double + (obs_id % 5) as acceptance_off, (obs_id + e) % 6 <> 0 as mask_safe from runs)"


def _on_off(spark, sf):
    return run_bins(spark, sf).withColumn("acceptance", F.lit(1.0) + F.col("obs_id") % 3).withColumn("acceptance_off", F.lit(2.0) + F.col("obs_id") % 5).withColumn("mask_safe", (F.col("obs_id") + F.col("e")) % 6 != 0)


@query("d3_stack_on_off", _ONOFF + ", b as (select e, sum(counts) as n, sum(counts_off) as o, sum(acceptance) as a, sum(acceptance / acceptance_off * counts_off) as bg from oo where mask_safe group by e), m as (select sum(bg) / sum(o) as mean from b) select e, n::bigint as counts, o::bigint as counts_off, round(a, 6) as acceptance, round(case when o > 0 then a * o / bg else a / mean end, 6) as acceptance_off, round(bg, 6) as background from b, m", D.SQL)
def d3(spark, sf):
    s = DS.stack_on_off(_on_off(spark, sf), ["e"])
    return s.select("e", "counts", "counts_off", *[F.round(c, 6).alias(c) for c in ("acceptance", "acceptance_off", "background")])


@query("d4_stack_responses", "select floor(energy / 2.500013::double)::int as e, round(sum(phase * livetime) / sum(livetime), 7) as value from photons join obs using (obs_id) group by all", D.SQL)
def d4(spark, sf):
    events = D.photons(spark, sf)
    met = events.join(D.observations(events).select("obs_id", "livetime"), "obs_id").withColumn("e", F.floor(F.col("energy") / 2.500013).cast("int"))
    return DS.weighted_mean(met.withColumnRenamed("phase", "value"), ["e"], "value", "livetime").select("e", F.round("value", 7).alias("value"))


@query("d6_wobble_regions", f"select obs_id, k::int as region, round(lon_pnt + cos(k * pi() / 2) * -lon_pnt - sin(k * pi() / 2) * -lat_pnt, 6) + 0.0::double as lon, round(lat_pnt + sin(k * pi() / 2) * -lon_pnt + cos(k * pi() / 2) * -lat_pnt, 6) + 0.0::double as lat from obs, (values (1), (2), (3)) v(k) where sqrt(lon_pnt * lon_pnt + lat_pnt * lat_pnt) * sqrt(2) > 2 * 0.2003 and not (lon_pnt + cos(k * pi() / 2) * -lon_pnt - sin(k * pi() / 2) * -lat_pnt > 1.4 )", D.SQL)
def d6(spark, sf):
    """Off regions at quarter turns, dropped where they would overlap each other or lie in the excluded strip lon > 1.4."""
    obs = D.observations(D.photons(spark, sf))
    far = F.sqrt(F.col("lon_pnt") * F.col("lon_pnt") + F.col("lat_pnt") * F.col("lat_pnt"))
    t = F.col("k") * F.pi() / 2
    r = obs.filter(far * F.sqrt(F.lit(2.0)) > 2 * 0.2003).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    x = F.col("lon_pnt") - F.cos(t) * F.col("lon_pnt") + F.sin(t) * F.col("lat_pnt")
    y = F.col("lat_pnt") - F.sin(t) * F.col("lon_pnt") - F.cos(t) * F.col("lat_pnt")
    return r.filter(~(x > 1.4)).select("obs_id", F.col("k").alias("region"), (F.round(x, 6) + 0.0).alias("lon"), (F.round(y, 6) + 0.0).alias("lat"))


@query("d7_phase_background", "select obs_id, count(*) filter (where phase >= 0.195 and phase < 0.305)::bigint as counts, count(*) filter (where phase >= 0.895 or phase < 0.095)::bigint as counts_off, 0.11::double as acceptance, 0.2::double as acceptance_off from photons group by obs_id", D.SQL)
def d7(spark, sf):
    on, off = [(0.195, 0.305)], [(0.895, 0.095)]
    in_ = lambda w: F.expr(" or ".join(f"(phase >= {a} and phase < {b})" for a, b in S.phase_windows(w)))
    g = D.photons(spark, sf).groupBy("obs_id").agg(F.count_if(in_(on)).alias("counts"), F.count_if(in_(off)).alias("counts_off"))
    return g.withColumn("acceptance", F.lit(round(S.live_fraction(on), 9))).withColumn("acceptance_off", F.lit(round(S.live_fraction(off), 9)))


def _ring_sql(lo: float, hi: float) -> str:
    return f"(select i, j from range(-{int(hi)}, {int(hi) + 1}) a(i), range(-{int(hi)}, {int(hi) + 1}) b(j) where i * i + j * j >= {lo * lo} and i * i + j * j <= {hi * hi})"


_FULL = ", g as (select x::int as px, y::int as py, coalesce(counts, 0)::bigint as counts, sqrt(power(x - 20, 2) + power(y - 20, 2)) < 3 as excl from range(41) a(x) cross join range(41) b(y) left join img on px = x and py = y)"


def _full(spark, sf):
    """Every pixel with its counts and whether it is excluded from backgrounds."""
    image = D.image(D.counts_map(D.photons(spark, sf)))
    excluded = F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2)) < 3
    return M.grid(spark, 41, 41).join(image, ["px", "py"], "left").select("px", "py", F.coalesce("counts", F.lit(0)).cast("bigint").alias("counts"), excluded.alias("excl"))


def _ring(full, inner, width):
    """Counts and acceptance of each pixel's ring, in one scatter."""
    return M.convolve_sums(full.filter("not excl"), M.ring(inner, width), {"counts_off": F.col("counts"), "acceptance_off": F.lit(1)}, (41, 41))


@query("d8_ring_background", _FULL + f", r as (select px + i as px, py + j as py, sum(counts) as o, count(*) as a from g, {_ring_sql(4, 6)} where not excl group by all) select g.px, g.py, coalesce(o, 0)::bigint as counts_off, round(1.0::double / a, 7) as alpha, round(o::double / a, 7) as background from g left join r using (px, py)", D.SQL)
def d8(spark, sf):
    full = _full(spark, sf)
    out = DS.ring_background(full.withColumn("acceptance", F.lit(1.0)), _ring(full, 4, 2), ["px", "py"])
    return out.select("px", "py", F.coalesce("counts_off", F.lit(0)).cast("bigint").alias("counts_off"), F.round("alpha", 7).alias("alpha"), F.round("background", 7).alias("background"))


@query("d9_adaptive_ring", _FULL + ", " + ", ".join(f"r{k} as (select px + i as px, py + j as py, sum(counts) as o, count(*) as a from g, {_ring_sql(k, k + 2)} where not excl group by all)" for k in (3, 4, 5)) + " select g.px, g.py, case when 1.0 / r3.a <= 0.025 then 3 when 1.0 / r4.a <= 0.025 then 4 when 1.0 / r5.a <= 0.025 then 5 end::int as inner, case when 1.0 / r3.a <= 0.025 then r3.o when 1.0 / r4.a <= 0.025 then r4.o when 1.0 / r5.a <= 0.025 then r5.o end::bigint as counts_off from g left join r3 using (px, py) left join r4 using (px, py) left join r5 using (px, py)".replace(" as inner", " as inner_radius"), D.SQL)
def d9(spark, sf):
    full, rings = _full(spark, sf), None
    for k in (3, 4, 5):
        one = _ring(full, k, 2).select("px", "py", F.lit(k).alias("k"), "counts_off", "acceptance_off")
        rings = one if rings is None else rings.union(one)
    first = rings.filter(1.0 / F.col("acceptance_off") <= 0.025).groupBy("px", "py").agg(F.min(F.struct("k", "counts_off")).alias("m"))
    return full.join(first, ["px", "py"], "left").select("px", "py", F.col("m.k").alias("inner_radius"), F.col("m.counts_off").cast("bigint").alias("counts_off"))


@query("d10_field_of_view", _SETS + " select dataset, round(sum(counts)::double / sum(background), 7) as scale, round(sqrt(sum(counts)::double) / sum(background), 7) as scale_err from sets where not (px between 4 and 6 and py between 4 and 6) group by dataset", D.SQL)
def d10(spark, sf):
    s = _sets(spark, sf).withColumn("excluded", F.expr("px between 4 and 6 and py between 4 and 6"))
    return DS.field_of_view_scale(s, "dataset").select("dataset", F.round("scale", 7).alias("scale"), F.round("scale_err", 7).alias("scale_err"))


@query("d11_exclusion_mask", " select px, py, counts::bigint as counts, not (sqrt(power(px - 20, 2) + power(py - 20, 2)) < 5.5 or (abs(px - 10) < 3 and abs(py - 30) < 2)) as mask from img", D.SQL)
def d11(spark, sf):
    """Pixels of the counts map with whether they may serve for backgrounds."""
    inside = sky.in_circle("px", "py", 20.0, 20.0, 5.5) | sky.in_rectangle("px", "py", 10.0, 30.0, 6.0, 4.0)
    return D.image(D.counts_map(D.photons(spark, sf))).withColumn("mask", ~inside)


@query("d12_cumulative_info", _SETS + ", t as (select dataset, sum(case when mask_safe then counts else 0 end) as n, sum(case when mask_safe then background else 0 end) as b from sets group by dataset) select dataset, sum(n) over (order by dataset)::bigint as counts, round(sum(b) over (order by dataset), 5) as background, round((sum(n) over (order by dataset))::double - sum(b) over (order by dataset), 5) as excess from t", D.SQL)
def d12(spark, sf):
    t = _sets(spark, sf).filter("mask_safe").groupBy("dataset").agg(F.sum("counts").alias("n"), F.sum("background").alias("b"))
    w = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)
    out = t.withColumn("counts", F.sum("n").over(w)).withColumn("bg", F.sum("b").over(w))
    return out.select("dataset", "counts", F.round("bg", 5).alias("background"), F.round(F.col("counts") - F.col("bg"), 5).alias("excess"))


@query("d14_residuals", _SETS + " select dataset, px, py, e, round(counts - background, 6) as diff, round((counts - background) / background, 6) as relative, round((counts - background) / sqrt(background), 6) as scaled from sets", D.SQL)
def d14(spark, sf):
    r = DS.residuals(F.col("counts"), F.col("background"))
    return _sets(spark, sf).select("dataset", "px", "py", "e", *[F.round(c, 6).alias(n) for n, c in r.items()])


@query("d15_to_spectrum", _SETS + " select dataset, e, sum(counts)::bigint as counts, sum(background)::double as background from sets where px between 3 and 7 and mask_safe group by all", D.SQL)
def d15(spark, sf):
    return _sets(spark, sf).filter("px between 3 and 7 and mask_safe").groupBy("dataset", "e").agg(F.sum("counts").alias("counts"), F.sum("background").alias("background"))


@query("d15_to_image", _SETS + " select dataset, px, py, sum(case when mask_safe then counts else 0 end)::bigint as counts, sum(case when mask_safe then background else 0 end)::double as background, bool_or(mask_safe) as mask_safe from sets where e between 1 and 2 and px between 2 and 8 group by all", D.SQL)
def d15_image(spark, sf):
    """Cut out, sliced in energy and summed over it, where safe."""
    return DS.stack(_sets(spark, sf).filter("e between 1 and 2 and px between 2 and 8"), ["dataset", "px", "py"])


_DISP = ", disp as (select a::int as e_true, b::int as e_reco, case when a = b then 0.6 when abs(a - b) = 1 then 0.2 else 0.0 end::double as p from range(4) x(a), range(4) y(b))"


def _dispersion(spark):
    p = F.when(F.col("e_true") == F.col("e_reco"), 0.6).when(F.abs(F.col("e_true") - F.col("e_reco")) == 1, 0.2).otherwise(0.0)
    return spark.range(16).select((F.col("id") % 4).cast("int").alias("e_true"), F.floor(F.col("id") / 4).cast("int").alias("e_reco")).withColumn("p", p)


@query("d16_fold", _DISP + " select px, py, e_reco, round(sum(counts * p), 6) as value from cube join disp on e = e_true group by all having sum(counts * p) > 0", D.SQL)
def d16(spark, sf):
    true = D.counts_map(D.photons(spark, sf)).select("px", "py", F.col("e").alias("e_true"), F.col("counts").alias("value"))
    return DS.fold(true, _dispersion(spark).filter("p > 0"), ["px", "py"]).select("px", "py", "e_reco", F.round("value", 6).alias("value"))


@query("d17_predicted_counts", _DISP + ", live as (select sum(livetime) as t from obs), m as (select i::int as e_true, sum(amplitude * 1e-9::double * (power(i + 0.5::double, 1 - index) - power(i + 1.5::double, 1 - index)) / (index - 1)) as f from sources, range(4) t(i) group by i), n as (select e_reco as e, sum(f * (e_true + 1) * t * p) as v from m join disp using (e_true), live group by e_reco), b as (select e, sum(counts) * 0.3::double - 60 as b from cube group by e) select e, round(v, 5) as sources, round(b, 5) as background, round(greatest(v + b, 0), 5) as npred from n join b using (e)", D.SQL)
def d17(spark, sf):
    """All catalog sources through exposure and dispersion, and the background: summed and not below zero."""
    events = D.photons(spark, sf)
    live = D.observations(events).agg(F.sum("livetime").alias("t"))
    e, g = F.col("e_true"), F.col("index")
    flux = F.col("amplitude") * 1e-9 * (F.pow(e + 0.5, 1 - g) - F.pow(e + 1.5, 1 - g)) / (g - 1)
    bins = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e_true")
    true = D.catalog(spark, sf).select("index", "amplitude", bins).groupBy("e_true").agg(F.sum(flux).alias("f")).crossJoin(F.broadcast(live))
    folded = DS.fold(true.select("e_true", (F.col("f") * (e + 1) * F.col("t")).alias("value")), _dispersion(spark), []).select(F.col("e_reco").alias("e"), F.col("value").alias("v"))
    background = D.counts_map(events).groupBy("e").agg((F.sum("counts") * 0.3 - 60).alias("b"))
    return folded.join(background, "e").select("e", F.round("v", 5).alias("sources"), F.round("b", 5).alias("background"), F.round(F.greatest(F.col("v") + F.col("b"), F.lit(0.0)), 5).alias("npred"))


_PLANE = RP.Plane("car", 0.0, 0.0, 0.1, 0.1, 19.505, 19.505, 41, 41)
_SIGMAS = {(e, o): 1.4 - 0.2 * e + 0.35 * o for e in range(4) for o in range(4)}
_D17 = (
    _DISP
    + f""", live as (select sum(livetime) as t from obs), kern as (
  select e_true, ob, dx, dy, w / sum(w) over (partition by e_true, ob) as p from (
    select e::int as e_true, o::int as ob, i::int as dx, j::int as dy, exp(-(i * i + j * j) / (2 * power(1.4::double - 0.2::double * e + 0.35::double * o, 2))) as w from range(4) a(e), range(4) b(o), range(-4, 5) c(i), range(-4, 5) d(j))
), fs as (
  select i::int as e_true, ((source_id * 7919) % 4001)::double / 1000 - 2 as slon, ((source_id * 104729) % 4001)::double / 1000 - 2 as slat,
    amplitude * 1e-9::double * (power(i + 0.5::double, 1 - index) - power(i + 1.5::double, 1 - index)) / (index - 1) as flux from sources, range(4) t(i)
), spot as (
  select e_true, flux, floor(slon / 0.1::double + 19.505::double + 0.5)::int as px, floor(slat / 0.1::double + 19.505::double + 0.5)::int as py, floor({sep_sql('slon', 'slat', '0.0', '0.0')} / 0.80007::double)::int as ob from fs
), sp as (
  select a.px + dx as px, a.py + dy as py, e_true, sum(flux * t * (e_true + 1) * (1 + 0.002::double * a.px) * p) as n from spot a join kern using (e_true, ob), live
  where a.px between 0 and 40 and a.py between 0 and 40 and a.px + dx between 0 and 40 and a.py + dy between 0 and 40 group by 1, 2, 3
), pr as (
  select px, py, e_reco as e, n * p as v from sp join disp using (e_true) union all select px, py, e, counts * 0.3::double - 0.5::double from cube
) select px, py, e, round(greatest(sum(v), 0), 5) as npred from pr group by px, py, e"""
)


@query("d17_predicted_map", _D17, D.SQL)
def d17_map(spark, sf):
    """Counts by pixel and energy: each source with the exposure of its pixel, a point spread of its energy and distance, the dispersion, and the background."""
    events = D.photons(spark, sf)
    live = D.observations(events).agg(F.sum("livetime").alias("t"))
    e, g, k = F.col("e_true"), F.col("index"), F.col("source_id")
    flux = F.col("amplitude") * 1e-9 * (F.pow(e + 0.5, 1 - g) - F.pow(e + 1.5, 1 - g)) / (g - 1)
    lon, lat = F.pmod(k * 7919, F.lit(4001)) / 1000 - 2, F.pmod(k * 104729, F.lit(4001)) / 1000 - 2
    sources = D.catalog(spark, sf).select("source_id", "index", "amplitude", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e_true")).select(lon.alias("lon"), lat.alias("lat"), "e_true", flux.alias("flux"))
    pixels = M.grid(spark, 41, 41).withColumn("e_true", F.explode(F.sequence(F.lit(0), F.lit(3))))
    exposure = pixels.crossJoin(F.broadcast(live)).select("px", "py", "e_true", (F.col("t") * (e + 1) * (1 + 0.002 * F.col("px"))).alias("exposure"))
    background = D.counts_map(events).select("px", "py", "e", (F.col("counts") * 0.3 - 0.5).alias("value"))
    kernel = RP.gaussian_kernels(spark, _SIGMAS, 4)
    return RP.predict(sources, _PLANE, exposure, kernel, _dispersion(spark), background, 0.80007).withColumn("npred", F.round("npred", 5))


@query("d18_reco_exposure", _DISP + " select e_reco, round(sum(p * counts * (e_true + 1) * 100) / sum(p * counts), 6) as exposure from disp join cube on e = e_true group by e_reco", D.SQL)
def d18(spark, sf):
    """Exposure in reconstructed energy: the mean over true energies, weighted by their counts and the dispersion."""
    spectrum = D.counts_map(D.photons(spark, sf)).groupBy(F.col("e").alias("e_true")).agg(F.sum("counts").alias("n"))
    w = F.col("p") * F.col("n")
    return spectrum.join(F.broadcast(_dispersion(spark)), "e_true").groupBy("e_reco").agg(F.round(F.sum(w * (F.col("e_true") + 1) * 100) / F.sum(w), 6).alias("exposure"))


@query("d19_energy_range", _SETS + " select px, py, min(e) filter (where mask_safe) as e_min, max(e) filter (where mask_safe) as e_max from sets group by all", D.SQL)
def d19(spark, sf):
    safe = F.when(F.col("mask_safe"), F.col("e"))
    return _sets(spark, sf).groupBy("px", "py").agg(F.min(safe).alias("e_min"), F.max(safe).alias("e_max"))


@query("d20_to_masked", _SETS + " select dataset, px, py, e, case when mask_safe then counts else 0 end::bigint as counts from sets", D.SQL)
def d20(spark, sf):
    return _sets(spark, sf).select("dataset", "px", "py", "e", F.when(F.col("mask_safe"), F.col("counts")).otherwise(0).alias("counts"))


_E1 = _FULL + ", c as (select px + i as px, py + j as py, sum(counts) as n from g, (select i, j from range(-2, 3) a(i), range(-2, 3) b(j) where i * i + j * j <= 4) group by all), r as (select px + i as px, py + j as py, sum(counts)::double / count(*) as b from g, " + _ring_sql(5, 7) + " where not excl group by all)"


@query("e1_excess_map", _E1 + " select px, py, n::bigint as counts, round(n - b * 13, 5) as excess, round(sign(n - b * 13) * sqrt(2 * greatest(b * 13 - n + case when n > 0 then n * ln(n / (b * 13)) else 0 end, 0)), 4) as sqrt_ts from c join r using (px, py) where px between 0 and 40 and py between 0 and 40 and b > 0", D.SQL)
def e1(spark, sf):
    """Counts in a disk of two pixels against a background of rings, by the Cash statistic."""
    full = _full(spark, sf)
    disk = M.convolve(full.select("px", "py", F.col("counts").alias("value")), M.disk(2), bounds=(41, 41))
    n = full.select("px", "py").join(disk, ["px", "py"], "left").select("px", "py", F.coalesce("value", F.lit(0)).cast("bigint").alias("counts"))
    ring = _ring(full, 5, 2).withColumn("b", F.col("counts_off") / F.col("acceptance_off") * 13).filter("b > 0")
    c = stats.cash_counts(F.col("counts"), F.col("b"))
    return n.join(ring, ["px", "py"]).select(F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"), "counts", F.round(c["excess"], 5).alias("excess"), F.round(c["sqrt_ts"], 4).alias("sqrt_ts"))


@query("e13_excess_by_energy", _SETS + ", s as (select px, py, case when e < 2 then 0 else 1 end::int as band, sum(counts) as n, sum(background) as b from sets group by all) select px, py, band, n::bigint as counts, round(n - b, 5) as excess, round(sqrt(n::double), 6) as error from s", D.SQL)
def e13(spark, sf):
    s = _sets(spark, sf).groupBy("px", "py", F.when(F.col("e") < 2, 0).otherwise(1).alias("band")).agg(F.sum("counts").alias("counts"), F.sum("background").alias("b"))
    c = stats.cash_counts(F.col("counts"), F.col("b"))
    return s.select("px", "py", "band", "counts", F.round(c["excess"], 5).alias("excess"), F.round(c["error"], 6).alias("error"))


@query("m9_adaptive_smoothing", _FULL + ", b as (select avg(counts) as m from g), " + ", ".join(f"s{k} as (select px + i as px, py + j as py, sum(counts)::double as c, count(*) as a from g, (select i, j from range(-{k}, {k + 1}) a(i), range(-{k}, {k + 1}) b(j) where i * i + j * j <= {k * k}) group by all)" for k in (1, 2, 3)) + ", h as (select g.px, g.py, " + ", ".join(f"s{k}.c as c{k}, s{k}.a as a{k}, (s{k}.c - m * s{k}.a) / sqrt(s{k}.c + m * s{k}.a) as z{k}" for k in (1, 2, 3)) + " , g.counts from g join s1 using (px, py) join s2 using (px, py) join s3 using (px, py), b) select px, py, case when z1 >= 1.5 then 1 when z2 >= 1.5 then 2 when z3 >= 1.5 then 3 end::int as scale, round(coalesce(case when z1 >= 1.5 then c1 / a1 when z2 >= 1.5 then c2 / a2 when z3 >= 1.5 then c3 / a3 end, avg(case when not coalesce(z1 >= 1.5 or z2 >= 1.5 or z3 >= 1.5, false) then counts end) over ()), 6) as value from h", D.SQL)
def m9(spark, sf):
    """The mean over the smallest disk whose counts stand out from the mean background; where none does, the mean of such pixels."""
    full = _full(spark, sf)
    mean = full.agg(F.avg("counts").alias("m"))
    found = None
    for k in (1, 2, 3):
        one = M.convolve_sums(full, M.disk(k), {"c": F.col("counts"), "a": F.lit(1)}, (41, 41)).withColumn("scale", F.lit(k))
        found = one if found is None else found.union(one)
    z = (F.col("c") - F.col("m") * F.col("a")) / F.sqrt(F.col("c") + F.col("m") * F.col("a"))
    first = found.crossJoin(F.broadcast(mean)).filter(z >= 1.5).groupBy("px", "py").agg(F.min(F.struct("scale", (F.col("c") / F.col("a")).alias("v"))).alias("f"))
    placed = full.select("px", "py", "counts").join(first, ["px", "py"], "left")
    rest = placed.filter("f is null").agg(F.avg("counts").alias("rest"))
    return placed.crossJoin(F.broadcast(rest)).select("px", "py", F.col("f.scale").alias("scale"), F.round(F.coalesce("f.v", "rest"), 6).alias("value"))


@query("a4_radius_cut_counts", f", v as (select obs_id, floor(energy / {E_BIN}::double)::int as e, lon * lon + lat * lat as r2, power(lon - 2 * lon_pnt, 2) + power(lat - 2 * lat_pnt, 2) as q2 from photons join obs using (obs_id) where energy < 10), w as (select *, power(0.50003::double - 0.1 * e, 2) as lim from v) select obs_id, count(*) filter (where r2 <= lim)::bigint as counts, count(*) filter (where q2 <= lim)::bigint as counts_off from w group by obs_id", D.SQL)
def a4(spark, sf):
    events = D.photons(spark, sf)
    placed = S.with_pointing(events, D.observations(events), "lon_pnt", "lat_pnt").filter("energy < 10")
    limit = F.pow(0.50003 - 0.1 * F.floor(F.col("energy") / E_BIN), F.lit(2.0))
    on = F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat") <= limit
    dx, dy = F.col("lon") - 2 * F.col("lon_pnt"), F.col("lat") - 2 * F.col("lat_pnt")
    return placed.groupBy("obs_id").agg(F.count_if(on).alias("counts"), F.count_if(dx * dx + dy * dy <= limit).alias("counts_off"))
