"""Queries on light curves, flux points, variability and source catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from photonlake.functions import stats, tails
from photonlake.jobs.selections import sep_sql
from photonlake.operators import lightcurve as L
from photonlake.operators.nearest import nearest_on_sky
from photonlake.registry import query
from photonlake.sources import domain as D
from photonlake.sources import store

_FV = ", v as (select series, avg(flux) as m, var_samp(flux) as v, avg(err * err) as s, count(*)::double as n from curves group by series), f as (select *, sqrt(abs(v - s)) / m as f from v)"
_ERR = "round(sqrt(power(sqrt(2 / n) * s / (m * m), 2) + power(sqrt(s / n) * 2 * f / m, 2)) / (2 * f), 7)"


@query("v1_fractional_variance", _FV + f" select series, round(f, 7) as fvar, {_ERR} as fvar_err from f", D.SQL)
def v1(spark, sf):
    return L.fractional_variance(D.light_curves(spark, sf), ["series"]).select("series", F.round("fvar", 7).alias("fvar"), F.round("fvar_err", 7).alias("fvar_err"))


@query("v2_point_to_point", ", d as (select *, flux - lag(flux) over (partition by series order by day) as df from curves), v as (select series, avg(flux) as m, sum(df * df) as q, avg(err * err) as s, count(*)::double as n from d group by series), f as (select *, sqrt(abs(q / (n - 1) - s)) / m as f from v) select series, round(f, 7) as fpp, " + _ERR + " as fpp_err from f", D.SQL)
def v2(spark, sf):
    return L.point_to_point(D.light_curves(spark, sf), ["series"], "day").select("series", F.round("fpp", 7).alias("fpp"), F.round("fpp_err", 7).alias("fpp_err"))


@query("v3_constancy", ", m as (select *, avg(flux) over (partition by series) as m from curves) select series, round(sum((flux - m) * (flux - m) / m), 2) as chi2, (count(*) - 1)::bigint as df from m group by series", D.SQL)
def v3(spark, sf):
    return L.constancy(D.light_curves(spark, sf), ["series"]).select("series", F.round("chi2", 2).alias("chi2"), "df")


@query("v3_constancy_p_value", f", c as (select obs_id as series, floor(t_us / 86400000000)::bigint as day, count(*)::double as flux from photons group by all), m as (select *, avg(flux) over (partition by series) as m from c), q as (select series, sum((flux - m) * (flux - m) / m) as chi2, (count(*) - 1)::bigint as df from m group by series) select series, round(chi2, 5) as chi2, df, round({tails.gamma_tail_sql('(df / 2.0::double)', '(chi2 / 2)')}, 8) as p from q where df > 0", D.SQL)
def v3_p(spark, sf):
    """Photons of each run by day against a constant rate: chi-square and its probability."""
    day = F.floor(F.col("t_us") / 86400000000).cast("bigint").alias("day")
    counts = D.photons(spark, sf).groupBy(F.col("obs_id").alias("series"), day).agg(F.count("*").cast("double").alias("flux")).withColumn("err", F.lit(0.0))
    c = L.constancy(counts, ["series"]).filter("df > 0")
    return c.select("series", F.round("chi2", 5).alias("chi2"), "df", F.round(tails.chi2_tail(F.col("chi2"), F.col("df")), 8).alias("p"))


_DT = ", p as (select series, day as t2, flux as f2, err as e2, lag(day) over w as t1, lag(flux) over w as f1, lag(err) over w as e1 from curves window w as (partition by series order by day)), q as (select series, (t1 + t2)::double / 2 as mid, (t2 - t1) / log2(f2 / f1) as dt, abs((t2 - t1) * ln(2) / power(ln(f2 / f1), 2) * sqrt(power(e2 / f2, 2) + power(e1 / f1, 2))) as de from p where f1 is not null and f1 <> f2)"


@query("v4_doubling_time", _DT + " select series, round(min(case when dt > 0 then dt end), 7) as doubling_time, round(min_by(de, (dt, mid)) filter (where dt > 0), 6) as doubling_err, min_by(mid, (dt, mid)) filter (where dt > 0) as doubling_coord, round(min(case when dt < 0 then -dt end), 7) as halving_time, round(min_by(de, (-dt, mid)) filter (where dt < 0), 6) as halving_err, min_by(mid, (-dt, mid)) filter (where dt < 0) as halving_coord from q group by series", D.SQL)
def v4(spark, sf):
    d = L.doubling_time(D.light_curves(spark, sf), ["series"], "day")
    r = lambda c, k: F.round(c, k).alias(c)
    return d.select("series", r("doubling_time", 7), r("doubling_err", 6), "doubling_coord", r("halving_time", 7), r("halving_err", 6), "halving_coord")


_V5 = " select a.series, b.day - a.day as lag, round(sum(power(b.flux - a.flux, 2) * (b.flux / b.err) * (a.flux / a.err)) / sum((b.flux / b.err) * (a.flux / a.err)) / 1e6, 4) as sf, count(*)::bigint as n from curves a join curves b on a.series = b.series and b.day > a.day group by all"
_V6 = ", z as (select series, day, (flux - avg(flux) over (partition by series)) / sqrt(power(stddev_pop(flux) over (partition by series), 2) - power(avg(err) over (partition by series), 2)) as z from curves), a as (select series // 2 as pair, day, z from z where series % 2 = 0), b as (select series // 2 as pair, day, z from z where series % 2 = 1), c as (select a.pair, floor((a.day - b.day) / 7.0::double)::int as bin, a.z * b.z as p from a join b on a.pair = b.pair) select pair, bin, round(avg(p), 6) as dcf, round(case when count(*) > 1 then sqrt(var_pop(p) * count(*)) / (count(*) - 1) end, 6) as err, count(*)::bigint as n from c group by all"


def _structure(spark, sf, rows):
    return L.structure_function(D.light_curves(spark, sf), ["series"], "day", rows).select("series", "lag", F.round(F.col("sf") / 1e6, 4).alias("sf"), "n")


@query("v5_structure_function", _V5, D.SQL)
def v5(spark, sf):
    return _structure(spark, sf, 512)


@query("v5_structure_function_all_lags", _V5, D.SQL)
def v5_blocks(spark, sf):
    """The same in blocks so small that each series is many pairs of blocks."""
    return _structure(spark, sf, 128)


def _correlation(spark, sf, rows):
    curves = D.light_curves(spark, sf).withColumnRenamed("day", "t").withColumn("pair", F.floor(F.col("series") / 2).cast("bigint"))
    d = L.discrete_correlation(curves.filter("series % 2 = 0").drop("series"), curves.filter("series % 2 = 1").drop("series"), ["pair"], 7.0, rows)
    return d.select("pair", "bin", F.round("dcf", 6).alias("dcf"), F.round("err", 6).alias("err"), "n")


@query("v6_discrete_correlation", _V6, D.SQL)
def v6(spark, sf):
    return _correlation(spark, sf, 512)


@query("v6_discrete_correlation_all_lags", _V6, D.SQL)
def v6_blocks(spark, sf):
    return _correlation(spark, sf, 128)


@query("w2_time_ordered", "select obs_id, count(*) filter (where d <= 0)::bigint as unordered from (select obs_id, t_us - lag(t_us) over (partition by obs_id order by event_id) as d from photons) group by obs_id", D.SQL)
def w2(spark, sf):
    step = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("obs_id").orderBy("event_id"))
    return D.photons(spark, sf).withColumn("d", step).groupBy("obs_id").agg(F.count_if(F.col("d") <= 0).alias("unordered"))


@query("w6_fixed_rebin", ", r as (select *, (row_number() over (partition by series order by day) - 1) // 5 as bin from curves) select series, bin::int as bin, min(day) as first, max(day) as last, round(sum(flux), 2) as flux, round(sqrt(sum(err * err)), 4) as err from r group by all", D.SQL)
def w6(spark, sf):
    rn = F.row_number().over(Window.partitionBy("series").orderBy("day"))
    g = D.light_curves(spark, sf).withColumn("bin", F.floor((rn - 1) / 5).cast("int")).groupBy("series", "bin")
    return g.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.round(F.sum("flux"), 2).alias("flux"), F.round(F.sqrt(F.sum(F.col("err") * F.col("err"))), 4).alias("err"))




def _merged_sql(bins: str, key: str, at: str, what: str, least: int, sums: str) -> str:
    """Greedy merging as a recursion over the numbered bins of each series."""
    return (
        f", b as (select *, row_number() over (partition by {key} order by {at}) as i from ({bins})), "
        f"r as (select *, {what}::double as acc, 0 as g from b where i = 1 union all select b.*, case when r.acc >= {least} then b.{what} else r.acc + b.{what} end, "
        f"case when r.acc >= {least} then r.g + 1 else r.g end from r join b on b.{key} = r.{key} and b.i = r.i + 1) "
        f'select {key}, g::int as "group", min({at})::bigint as first, max({at})::bigint as last, {sums} from r group by {key}, g'
    )


_RECURSIVE = D.SQL.replace("with photons", "with recursive photons", 1)


@query("w7_min_significance_rebin", _merged_sql("select series, day, flux, flux / err as ts from curves", "series", "day", "ts", 100, "round(sum(ts), 5) as ts, round(sum(flux), 2) as flux"), _RECURSIVE)
def w7(spark, sf):
    """Merge days until the summed significance reaches 100."""
    curves = D.light_curves(spark, sf).withColumn("ts", F.col("flux") / F.col("err"))
    out = L.merge_until(curves, ["series"], "day", ["ts", "flux"], lambda g: g["ts"] >= 100)
    return out.select("series", "group", "first", "last", F.round("ts", 5).alias("ts"), F.round("flux", 2).alias("flux"))


@query("w8_energy_edges", _merged_sql("select obs_id % 10 as run, -floor(energy / 0.5::double)::int as down, count(*) as counts from photons group by all", "run", "down", "counts", 30, "sum(counts)::double as counts"), _RECURSIVE)
def w8(spark, sf):
    """Energy groups of at least 30 counts, walking down from the top of each run's spectrum."""
    e = F.floor(F.col("energy") / 0.5).cast("int")
    spectrum = D.photons(spark, sf).groupBy((F.col("obs_id") % 10).alias("run"), (-e).alias("down")).agg(F.count("*").alias("counts"))
    return L.merge_until(spectrum, ["run"], "down", ["counts"], lambda g: g["counts"] >= 30)


@query("w9_profile_smoothing", "select series, day, round(avg(flux) over w, 4) as flux, round(sqrt(sum(err * err) over w) / count(*) over w, 5) as err from curves window w as (partition by series order by day rows between 2 preceding and 2 following)", D.SQL)
def w9(spark, sf):
    w = Window.partitionBy("series").orderBy("day").rowsBetween(-2, 2)
    return D.light_curves(spark, sf).select("series", "day", F.round(F.avg("flux").over(w), 4).alias("flux"), F.round(F.sqrt(F.sum(F.col("err") * F.col("err")).over(w)) / F.count("*").over(w), 5).alias("err"))


@query("io6_flux_point_tables", "select series, list(day order by day) as days, list(round(flux, 2) order by day) as fluxes from curves group by series", D.SQL)
def io6(spark, sf):
    """Flux points written in three shapes, each read back from the one before."""
    points, folder = D.light_curves(spark, sf), store.new_folder(spark, "flux-points")
    for shape in ("long", "light_curve", "wide"):
        store.write_flux_points(points, f"{folder}/{shape}", shape)
        points = store.read_flux_points(spark, f"{folder}/{shape}")
    wide = spark.read.parquet(f"{folder}/wide")
    return wide.select("series", "days", F.transform("fluxes", lambda x: F.round(x, 2)).alias("fluxes"))


_POWER = "amplitude * 1e-3::double * (power(10, 1 - index) - power(1, 1 - index)) / (1 - index)"


@query("e6_flux_quantities", ", q as (select source_id, 0.5::double + (source_id % 7) * 0.3::double as norm, 0.1::double + (source_id % 3) * 0.2::double as norm_err, " + _POWER + " as ref, amplitude * 1e-3::double * power(3, -index) as dref, index from sources) select source_id, round(norm * dref, 9) as dnde, round(norm * dref * 9, 8) as e2dnde, round(norm * ref, 9) as flux, round(norm_err * ref, 9) as flux_err, round(sign(norm - 1) * abs(norm - 1) / norm_err, 6) as sqrt_ts, (norm + 2 * norm_err) * ref < norm_err * 3 * ref as is_ul from q", D.SQL)
def e6(spark, sf):
    k = F.col("source_id")
    q = D.catalog(spark, sf).select("source_id", "index", "amplitude", (F.lit(0.5) + k % 7 * 0.3).alias("norm"), (F.lit(0.1) + k % 3 * 0.2).alias("norm_err"))
    ref = F.col("amplitude") * 1e-3 * (F.pow(F.lit(10.0), 1 - F.col("index")) - 1.0) / (1 - F.col("index"))
    dref = F.col("amplitude") * 1e-3 * F.pow(F.lit(3.0), -F.col("index"))
    n, s = F.col("norm"), F.col("norm_err")
    return q.select("source_id", F.round(n * dref, 9).alias("dnde"), F.round(n * dref * 9, 8).alias("e2dnde"), F.round(n * ref, 9).alias("flux"), F.round(s * ref, 9).alias("flux_err"), F.round(F.signum(n - 1) * F.abs(n - 1) / s, 6).alias("sqrt_ts"), ((n + 2 * s) * ref < s * 3 * ref).alias("is_ul"))


@query("e7_combine_gaussian", "select series % 10 as grp, day // 7 as week, round(sum(flux / (err * err)) / sum(1 / (err * err)), 4) as flux, round(sqrt(1 / sum(1 / (err * err))), 5) as err, round(power(sum(flux / (err * err)), 2) / sum(1 / (err * err)), 2) as ts, count(*)::bigint as n from curves where err > 0 and (series + day) % 4 <> 0 group by all", D.SQL)
def e7(spark, sf):
    """Inverse-variance means over the points that are valid."""
    w = 1 / (F.col("err") * F.col("err"))
    valid = D.light_curves(spark, sf).filter((F.col("err") > 0) & ((F.col("series") + F.col("day")) % 4 != 0))
    g = valid.groupBy((F.col("series") % 10).alias("grp"), F.floor(F.col("day") / 7).cast("bigint").alias("week")).agg(F.sum(F.col("flux") * w).alias("a"), F.sum(w).alias("b"), F.count("*").alias("n"))
    return g.select("grp", "week", F.round(F.col("a") / F.col("b"), 4).alias("flux"), F.round(F.sqrt(1 / F.col("b")), 5).alias("err"), F.round(F.col("a") * F.col("a") / F.col("b"), 2).alias("ts"), "n")


_E8 = ", g as (select i::int as i, i * 2000.0::double as x from range(60) t(i)), u as (select series % 10 as grp, i, x, (x - flux) / err as t, least(greatest(floor((x - flux) / err), -5), 4) as k from curves, g), p as (select grp, i, x, sum(k * k + (t - k) * (2 * k + 1)) as stat from u group by all), m as (select grp, min_by(x, (stat, x)) as best, min(stat) as least from p group by grp), q as (select grp, x, best, least, stat - least - 4 as d, lag(stat - least - 4) over (partition by grp order by i) as d0 from p join m using (grp)) select grp, min(best) as best, round(min(least), 2) as stat, round(min(case when x > best and d >= 0 and d0 < 0 then x - 2000 * d / (d - d0) end), 3) as upper from q group by grp"


@query("e8_combine_profiles", _E8, D.SQL)
def e8(spark, sf):
    """Profiles known at whole numbers of errors from -5 to 5, interpolated to one grid and summed; the best value, and where the sum has risen by 4."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")
    p = D.light_curves(spark, sf).select((F.col("series") % 10).alias("grp"), "flux", "err", grid).withColumn("x", F.col("i") * 2000.0)
    t = (F.col("x") - F.col("flux")) / F.col("err")
    k = F.least(F.greatest(F.floor(t), F.lit(-5)), F.lit(4))
    p = p.groupBy("grp", "i", "x").agg(F.sum(k * k + (t - k) * (2 * k + 1)).alias("stat"))
    best = p.groupBy("grp").agg(F.min_by("x", F.struct("stat", "x")).alias("best"), F.min("stat").alias("least"))
    q = p.join(F.broadcast(best), "grp").withColumn("d", F.col("stat") - F.col("least") - 4).withColumn("d0", F.lag("d").over(Window.partitionBy("grp").orderBy("i")))
    upper = F.when((F.col("x") > F.col("best")) & (F.col("d") >= 0) & (F.col("d0") < 0), F.col("x") - 2000 * F.col("d") / (F.col("d") - F.col("d0")))
    return q.groupBy("grp").agg(F.min("best").alias("best"), F.round(F.min("least"), 2).alias("stat"), F.round(F.min(upper), 3).alias("upper"))


@query("c1_positions", "select source_id, round(coalesce(case when source_id % 3 = 0 then lon end, case when source_id % 3 = 1 then lon + 0.5 end, 0), 6) as ra, round(lat, 6) as dec from sources", D.SQL)
def c1(spark, sf):
    k = F.col("source_id") % 3
    return D.catalog(spark, sf).select("source_id", F.round(F.coalesce(F.when(k == 0, F.col("lon")), F.when(k == 1, F.col("lon") + 0.5), F.lit(0.0)), 6).alias("ra"), F.round("lat", 6).alias("dec"))


@query("c2_flux_bands", ", r as (select vec_id, unnest(range(len(flux))) as band, unnest(flux) as flux from bands) select vec_id, band::int as band, round(flux, 7) as flux, case when band % 3 = 2 then null else round(flux * 0.1::double, 7) end as errn, round(flux * 0.2::double, 7) as errp, case when band % 3 = 2 then round(flux + 2 * (flux * 0.2::double), 7) end as ul from r", D.SQL)
def c2(spark, sf):
    """One row per band; where the lower error is missing the upper limit is the flux and twice the upper error."""
    r = D.band_arrays(spark, sf).select("vec_id", F.posexplode("flux").alias("band", "flux"))
    errn = F.when(F.col("band") % 3 != 2, F.col("flux") * 0.1)
    errp = F.col("flux") * 0.2
    return r.select("vec_id", "band", F.round("flux", 7).alias("flux"), F.round(errn, 7).alias("errn"), F.round(errp, 7).alias("errp"), F.when(errn.isNull(), F.round(F.col("flux") + 2 * errp, 7)).alias("ul"))


@query("c3_flux_history", ", r as (select vec_id, unnest(range(len(flux))) as i, unnest(flux) as flux from bands) select vec_id, i::int as t_idx, 54682 + i * 60 as mjd_min, 54682 + (i + 1) * 60 as mjd_max, round(flux, 7) as flux from r", D.SQL)
def c3(spark, sf):
    r = D.band_arrays(spark, sf).select("vec_id", F.posexplode("flux").alias("t_idx", "flux"))
    return r.select("vec_id", "t_idx", (54682 + F.col("t_idx").cast("bigint") * 60).alias("mjd_min"), (54682 + (F.col("t_idx").cast("bigint") + 1) * 60).alias("mjd_max"), F.round("flux", 7).alias("flux"))


_MODELS = {
    "pl": ("amplitude * power(e, -index)", lambda a, g, e: a * F.pow(e, -g)),
    "ecpl": ("amplitude * power(e, -index) * exp(-e / 20)", lambda a, g, e: a * F.pow(e, -g) * F.exp(-e / 20)),
    "lp": ("amplitude * power(e, -index - 0.1::double * ln(e))", lambda a, g, e: a * F.pow(e, -g - 0.1 * F.log(e))),
    "pl2": ("amplitude * (1 - index) / (power(50, 1 - index) - power(0.5::double, 1 - index)) * power(e, -index)", lambda a, g, e: a * (1 - g) / (F.pow(F.lit(50.0), 1 - g) - F.pow(F.lit(0.5), 1 - g)) * F.pow(e, -g)),
    "bpl": ("amplitude * power(e / 3, case when e < 3 then -index else -index - 0.5 end)", lambda a, g, e: a * F.pow(e / 3, F.when(e < 3, -g).otherwise(-g - 0.5))),
}


_DNDE = ", g as (select unnest([0.5, 1.7, 4.9, 13.1, 40.3])::double as e), d as (select source_id, e, case source_id % 5 " + " ".join(f"when {i} then {s}" for i, (s, _) in enumerate(_MODELS.values())) + " end as dnde from sources, g)"


def _dnde(spark, sf):
    """Each source's model on an energy grid that is part of the expression."""
    src = D.catalog(spark, sf).withColumn("e", F.explode(F.array(*map(F.lit, (0.5, 1.7, 4.9, 13.1, 40.3)))))
    value = None
    for i, (_, f) in enumerate(_MODELS.values()):
        v = f(F.col("amplitude"), F.col("index"), F.col("e"))
        value = F.when(F.col("source_id") % 5 == i, v) if value is None else value.when(F.col("source_id") % 5 == i, v)
    return src.select("source_id", "e", value.alias("dnde"))


@query("c4_spectra", _DNDE + " select source_id, e, round(dnde, 7) as dnde from d", D.SQL)
def c4(spark, sf):
    return _dnde(spark, sf).withColumn("dnde", F.round("dnde", 7))


_SEGMENTS = ", s as (select source_id, e, dnde, lead(e) over w as e2, lead(dnde) over w as d2 from d window w as (partition by source_id order by e)), t as (select *, ln(d2 / dnde) / ln(e2 / e) as b from s where e2 is not null)"


@query("c5_trapezoid", _DNDE + _SEGMENTS + " select source_id, round(sum(case when abs(b + 1) < 1e-10 then e * dnde * ln(e2 / e) else e * dnde / (b + 1) * (power(e2 / e, b + 1) - 1) end), 6) as flux from t group by source_id", D.SQL)
def c5_trapezoid(spark, sf):
    """The integral of any model from its values on a grid, a power law between neighbours."""
    return L.integrate_log_log(_dnde(spark, sf), ["source_id"], "e", "dnde").select("source_id", F.round("integral", 6).alias("flux"))


@query("c5_power_law_integrals", "select source_id, round(amplitude * (power(10, 1 - index) - 1) / (1 - index), 7) as flux, round(case when abs(index - 2) < 1e-9 then amplitude * ln(10) else amplitude * (power(10, 2 - index) - 1) / (2 - index) end, 7) as eflux, round(power(0.5::double, -1 / index), 7) as half_at from sources", D.SQL)
def c5(spark, sf):
    a, g = F.col("amplitude"), F.col("index")
    eflux = F.when(F.abs(g - 2) < 1e-9, a * F.log(F.lit(10.0))).otherwise(a * (F.pow(F.lit(10.0), 2 - g) - 1) / (2 - g))
    return D.catalog(spark, sf).select("source_id", F.round(a * (F.pow(F.lit(10.0), 1 - g) - 1) / (1 - g), 7).alias("flux"), F.round(eflux, 7).alias("eflux"), F.round(F.pow(F.lit(0.5), -1 / g), 7).alias("half_at"))


@query("c6_temporal_norm", ", t as (select obs_id, (start - 694224000)::double / 86400 as a, (stop - 694224000)::double / 86400 as b from gti) select obs_id, round(sum(b - a) / sum(b - a), 7) as constant, round(sum((b - a) + 0.001::double * (b * b - a * a) / 2) / sum(b - a), 6) as linear, round(sum(-1000 * (exp(-b / 1000) - exp(-a / 1000))) / sum(b - a), 7) as decay, round(sum((b - a) - 0.5::double * (cos(b / 50) - cos(a / 50)) * 50) / sum(b - a), 6) as sine from t group by obs_id", D.SQL)
def c6(spark, sf):
    t = D.intervals(spark, sf).select("obs_id", ((F.col("start") - 694224000) / 86400).alias("a"), ((F.col("stop") - 694224000) / 86400).alias("b"))
    a, b = F.col("a"), F.col("b")
    mean = lambda x: F.sum(x) / F.sum(b - a)
    return t.groupBy("obs_id").agg(
        F.round(mean(b - a), 7).alias("constant"),
        F.round(mean((b - a) + 0.001 * (b * b - a * a) / 2), 6).alias("linear"),
        F.round(mean(-1000 * (F.exp(-b / 1000) - F.exp(-a / 1000))), 7).alias("decay"),
        F.round(mean((b - a) - 0.5 * (F.cos(b / 50) - F.cos(a / 50)) * 50), 6).alias("sine"),
    )


@query("c7_nearest_source", f", p as (select s.source_id, o.source_id as other, {sep_sql('s.lon', 's.lat', 'o.lon', 'o.lat')} as d from sources s, sources o where s.source_id <> o.source_id) select source_id, min_by(other, (d, other)) as other, round(min(d), 6) as separation from p group by source_id", D.SQL)
def c7(spark, sf):
    src = D.catalog(spark, sf).select("source_id", "lon", "lat")
    best = nearest_on_sky(src, src.withColumnRenamed("source_id", "other"), "source_id", "other", distinct_from_itself=True)
    return best.select("source_id", "other", F.round("separation", 6).alias("separation"))


@query("j11_satellite_tables", ", a as (select source_id, trim(unnest(string_split(aliases, ','))) as component from sources) select s.source_id, s.name, a.component, p.p_name as association from sources s left join a using (source_id) left join part p on p.p_partkey = s.source_id * 2", D.SQL)
def j11(spark, sf):
    src = D.catalog(spark, sf)
    parts = D.read(spark, sf, "part").select((F.col("p_partkey") / 2).alias("k"), F.col("p_name").alias("association"))
    comps = src.select("source_id", "name", F.explode(F.split("aliases", ",")).alias("c"))
    return comps.join(parts, comps.source_id == parts.k, "left").select("source_id", "name", F.trim("c").alias("component"), "association")


@query("j12_index_consistency", "select 'only_gti' as level, obs_id from (select distinct obs_id from gti) where obs_id not in (select obs_id from obs) union all select 'only_events', obs_id from obs where obs_id not in (select obs_id from gti)", D.SQL)
def j12(spark, sf):
    a, b = D.intervals(spark, sf).select("obs_id").distinct(), D.observations(D.photons(spark, sf)).select("obs_id")
    return a.join(b, "obs_id", "left_anti").select(F.lit("only_gti").alias("level"), "obs_id").union(b.join(a, "obs_id", "left_anti").select(F.lit("only_events").alias("level"), "obs_id"))


@query("s13_band_chi2", ", m as (select series % 5 as band, sum(flux / (err * err)) / sum(1 / (err * err)) as mean from curves group by all) select band, round(sum(power((flux - mean) / err, 2)), 1) as chi2, (count(*) - 1)::bigint as df from curves join m on series % 5 = band group by band", D.SQL)
def s13(spark, sf):
    c = D.light_curves(spark, sf).withColumn("band", F.col("series") % 5)
    w = 1 / (F.col("err") * F.col("err"))
    mean = c.groupBy("band").agg((F.sum(F.col("flux") * w) / F.sum(w)).alias("mean"))
    return c.join(F.broadcast(mean), "band").groupBy("band").agg(F.round(F.sum(F.pow((F.col("flux") - F.col("mean")) / F.col("err"), 2)), 1).alias("chi2"), (F.count("*") - 1).alias("df"))


@query("e4_profile_scan", ", g as (select i::int as i, 0.2::double * i as norm from range(11) t(i)), b as (select px, py, counts, 0.5::double + px % 3 as bkg from img) select i, round(norm, 6) as norm, round(sum(2 * (norm + bkg - counts * ln(norm + bkg))), 4) as stat from b, g group by i, norm", D.SQL)
def e4(spark, sf):
    image = D.image(D.counts_map(D.photons(spark, sf)))
    scan = image.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("norm", F.col("i") * 0.2)
    stat = stats.cash(F.col("counts"), F.col("norm") + 0.5 + F.col("px") % 3)
    return scan.groupBy("i", "norm").agg(F.round(F.sum(stat), 4).alias("stat")).select("i", F.round("norm", 6).alias("norm"), "stat")
