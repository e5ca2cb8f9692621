"""Queries on maps: filling, reductions, resampling, neighbourhoods, profiles and containment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from photonlake.functions import sky
from photonlake.functions.axis import Axis
from photonlake.jobs.selections import sep_sql
from photonlake.operators import maps as M
from photonlake.operators import reproject as RP
from photonlake.operators import scan
from photonlake.operators import selection as S
from photonlake.operators.crossmatch import within
from photonlake.registry import query
from photonlake.sources import domain as D
from photonlake.sources import store


def _cube(spark, sf):
    return D.counts_map(D.photons(spark, sf)).withColumnRenamed("counts", "value")


def _image(spark, sf):
    return D.image(D.counts_map(D.photons(spark, sf))).withColumnRenamed("counts", "value")


@query("a1_fill_cube", "select px, py, e, counts::bigint as value from cube", D.SQL)
def a1(spark, sf):
    bins = {"px": F.floor((F.col("lon") + 2.0005) / 0.1).cast("int"), "py": F.floor((F.col("lat") + 2.0005) / 0.1).cast("int")}
    e = F.floor(F.col("energy") / 2.500013).cast("int")
    return M.fill(D.photons(spark, sf), bins | {"e": F.when(e.between(0, 3), e)})


@query("a1_fill_weighted", "select floor((lon + 2.0005::double) / 0.5::double)::int as px, round(sum(energy), 4) as value from photons group by all", D.SQL)
def a1w(spark, sf):
    return M.fill(D.photons(spark, sf), {"px": F.floor((F.col("lon") + 2.0005) / 0.5).cast("int")}, F.col("energy")).select("px", F.round("value", 4).alias("value"))


@query("a3_region_spectrum", "select floor(energy / 2.500013::double)::int as e, count(*)::bigint as value from photons where sqrt(power(lon - 0.5, 2) + power(lat, 2)) < 0.60003 group by all", D.SQL)
def a3(spark, sf):
    events = S.select_region(D.photons(spark, sf), [sky.in_circle("lon", "lat", 0.5, 0.0, 0.60003)])
    return M.fill(events, {"e": F.floor(F.col("energy") / 2.500013).cast("int")})


@query("a5_reduce", "select px, sum(counts)::double as total, max(counts)::double as most, min(counts)::double as least, min((counts <> 0)::int)::int as every from cube group by px", D.SQL)
def a5(spark, sf):
    return M.reductions(_cube(spark, sf), ["px"], {"total": "sum", "most": "max", "least": "min", "every": "all"})


@query("a6_downsample", "select px // 4 as px, py // 4 as py, sum(counts)::bigint as value, round(sum(counts)::double / 16, 6) as mean from img group by all", D.SQL)
def a6(spark, sf):
    """Sums, and from them the means over whole blocks."""
    return M.downsample(_image(spark, sf), 4).withColumn("mean", F.round(F.col("value") / 16, 6))


@query("a7_upsample", "select (px * 2 + i)::int as px, (py * 2 + j)::int as py, round(counts::double / 4, 6) as value from img, range(2) a(i), range(2) b(j)", D.SQL)
def a7(spark, sf):
    return M.upsample(_image(spark, sf), 2).select("px", "py", F.round("value", 6).alias("value"))


@query("a9_resample_axis", "select px, py, case when e <= 0 then 0 else 1 end::int as e, sum(counts)::bigint as value from cube where e <= 2 group by all", D.SQL)
def a9(spark, sf):
    return M.rebin(_cube(spark, sf), "e", [(0, 0), (1, 1), (2, 1)])


@query("a10_axis_groups", ", g as (select * from (values ('underflow', 0, 1), ('normal', 2, 5), ('overflow', 6, 7)) t(kind, idx_min, idx_max)) select kind, idx_min, idx_max, count(event_id)::bigint as n from g left join photons on floor(energy + 0.00001234::double) between idx_min and idx_max group by all", D.SQL)
def a10(spark, sf):
    """Photons below, within and above the axis edges nearest to two bounds."""
    axis = Axis.from_bounds("x", 0.0, 8.0, 8)
    groups = spark.createDataFrame(axis.groups(2.2, 6.1), "kind string, idx_min int, idx_max int")
    n = M.fill(D.photons(spark, sf), {"idx": axis.fill_index(F.col("energy") + 0.00001234)})
    met = F.broadcast(groups).join(n, F.col("idx").between(F.col("idx_min"), F.col("idx_max")), "inner")
    return groups.join(met.groupBy("kind").agg(F.sum("value").alias("n")), "kind", "left").select("kind", "idx_min", "idx_max", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


#: The image's own pixels, a tangent plane beside their middle, and one in Galactic coordinates.
_CAR = RP.Plane("car", 0.0, 0.0, 0.1, 0.1, 19.505, 19.505, 41, 41)
_TAN = RP.Plane("tan", 0.31, -0.27, -0.23, 0.23, 9.137, 8.871, 19, 18)
_GAL = RP.Plane("tan", 96.8, -60.1, -0.17, 0.17, 14.137, 15.871, 30, 31, "galactic")


def _tan_pixel_sql(lon: str, lat: str, p: RP.Plane) -> tuple[str, str]:
    """Pixel coordinates of a position on a tangent plane."""
    a, d = f"radians({lon} - {p.lon0}::double)", f"radians({lat})"
    sin0, cos0 = f"sin(radians({p.lat0}::double))", f"cos(radians({p.lat0}::double))"
    w = f"(sin({d}) * {sin0} + cos({d}) * {cos0} * cos({a}))"
    x, y = f"degrees(cos({d}) * sin({a}) / {w})", f"degrees((sin({d}) * {cos0} - cos({d}) * {sin0} * cos({a})) / {w})"
    return f"{x} / {p.step_lon}::double + {p.px0}::double", f"{y} / {p.step_lat}::double + {p.py0}::double"


def _tan_sky_sql(px: str, py: str, p: RP.Plane) -> tuple[str, str]:
    x, y = f"radians(({px} - {p.px0}::double) * {p.step_lon}::double)", f"radians(({py} - {p.py0}::double) * {p.step_lat}::double)"
    sin0, cos0 = f"sin(radians({p.lat0}::double))", f"cos(radians({p.lat0}::double))"
    turn = f"atan2({x}, {cos0} - {y} * {sin0})"
    return f"{p.lon0}::double + degrees({turn})", f"degrees(atan2(({sin0} + {y} * {cos0}) * cos({turn}), {cos0} - {y} * {sin0}))"


def _turned_sql(lon: str, lat: str, matrix) -> tuple[str, str]:
    v = f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"
    x, y, z = ("(" + " + ".join(f"{m}::double * {c}" for m, c in zip(row, v, strict=True)) + ")" for row in matrix)
    return f"degrees(atan2({y}, {x}))", f"degrees(asin({z}))"


def _fine(n: int, source: str = "img") -> str:
    """Centers of the parts of each pixel of the image, in degrees."""
    at = lambda c, k: f"({c} + ({k} + 0.5::double) / {n} - 0.5::double - 19.505::double) * 0.1::double"
    return f"(select *, {at('px', 'i')} as lon, {at('py', 'j')} as lat from {source}, range({n}) a(i), range({n}) b(j))"


def _on_sql(target: RP.Plane, columns: str, rows: str, x: str, y: str) -> str:
    return f", placed as (select * from (select * exclude (px, py), floor(x + 0.5)::int as px, floor(y + 0.5)::int as py from (select *, {x} as x, {y} as y from {rows})) where px between 0 and {target.width - 1} and py between 0 and {target.height - 1}) select px, py, {columns} from placed group by all"


@query("a11_coadd", _on_sql(_TAN, "e, sum(counts)::double as value", _fine(1, "cube"), *_tan_pixel_sql("lon", "lat", _TAN)), D.SQL)
def a11(spark, sf):
    """The cube's pixels added up where their centers fall on a tangent plane, energy by energy."""
    return RP.reproject(_cube(spark, sf), _CAR, _TAN, others=("e",))


_TO_GAL = _turned_sql("lon", "lat", sky.GALACTIC)


@query("a12_reproject", _on_sql(_GAL, "round(sum(counts) / 25, 6)::double as value", f"(select *, {_TO_GAL[0]} as gl, {_TO_GAL[1]} as gb from {_fine(5)})", *_tan_pixel_sql("gl", "gb", _GAL)), D.SQL)
def a12(spark, sf):
    """Counts from equatorial plate-carree pixels onto a tangent plane in Galactic coordinates, each in 25 parts."""
    return RP.reproject(_image(spark, sf), _CAR, _GAL, factor=5).withColumn("value", F.round("value", 6))


@query("a12_reproject_mean", _on_sql(_TAN, "round(avg(counts), 6)::double as value", _fine(4), *_tan_pixel_sql("lon", "lat", _TAN)), D.SQL)
def a12_mean(spark, sf):
    """A quantity that is no count: the mean of the parts in each pixel."""
    return RP.reproject(_image(spark, sf), _CAR, _TAN, factor=4, preserve_counts=False).withColumn("value", F.round("value", 6))


@query("a13_sum_in_region", "select e, sum(counts)::bigint as value from cube where sqrt(power(px - 20, 2) + power(py - 20, 2)) < 7.3 group by e", D.SQL)
def a13(spark, sf):
    return S.select_region(_cube(spark, sf), [sky.in_circle("px", "py", 20.0, 20.0, 7.3)]).groupBy("e").agg(F.sum("value").alias("value"))


@query("a14_value_histogram", ", h as (select e, counts // 2 as b, count(*) as n from cube group by all) select e, b::bigint as bin, n::bigint as n, round(n / sum(n) over (partition by e)::double, 8) as density from h", D.SQL)
def a14(spark, sf):
    h = _cube(spark, sf).groupBy("e", F.floor(F.col("value") / 2).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("e")), 8))


@query("a15_spectrum_at_position", "select e, counts::bigint as value from cube where px = floor((0.13::double + 2.0005) / 0.1::double) and py = floor((-0.42::double + 2.0005) / 0.1::double)", D.SQL)
def a15(spark, sf):
    px, py = (int((x + 2.0005) / 0.1) for x in (0.13, -0.42))
    return _cube(spark, sf).filter((F.col("px") == px) & (F.col("py") == py)).select("e", "value")


@query("a16_normalise", "select e, round(sum(counts)::double / (select sum(counts) from cube), 8) as share, round((sum(sum(counts)) over (order by e))::double, 4) as upto from cube group by e", D.SQL)
def a16(spark, sf):
    spectrum = M.reduce(_cube(spark, sf).withColumn("value", F.col("value").cast("double")), ["e"])
    run = M.cumulative(spectrum, [], "e")
    return run.select("e", F.round(F.col("value") / F.col("total"), 8).alias("share"), F.round("upto", 4).alias("upto"))


@query("a16_integral", " select px, py, round(sum(counts * greatest(least((e + 1) * 2.500013::double, 7.9) - greatest(e * 2.500013::double, 1.3), 0) / 2.500013::double), 6) as value from cube group by all", D.SQL)
def a16_integral(spark, sf):
    """The integral between two energies of each pixel, its cumulative spectrum being linear inside a bin."""
    return M.integral(_cube(spark, sf), ["px", "py"], 2.500013, 1.3, 7.9).select("px", "py", F.round("value", 6).alias("value"))


@query("a17_event_summary", "select obs_id, count(*)::bigint as n, round(min(energy), 6) as e_min, round(max(energy), 6) as e_max, round(median(energy), 6) as e_median, round(count(*) / nullif((max(t_us) - min(t_us))::double / 1e6::double, 0), 8) as rate from photons group by obs_id", D.SQL)
def a17(spark, sf):
    span = (F.max("t_us") - F.min("t_us")) / 1e6
    events = D.photons(spark, sf)
    sums = events.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.min("energy"), 6).alias("e_min"), F.round(F.max("energy"), 6).alias("e_max"), F.round(F.count("*") / F.nullif(span, F.lit(0.0)), 8).alias("rate"))
    middle = M.quantiles(events, ["obs_id"], e_median=("energy", 0.5))
    return sums.join(middle, "obs_id", "left").withColumn("e_median", F.round("e_median", 6))


@query("a18_median_position", f", m as (select obs_id, median(lon) as mlon, median(lat) as mlat from photons group by obs_id) select event_id, round({sep_sql('lon', 'lat', 'mlon', 'mlat')}, 6) as away from photons join m using (obs_id)", D.SQL)
def a18(spark, sf):
    events = D.photons(spark, sf)
    middle = M.quantiles(events, ["obs_id"], mlon=("lon", 0.5), mlat=("lat", 0.5))
    return events.join(middle, "obs_id").select("event_id", F.round(sky.separation("lon", "lat", "mlon", "mlat"), 6).alias("away"))


_OFF = f", off as (select obs_id, event_id, energy, {sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} as away from photons p join obs o using (obs_id))"


def _offsets(spark, sf):
    events = D.photons(spark, sf)
    return S.with_pointing(events, D.observations(events), "lon_pnt", "lat_pnt").withColumn("away", sky.separation("lon", "lat", "lon_pnt", "lat_pnt"))


@query("a20_offset_squared", _OFF + " select floor(away * away / 0.250007::double)::int as bin, count(*)::bigint as n from off where away <= (select quantile_cont(away, 0.9) from off) group by all", D.SQL)
def a20(spark, sf):
    off = _offsets(spark, sf)
    kept = off.filter(F.col("away") <= M.overall_quantile(off, "away", 0.9))
    return kept.groupBy(F.floor(F.col("away") * F.col("away") / 0.250007).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("a20_containment_radius", _OFF + " select obs_id, round(quantile_cont(away, 0.68), 7) as r68 from off group by obs_id", D.SQL)
def a20r(spark, sf):
    return M.quantiles(_offsets(spark, sf), ["obs_id"], r68=("away", 0.68)).withColumn("r68", F.round("r68", 7))


@query("a21_energy_offset", _OFF + " select floor(energy / 2.500013::double)::int as e, floor(away / 0.500003::double)::int as o, count(*)::bigint as value from off group by all", D.SQL)
def a21(spark, sf):
    return M.fill(_offsets(spark, sf), {"e": F.floor(F.col("energy") / 2.500013).cast("int"), "o": F.floor(F.col("away") / 0.500003).cast("int")})


_PIXOBS = f"(select px, py, px * 0.1::double - 2 as plon, py * 0.1::double - 2 as plat from (select x::int as px, y::int as py from range(41) a(x), range(41) b(y)))"


@query("a22_observation_time", f"select px, py, round(sum(livetime), 4) as value from {_PIXOBS} join obs on {sep_sql('plon', 'plat', 'lon_pnt', 'lat_pnt')} < 0.50003 group by px, py", D.SQL)
def a22(spark, sf):
    """Pixels meet the runs of their own and the neighbouring sky cells only."""
    runs = D.observations(D.photons(spark, sf)).groupBy("lon_pnt", "lat_pnt").agg(F.sum("livetime").alias("livetime"))
    pixels = M.grid(spark, 41, 41).withColumn("plon", F.col("px") * 0.1 - 2).withColumn("plat", F.col("py") * 0.1 - 2)
    met = within(pixels.withColumnsRenamed({"plon": "lon", "plat": "lat"}), runs.withColumnsRenamed({"lon_pnt": "lon2", "lat_pnt": "lat2"}), 0.50003)
    return met.groupBy("px", "py").agg(F.round(F.sum("livetime"), 4).alias("value"))


@query("a26_group_observations", "select case when lon_pnt < 0 then 'west' when lon_pnt > 0 then 'east' else 'mid' end as label, count(*)::bigint as n, round(sum(livetime), 3) as livetime from obs group by all", D.SQL)
def a26(spark, sf):
    label = F.when(F.col("lon_pnt") < 0, "west").when(F.col("lon_pnt") > 0, "east").otherwise("mid")
    return D.observations(D.photons(spark, sf)).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("livetime"), 3).alias("livetime"))


@query("a27_build_index", "select obs_id, t0, t1, n_events, k as kind, 'obs_' || obs_id || '/' || k || '.parquet' as path from obs, (values ('events'), ('gti'), ('aeff')) v(k)", D.SQL)
def a27(spark, sf):
    obs = D.observations(D.photons(spark, sf)).select("obs_id", "t0", "t1", "n_events", F.explode(F.array(*map(F.lit, ("events", "gti", "aeff")))).alias("kind"))
    return obs.withColumn("path", F.concat(F.lit("obs_"), "obs_id", F.lit("/"), "kind", F.lit(".parquet")))


@query("a28_obscore", "select obs_id, 'event-list' as product, t0 / 1e6::double as t_min, t1 / 1e6::double as t_max, round(min(energy), 6) as em_min, round(max(energy), 6) as em_max from photons join obs using (obs_id) group by obs_id, t0, t1", D.SQL)
def a28(spark, sf):
    g = D.photons(spark, sf).groupBy("obs_id").agg((F.min("t_us") / 1e6).alias("t_min"), (F.max("t_us") / 1e6).alias("t_max"), F.round(F.min("energy"), 6).alias("em_min"), F.round(F.max("energy"), 6).alias("em_max"))
    return g.withColumn("product", F.lit("event-list"))


@query("a29_profile", "select px // 3 as bin, sum(counts)::bigint as total, round(avg(counts), 7) as mean, round(sqrt(sum(counts)::double), 7) as err from img where py between 5 and 35 group by all", D.SQL)
def a29(spark, sf):
    masked = _image(spark, sf).filter("py between 5 and 35").groupBy(F.floor(F.col("px") / 3).cast("int").alias("bin"))
    return masked.agg(F.sum("value").alias("total"), F.round(F.avg("value"), 7).alias("mean"), F.round(F.sqrt(F.sum("value")), 7).alias("err"))


@query("a30_profile_normalised", ", p as (select px // 3 as bin, sum(counts) as v from img group by all) select bin, round(v::double / max(v) over (), 7) as peak, round(v::double / sum(v) over (), 7) as integral from p", D.SQL)
def a30(spark, sf):
    p = _image(spark, sf).groupBy(F.floor(F.col("px") / 3).cast("int").alias("bin")).agg(F.sum("value").alias("v"))
    every = p.agg(F.max("v").alias("top"), F.sum("v").alias("all"))
    return p.crossJoin(F.broadcast(every)).select("bin", F.round(F.col("v") / F.col("top"), 7).alias("peak"), F.round(F.col("v") / F.col("all"), 7).alias("integral"))


@query("a31_standard_scaler", "select obs_id, round((n_events - (select avg(n_events) from obs)) / (select stddev_pop(n_events) from obs), 7) as n, round((ontime - (select avg(ontime) from obs)) / (select stddev_pop(ontime) from obs), 6) as ontime from obs", D.SQL)
def a31(spark, sf):
    obs = D.observations(D.photons(spark, sf))
    m = obs.agg(F.avg("n_events").alias("a"), F.stddev_pop("n_events").alias("s"), F.avg("ontime").alias("b"), F.stddev_pop("ontime").alias("t"))
    return obs.crossJoin(F.broadcast(m)).select("obs_id", F.round((F.col("n_events") - F.col("a")) / F.col("s"), 7).alias("n"), F.round((F.col("ontime") - F.col("b")) / F.col("t"), 6).alias("ontime"))


@query("a32_annuli", "select floor(sqrt(power(px - 20, 2) + power(py - 20, 2)) / 2.0003::double)::int as ring, sum(counts)::bigint as value, count(*)::bigint as pixels from img group by all", D.SQL)
def a32(spark, sf):
    r = F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2))
    return _image(spark, sf).groupBy(F.floor(r / 2.0003).cast("int").alias("ring")).agg(F.sum("value").alias("value"), F.count("*").alias("pixels"))


@query("j6_cone_join", f"select source_id, count(*)::bigint as n from sources s join (select s2.source_id as other, s2.lon as lon2, s2.lat as lat2 from sources s2) on {sep_sql('s.lon', 's.lat', 'lon2', 'lat2')} < 8.0001 and other <> source_id group by source_id", D.SQL)
def j6(spark, sf):
    sources = D.catalog(spark, sf).select("source_id", "lon", "lat")
    return within(sources, sources.withColumnsRenamed({"source_id": "other", "lon": "lon2", "lat": "lat2"}), 8.0001).filter("other <> source_id").groupBy("source_id").agg(F.count("*").alias("n"))


@query("j8_map_lookup", "select event_id, counts::bigint as value from (select event_id, floor((lon + 2.0005::double) / 0.1::double)::int as px, floor((lat + 2.0005::double) / 0.1::double)::int as py from photons) left join (select * from img where counts > 4) using (px, py)", D.SQL)
def j8(spark, sf):
    binned = D.photons(spark, sf).select("event_id", F.floor((F.col("lon") + 2.0005) / 0.1).cast("int").alias("px"), F.floor((F.col("lat") + 2.0005) / 0.1).cast("int").alias("py"))
    return M.lookup(binned, _image(spark, sf).filter("value > 4"), ["px", "py"]).select("event_id", "value")


_IX, _IY = "((lon + 2.0005::double) / 0.1::double - 0.5)", "((lat + 2.0005::double) / 0.1::double - 0.5)"


@query("j9_interpolate", f", c as (select event_id, {_IX} as x, {_IY} as y, i, j from photons, range(2) a(i), range(2) b(j)), d as (select event_id, floor(x)::int + i as px, floor(y)::int + j as py, (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) as w from c) select event_id, round(sum(w * coalesce(counts, 0)), 6) as value from d left join img using (px, py) group by event_id", D.SQL)
def j9(spark, sf):
    events = D.photons(spark, sf).select("event_id", "lon", "lat")
    out = M.interpolate(events, (F.col("lon") + 2.0005) / 0.1 - 0.5, (F.col("lat") + 2.0005) / 0.1 - 0.5, _image(spark, sf))
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("j10_nearest_set_pixel", ", t as (select px, py from img where counts >= (select quantile_cont(counts, 0.95) from img)), q as (select px as qx, py as qy from img) select qx as px, qy as py, min(power(qx - px, 2) + power(qy - py, 2))::double as d2 from q, t group by all", D.SQL)
def j10(spark, sf):
    image = _image(spark, sf)
    set_ = image.crossJoin(F.broadcast(M.quantile(image, "value", 0.95))).filter("value >= limit")
    return M.nearest_set(image, set_)


_TWO = ", a as (select px, py, counts::bigint as v from cube where e = 0), b as (select px, py, counts::bigint as v from cube where e = 1)"


@query("j13_map_arithmetic", _TWO + " select coalesce(a.px, b.px) as px, coalesce(a.py, b.py) as py, coalesce(a.v, 0) - coalesce(b.v, 0) as value from a full join b on a.px = b.px and a.py = b.py", D.SQL)
def j13(spark, sf):
    cube = _cube(spark, sf)
    return M.combine(cube.filter("e = 0"), cube.filter("e = 1"), ["px", "py"], lambda x, y: x - y)


@query("j14_dot", "select px, sum(counts * (e + 1))::bigint as value from cube group by px", D.SQL)
def j14(spark, sf):
    weights = spark.range(4).select(F.col("id").cast("int").alias("e"), (F.col("id") + 1).alias("value"))
    return M.dot(_cube(spark, sf), F.broadcast(weights), ["e"], ["px"])


_FROM_GAL = _turned_sql("gl", "gb", tuple(zip(*sky.GALACTIC, strict=True)))


@query("j15_interpolate_map", f", g as (select tx, ty, {_tan_sky_sql('tx', 'ty', _GAL)[0]} as gl, {_tan_sky_sql('tx', 'ty', _GAL)[1]} as gb from (select x::int as tx, y::int as ty from range({_GAL.width}) a(x), range({_GAL.height}) b(y))), w as (select tx, ty, {_FROM_GAL[0]} / 0.1::double + 19.505::double as fx, {_FROM_GAL[1]} / 0.1::double + 19.505::double as fy from g), d as (select tx, ty, floor(fx)::int + i as px, floor(fy)::int + j as py, (case when i = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when j = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as w from w, range(2) a(i), range(2) b(j)) select tx, ty, round(sum(w * coalesce(counts, 0)), 6) as value from d left join img using (px, py) group by all", D.SQL)
def j15(spark, sf):
    """The image between its pixels at those of a tangent plane in Galactic coordinates."""
    return RP.interpolate(_image(spark, sf), _CAR, _GAL).select(F.col("px").alias("tx"), F.col("py").alias("ty"), F.round("value", 6).alias("value"))


_KERNEL = [(-1, 0, 1), (0, 0, 2), (1, 0, 1), (0, 1, 1), (0, -1, 1)]
_KSQL = "(values " + ", ".join(map(str, _KERNEL)) + ") k(dx, dy, w)"


@query("m1_convolve", f"select px + dx as px, py + dy as py, sum(counts * w)::bigint as value from img, {_KSQL} where px + dx between 0 and 40 and py + dy between 0 and 40 group by all", D.SQL)
def m1(spark, sf):
    return M.convolve(_image(spark, sf), _KERNEL, bounds=(41, 41))


@query("m1_convolve_tiles", f"select (px + dx)::bigint as px, (py + dy)::bigint as py, sum(counts * w)::bigint as value from img, {_KSQL} group by all", D.SQL)
def m1_tiles(spark, sf):
    """The same kernel by tiles and Fourier transforms, without a border."""
    kernel = np.zeros((3, 3))
    for dx, dy, w in _KERNEL:
        kernel[dx + 1, dy + 1] = w
    return M.convolve_tiles(_image(spark, sf), kernel, tile=16).select("px", "py", F.round("value").cast("bigint").alias("value"))


_MIRROR = "case when {v} < 0 then -1 - ({v}) when {v} > 40 then 81 - ({v}) else {v} end"


@query("m2_smooth_box", f", g as (select x::int as px, y::int as py from range(41) a(x), range(41) b(y)), d as (select px, py, {_MIRROR.format(v='px + i')} as sx, {_MIRROR.format(v='py + j')} as sy from g, range(-2, 3) a(i), range(-2, 3) b(j)) select d.px, d.py, round(sum(coalesce(counts, 0))::double / 25, 6) as value from d left join img on img.px = sx and img.py = sy group by all having sum(coalesce(counts, 0)) > 0", D.SQL)
def m2(spark, sf):
    return M.smooth_box(_image(spark, sf), 2, 41, 41).filter("value > 1e-9").select("px", "py", F.round("value", 6).alias("value"))


def _smooth_sql(kernel: str) -> str:
    """Smoothing with a kernel table (i, j, w) and mirrored borders."""
    return f", g as (select x::int as px, y::int as py from range(41) a(x), range(41) b(y)), k as ({kernel}), d as (select px, py, w, {_MIRROR.format(v='px + i')} as sx, {_MIRROR.format(v='py + j')} as sy from g, k) select d.px, d.py, round(sum(w * coalesce(counts, 0)) / (select sum(w) from k), 6) as value from d left join img on img.px = sx and img.py = sy group by all having sum(coalesce(counts, 0)) > 0"


@query("m2_smooth_gauss", _smooth_sql("select i, j, exp(-(i * i + j * j) / 2.42::double) as w from range(-4, 5) a(i), range(-4, 5) b(j)"), D.SQL)
def m2_gauss(spark, sf):
    return M.smooth_gauss(_image(spark, sf), 1.1, 41, 41).select("px", "py", F.round("value", 6).alias("value"))


@query("m2_smooth_disk", _smooth_sql("select i, j, 1.0::double as w from range(-3, 4) a(i), range(-3, 4) b(j) where i * i + j * j <= 9"), D.SQL)
def m2_disk(spark, sf):
    return M.smooth_disk(_image(spark, sf), 3, 41, 41).select("px", "py", F.round("value", 6).alias("value"))


_MASK = ", t as (select px, py from img where counts > (select quantile_cont(counts, 0.7) from img))"
_DISK = "(select i, j from range(-2, 3) a(i), range(-2, 3) b(j) where i * i + j * j <= 4)"


def _mask(spark, sf):
    image = _image(spark, sf)
    return image.crossJoin(F.broadcast(M.quantile(image, "value", 0.7))).filter("value > limit").select("px", "py", F.lit(1).alias("value"))


@query("m3_dilate", _MASK + f" select distinct (px + i)::int as px, (py + j)::int as py from t, {_DISK} where px + i between 0 and 40 and py + j between 0 and 40", D.SQL)
def m3(spark, sf):
    return M.dilate(_mask(spark, sf), 2, 41, 41).select("px", "py")


_DENSE = ", t as (select px, py from img where counts >= (select quantile_cont(counts, 0.1) from img))"


@query("m3_erode", _DENSE + " select (px + i)::int as px, (py + j)::int as py from t, (select i, j from range(-1, 2) a(i), range(-1, 2) b(j) where i * i + j * j <= 1) where px + i between 0 and 40 and py + j between 0 and 40 group by all having count(*) = 5", D.SQL)
def m3e(spark, sf):
    image = _image(spark, sf)
    dense = image.crossJoin(F.broadcast(M.quantile(image, "value", 0.1))).filter("value >= limit").select("px", "py", F.lit(1).alias("value"))
    return M.erode(spark, dense, 1, 41, 41).select("px", "py")


@query("m4_peaks", ", u as (select px + i as px, py + j as py, max(counts) as top from img, range(-2, 3) a(i), range(-2, 3) b(j) group by all) select img.px, img.py, counts::bigint as value from img join u using (px, py) where counts > 3 and counts >= top", D.SQL)
def m4(spark, sf):
    return M.peaks(_image(spark, sf), 3, 2)


@query("m5_peak_table", ", u as (select px + i as px, py + j as py, max(counts) as top from img, range(-2, 3) a(i), range(-2, 3) b(j) group by all) select img.px, img.py, counts::bigint as value, round(img.counts::double / 7, 6) as flux, round(sqrt(img.counts)::double / 7, 6) as flux_err from img join u using (px, py) where counts > 3 and counts >= top", D.SQL)
def m5(spark, sf):
    image = _image(spark, sf)
    flux = image.select("px", "py", F.round(F.col("value") / 7, 6).alias("flux"), F.round(F.sqrt("value") / 7, 6).alias("flux_err"))
    return M.peaks(image, 3, 2).join(flux, ["px", "py"])


@query("m6_pad_crop", "select (px + 2)::int as px, (py + 2)::int as py, counts::bigint as value from img where px between 10 and 30 and py between 5 and 35", D.SQL)
def m6(spark, sf):
    cut = _image(spark, sf).filter("px between 10 and 30 and py between 5 and 35")
    return cut.select((F.col("px") + 2).alias("px"), (F.col("py") + 2).alias("py"), "value")


@query("m7_boundary", "select px, py, (px < 2 or px > 38 or py < 2 or py > 38)::int as edge, (select count(*) from img where sqrt(power(px - 20, 2) + power(py - 20, 2)) < 5)::bigint as inside from img", D.SQL)
def m7(spark, sf):
    image = _image(spark, sf)
    n = image.agg(F.count_if(F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2)) < 5).alias("inside"))
    return image.crossJoin(F.broadcast(n)).select("px", "py", ((F.col("px") < 2) | (F.col("px") > 38) | (F.col("py") < 2) | (F.col("py") > 38)).cast("int").alias("edge"), "inside")


@query("w3_cumulative_radial", ", r as (select floor(sqrt(power(px - 20, 2) + power(py - 20, 2)) / 2.0003::double)::int as rad, avg(counts)::double * 2 * pi() * (floor(sqrt(power(px - 20, 2) + power(py - 20, 2)) / 2.0003::double) + 0.5) as v from img group by rad, floor(sqrt(power(px - 20, 2) + power(py - 20, 2)) / 2.0003::double)) select rad, round(sum(v) over (order by rad) - v, 5) as before, round(sum(v) over (order by rad), 5) as upto from r", D.SQL)
def w3(spark, sf):
    rad = F.floor(F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2)) / 2.0003).cast("int")
    rings = _image(spark, sf).groupBy(rad.alias("rad")).agg(F.avg("value").alias("v")).select("rad", (F.col("v") * 2 * F.pi() * (F.col("rad") + 0.5)).alias("value"))
    run = scan.running(scan.sliced(rings, [], ["rad"], store.Rounds(spark, "radial")), [], ["rad"], sums={"upto": F.col("value")})
    return run.select("rad", F.round(F.col("upto") - F.col("value"), 5).alias("before"), F.round("upto", 5).alias("upto"))


@query("w4_containment_level", ", c as (select e, counts, abs(sum(counts) over (partition by e order by counts desc, px, py rows between unbounded preceding and current row)::double / sum(counts) over (partition by e) - 0.68::double) as miss from cube) select e, min_by(counts, (miss, counts))::bigint as level from c group by e", D.SQL)
def w4(spark, sf):
    return scan.containment(_cube(spark, sf), ["e"], 0.68, [F.desc("value"), F.col("px"), F.col("py")], "value").withColumnRenamed("value", "level")


@query("w5_containment_radius", ", d as (select e, counts, px, py, sqrt(power(px - 20, 2) + power(py - 20, 2)) as r from cube), c as (select e, r, abs(sum(counts) over (partition by e order by r, px, py rows between unbounded preceding and current row)::double / sum(counts) over (partition by e) - 0.68::double) as miss from d) select e, round(min_by(r, (miss, r)), 6) as radius from c group by e", D.SQL)
def w5(spark, sf):
    far = _cube(spark, sf).withColumn("r", F.sqrt(F.pow(F.col("px") - 20, 2) + F.pow(F.col("py") - 20, 2)))
    return scan.containment(far, ["e"], 0.68, [F.col("r"), F.col("px"), F.col("py")], "r").select("e", F.round("r", 6).alias("radius"))


@query("u2_stack_maps", "select 'low' as band, px, py, counts::bigint as value from cube where e = 0 union all select 'high', px, py, counts::bigint from cube where e = 3", D.SQL)
def u2(spark, sf):
    cube = _cube(spark, sf)
    part = lambda e, name: cube.filter(F.col("e") == e).select(F.lit(name).alias("band"), "px", "py", "value")
    return part(0, "low").union(part(3, "high"))


@query("u4_region_union", "select count(*)::bigint as n from photons where sqrt(lon * lon + lat * lat) < 0.50003 or sqrt(power(lon - 0.4::double, 2) + lat * lat) < 0.50003", D.SQL)
def u4(spark, sf):
    regions = [sky.in_circle("lon", "lat", 0.0, 0.0, 0.50003), sky.in_circle("lon", "lat", 0.4, 0.0, 0.50003)]
    return S.select_region(D.photons(spark, sf), regions).agg(F.count("*").alias("n"))


@query("u5_slice", "select px, py, counts::bigint as value from cube where e = 2", D.SQL)
def u5(spark, sf):
    return _cube(spark, sf).filter("e = 2").select("px", "py", "value")


@query("io4_sparse_map", "select (py * 41 + px)::int as pix, e as channel, counts::bigint as value from cube where counts > 0", D.SQL)
def io4(spark, sf):
    """A cube written in sparse form, read back as a map and numbered again."""
    path = store.new_folder(spark, "sparse-map")
    store.write_sparse_map(_cube(spark, sf), path, 41)
    return store.read_sparse_map(spark, path, 41).select((F.col("py") * 41 + F.col("px")).alias("pix"), F.col("e").alias("channel"), "value")


@query("io5_spectrum_table", "select e as channel, sum(counts)::bigint as counts, round(e * 2.500013::double, 6) as e_min, round((e + 1) * 2.500013::double, 6) as e_max from cube group by e", D.SQL)
def io5(spark, sf):
    """A spectrum written by channel and edges, and read back."""
    path = store.new_folder(spark, "spectrum")
    store.write_spectrum(_cube(spark, sf).groupBy("e").agg(F.sum("value").alias("counts")), path, 2.500013)
    return spark.read.parquet(path).select("channel", "counts", F.round("e_min", 6).alias("e_min"), F.round("e_max", 6).alias("e_max"))


@query("t1_top_pixels", "select px, py, counts::bigint as value from img order by counts desc, px, py limit 25", D.SQL)
def t1(spark, sf):
    return _image(spark, sf).orderBy(F.desc("value"), "px", "py").limit(25)


@query("t2_peak_bin", "select px, min_by(e, (-counts, e)) as e_peak from cube where py = 20 group by px", D.SQL)
def t2(spark, sf):
    return _cube(spark, sf).filter("py = 20").groupBy("px").agg(F.max_by("e", F.struct("value", -F.col("e"))).alias("e_peak"))


@query("x1_user_reducer", "select px, quantile_cont(counts, 0.25)::double as value from cube group by px", D.SQL)
def x1(spark, sf):
    return M.reduce_with(_cube(spark, sf), ["px"], lambda s: float(s.quantile(0.25)))


@query("x2_per_observation", "select obs_id, count(*)::bigint as n, max(energy) as hardest from photons group by obs_id", D.SQL)
def x2(spark, sf):
    """A user's summary of each run, made of parts of it that are then merged."""

    def summary(rows):
        return rows.groupby("obs_id", as_index=False, dropna=False).agg(n=("event_id", "size"), hardest=("energy", "max"))

    def merge(parts):
        return parts.groupby("obs_id", as_index=False, dropna=False).agg(n=("n", "sum"), hardest=("hardest", "max"))

    return M.per_key(D.photons(spark, sf).select("obs_id", "event_id", "energy"), ["obs_id"], summary, "obs_id bigint, n bigint, hardest double", merge)
