"""Queries on projections, scalar functions and selections of events, observations and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions import sky
from photonlake.functions.axis import Axis, wrap
from photonlake.operators import selection as S
from photonlake.registry import query
from photonlake.sources import domain as D


def sep_sql(a: str, d: str, a0: str, d0: str) -> str:
    """The separation of ``functions.sky`` in SQL."""
    a, d, a0, d0 = (f"radians({x})" for x in (a, d, a0, d0))
    return (
        f"degrees(atan2(sqrt(power(cos({d0}) * sin({a0} - {a}), 2) + power(cos({d}) * sin({d0}) - sin({d}) * cos({d0}) * cos({a0} - {a}), 2)),"
        f" sin({d}) * sin({d0}) + cos({d}) * cos({d0}) * cos({a0} - {a})))"
    )


_EVENT_OBS = "photons p join obs o using (obs_id)"


def _located(spark, sf):
    events = D.photons(spark, sf)
    return S.with_pointing(events, D.observations(events), "lon_pnt", "lat_pnt", "livetime")


@query("io1_read_events", "select obs_id, count(*)::bigint as n, round(sum(energy), 4) as energy from (select obs_id, energy from photons where event_id % 2 = 0 union all select obs_id, energy from photons where event_id % 2 = 1) group by obs_id", D.SQL)
def io1(spark, sf):
    events = D.photons(spark, sf)
    stacked = events.filter("event_id % 2 = 0").unionByName(events.filter("event_id % 2 = 1").drop("phase"), allowMissingColumns=True)
    return stacked.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("energy"), 4).alias("energy"))


@query("p1_offset", f"select event_id, round({sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')}, 7) as offset from {_EVENT_OBS}", D.SQL)
def p1(spark, sf):
    return _located(spark, sf).select("event_id", F.round(sky.separation("lon", "lat", "lon_pnt", "lat_pnt"), 7).alias("offset"))


_M = sky.GALACTIC
_XYZ = [f"({r[0]!r}::double * cos(radians(lat)) * cos(radians(lon)) + {r[1]!r}::double * cos(radians(lat)) * sin(radians(lon)) + {r[2]!r}::double * sin(radians(lat)))" for r in _M]


@query("p2_galactic", f"select event_id, round(case when degrees(atan2({_XYZ[1]}, {_XYZ[0]})) < 0 then degrees(atan2({_XYZ[1]}, {_XYZ[0]})) + 360 else degrees(atan2({_XYZ[1]}, {_XYZ[0]})) end, 6) as l, round(degrees(asin({_XYZ[2]})), 6) as b, round(lon, 6) as lon_back, round(lat, 6) as lat_back from photons", D.SQL)
def p2(spark, sf):
    events = D.photons(spark, sf)
    l, b = sky.to_galactic("lon", "lat")
    there = events.withColumn("gl", l).withColumn("gb", b)
    lon, lat = sky.from_galactic("gl", "gb")
    back = F.when(lon > 180, lon - 360).otherwise(lon)
    return there.select("event_id", F.round("gl", 6).alias("l"), F.round("gb", 6).alias("b"), (F.round(back, 6) + 0.0).alias("lon_back"), (F.round(lat, 6) + 0.0).alias("lat_back"))


_FOVX = "(cos(radians(lat)) * cos(radians(lon) - radians(lon_pnt)) * cos(radians(lat_pnt)) + sin(radians(lat)) * sin(radians(lat_pnt)))"
_FOVY = "(cos(radians(lat)) * sin(radians(lon) - radians(lon_pnt)))"
_FOVZ = "(sin(radians(lat)) * cos(radians(lat_pnt)) - cos(radians(lat)) * cos(radians(lon) - radians(lon_pnt)) * sin(radians(lat_pnt)))"


@query("p3_field_of_view", f"select event_id, round(-degrees(atan2({_FOVY}, {_FOVX})), 6) + 0.0::double as fov_lon, round(degrees(asin({_FOVZ})), 6) + 0.0::double as fov_lat, round(lon, 6) + 0.0::double as lon_back, round(lat, 6) + 0.0::double as lat_back from {_EVENT_OBS}", D.SQL)
def p3(spark, sf):
    x, y = sky.to_fov("lon", "lat", "lon_pnt", "lat_pnt")
    there = _located(spark, sf).withColumn("x", x).withColumn("y", y)
    lon, lat = sky.from_fov("x", "y", "lon_pnt", "lat_pnt")
    return there.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((F.col("x"), "fov_lon"), (F.col("y"), "fov_lat"), (lon, "lon_back"), (lat, "lat_back"))])


@query("p4_mirrored", f"select event_id, round({sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')}, 5) as distance, round({sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} * 2, 5) as apart from {_EVENT_OBS}", D.SQL)
def p4(spark, sf):
    lon, lat = sky.rotate_about("lon", "lat", "lon_pnt", "lat_pnt", 180.0)
    turned = _located(spark, sf).withColumn("mlon", lon).withColumn("mlat", lat)
    return turned.select("event_id", F.round(sky.separation("mlon", "mlat", "lon_pnt", "lat_pnt"), 5).alias("distance"), F.round(sky.separation("mlon", "mlat", "lon", "lat"), 5).alias("apart"))


@query("p5_mission_time", "select event_id, round((t_us - 1577836800000000)::double / 1e6::double, 6) as met, t_us as back_us from photons", D.SQL)
def p5(spark, sf):
    met = D.photons(spark, sf).select("event_id", ((F.col("t_us") - 1577836800000000) / 1e6).alias("met"))
    return met.select("event_id", F.round("met", 6).alias("met"), (F.round(F.col("met") * 1e6).cast("bigint") + 1577836800000000).alias("back_us"))


@query("p6_dead_time", "select obs_id, round(ontime, 6) as ontime, round(livetime, 6) as livetime, round(case when ontime > 0 then 1 - livetime / ontime end, 9) as dead from obs", D.SQL)
def p6(spark, sf):
    obs = D.observations(D.photons(spark, sf))
    return obs.select("obs_id", F.round("ontime", 6).alias("ontime"), F.round("livetime", 6).alias("livetime"), F.round(F.when(F.col("ontime") > 0, 1 - F.col("livetime") / F.col("ontime")), 9).alias("dead"))


_P7 = """, a as (select 'lin' as axis, i::int as idx, 2 + i * 2.0::double as lo, 2 + (i + 1) * 2.0::double as hi from range(5) t(i)
union all select 'log', i::int, exp(ln(0.1::double) + i * (ln(100) - ln(0.1::double)) / 12), exp(ln(0.1::double) + (i + 1) * (ln(100) - ln(0.1::double)) / 12) from range(12) t(i)
union all select 'sqrt', i::int, power(i * 10.0::double / 4, 2), power((i + 1) * 10.0::double / 4, 2) from range(4) t(i))
select axis, idx, round(lo, 8) as lo, round(hi, 8) as hi, count(event_id)::bigint as n from a left join photons on energy + 0.00001234::double >= lo and energy + 0.00001234::double < hi group by all"""


@query("p7_axis_edges", _P7, D.SQL)
def p7(spark, sf):
    """Edges of axes of three rules, with the photons in each bin."""
    axes = (Axis.from_bounds("lin", 2, 12, 5), Axis.from_bounds("log", 0.1, 100, 4, "log", per_decade=True), Axis.from_bounds("sqrt", 0, 100, 4, "sqrt"))
    edges = reduce(DataFrame.union, [a.table(spark).select(F.lit(a.name).alias("axis"), "idx", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi")) for a in axes])
    e = F.col("energy") + 0.00001234  # off all edges
    hits = F.explode(F.array(*[F.struct(F.lit(a.name).alias("axis"), a.index(e).cast("int").alias("idx")) for a in axes]))
    n = D.photons(spark, sf).select(hits.alias("h")).groupBy("h.axis", "h.idx").agg(F.count("*").alias("n"))
    return edges.join(F.broadcast(n), ["axis", "idx"], "left").select("axis", "idx", "lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


_LOG = "((ln(energy) - ln(0.0123::double)) / ((ln(123) - ln(0.0123::double)) / 8) - 0.5)"


@query("p8_axis_pixels", f"select event_id, round({_LOG}, 7) as pix, round(energy, 6) as back from photons", D.SQL)
def p8(spark, sf):
    axis = Axis.from_bounds("energy", 0.0123, 123.0, 8, "log")
    out = D.photons(spark, sf).select("event_id", axis.pixel(F.col("energy")).alias("pix"))
    return out.select("event_id", F.round("pix", 7).alias("pix"), F.round(axis.coordinate(F.col("pix")), 6).alias("back"))


@query("p9_axis_index", "select event_id, case when energy > 20.5 then -1 when energy = 20.5 then 3 when energy >= 5.05 then 2 when energy >= 1.015 then 1 when energy >= 0.105 then 0 else -1 end::int as idx, case when energy >= 5.05 then 2 when energy >= 1.015 then 1 else 0 end::int as clipped from photons", D.SQL)
def p9(spark, sf):
    axis = Axis("energy", (0.105, 1.015, 5.05, 20.5), "log")
    e = F.col("energy")
    return D.photons(spark, sf).select("event_id", axis.index(e).cast("int").alias("idx"), axis.index(e, clip=True).cast("int").alias("clipped"))


@query("p10_periodic_wrap", "select event_id, round(-0.25::double + ((phase * 3 + 0.25::double) - floor(phase * 3 + 0.25::double)), 7) as wrapped from photons", D.SQL)
def p10(spark, sf):
    return D.photons(spark, sf).select("event_id", F.round(wrap(F.col("phase") * 3, -0.25, 1.0), 7).alias("wrapped"))


@query("p11_nearest_edge", "select event_id, case when energy < (0.1::double + 1.03) / 2 then 0.1 when energy < (1.03::double + 10.07) / 2 then 1.03 else 10.07 end::double as edge from photons", D.SQL)
def p11(spark, sf):
    return D.photons(spark, sf).select("event_id", Axis("energy", (0.1, 1.03, 10.07)).nearest_edge(F.col("energy")).alias("edge"))


_W = "(sin(radians(lat)) * sin(radians(0.5)) + cos(radians(lat)) * cos(radians(0.5)) * cos(radians(lon) - radians(1.0)))"


@query("p12_projections", f"select event_id, round(-(lon - 1.0) / 0.05::double, 6) + 0.0::double as car_x, round((lat - 0.5::double) / 0.05::double, 6) + 0.0::double as car_y, round(-degrees(cos(radians(lat)) * sin(radians(lon) - radians(1.0)) / {_W}) / 0.05::double, 5) + 0.0::double as tan_x, round(degrees((sin(radians(lat)) * cos(radians(0.5)) - cos(radians(lat)) * sin(radians(0.5)) * cos(radians(lon) - radians(1.0))) / {_W}) / 0.05::double, 5) + 0.0::double as tan_y, round(lon, 6) + 0.0::double as lon_back, round(lat, 6) + 0.0::double as lat_back from photons", D.SQL)
def p12(spark, sf):
    cx, cy = sky.car_pixel("lon", "lat", 1.0, 0.5, 0.05)
    tx, ty = sky.tan_pixel("lon", "lat", 1.0, 0.5, 0.05)
    out = D.photons(spark, sf).select("event_id", cx.alias("cx"), cy.alias("cy"), tx.alias("tx"), ty.alias("ty"))
    lon, lat = sky.tan_world("tx", "ty", 1.0, 0.5, 0.05)
    z = lambda c, n, k: (F.round(c, k) + 0.0).alias(n)
    return out.select("event_id", z(F.col("cx"), "car_x", 6), z(F.col("cy"), "car_y", 6), z(F.col("tx"), "tan_x", 5), z(F.col("ty"), "tan_y", 5), z(lon, "lon_back", 6), z(lat, "lat_back", 6))


@query("p14_solid_angle", "select py, round((sin(radians((py + 0.5::double) * 0.1 - 2)) - sin(radians((py - 0.5::double) * 0.1 - 2))) * radians(0.1), 12) as sr from (select distinct py from cube)", D.SQL)
def p14(spark, sf):
    pixels = D.counts_map(D.photons(spark, sf)).select("py").distinct()
    return pixels.select("py", F.round(sky.car_solid_angle("py", -2.0, 0.1), 12).alias("sr"))


_DT = "((t_us - 1704067200000000)::double / 1e6::double)"
_PHI = f"(0.1::double + {_DT} * (0.001::double + {_DT} / 2 * (1e-10::double + {_DT} / 3 * 1e-17::double)))"


@query("p15_pulsar_phase", f"select event_id, round({_PHI} - floor({_PHI}), 6) as pulse from photons", D.SQL)
def p15(spark, sf):
    t = (F.col("t_us") - 1704067200000000) / 1e6
    return D.photons(spark, sf).select("event_id", F.round(sky.phase(t, 0.0, 0.1, 0.001, 1e-10, 1e-17), 6).alias("pulse"))


@query("p16_rename", 'select event_id as "EVENT_ID", round(energy, 6) as "ENERGY", round(lon, 6) as "RA", round(lat, 6) as "DEC" from photons', D.SQL)
def p16(spark, sf):
    out = D.photons(spark, sf).select("event_id", *[F.round(c, 6).alias(c) for c in ("energy", "lon", "lat")])
    return out.withColumnsRenamed({"event_id": "EVENT_ID", "energy": "ENERGY", "lon": "RA", "lat": "DEC"})


_IDS = "select event_id, round(energy, 6) as energy"


@query("f1_select_energy", f"{_IDS} from photons where energy >= 1 and energy < 10", D.SQL)
def f1(spark, sf):
    return S.select_range(D.photons(spark, sf), "energy", 1.0, 10.0).select("event_id", F.round("energy", 6).alias("energy"))


@query("f2_select_time", f"{_IDS} from photons where not (t_us >= 1704500000000000 and t_us < 1705500000000000)", D.SQL)
def f2(spark, sf):
    return S.select_time(D.photons(spark, sf), "t_us", 1704500000000000, 1705500000000000, inverted=True).select("event_id", F.round("energy", 6).alias("energy"))


@query("f3_select_values", "select event_id from photons where event_type in ('click', 'view') and phase in (0.25, 0.5, 0.75)", D.SQL)
def f3(spark, sf):
    events = S.select_values(D.photons(spark, sf), "event_type", ["click", "view"])
    return S.select_values(events, "phase", [0.25, 0.5, 0.75, float("nan")]).select("event_id")


@query("f4_select_offset", f"select event_id from {_EVENT_OBS} where {sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} between 0.3 and 0.9", D.SQL)
def f4(spark, sf):
    placed = _located(spark, sf).withColumn("offset", sky.separation("lon", "lat", "lon_pnt", "lat_pnt"))
    return S.select_range(placed, "offset", 0.3, 0.9).select("event_id")


_POLY = [(-1.9005, -1.9005), (-0.5005, -1.7005), (-0.8005, -0.6005), (-1.7005, -0.9005)]


def _poly_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(_POLY, _POLY[1:] + _POLY[:1], strict=True):
        parts.append(f"(case when ({y1} > lat) <> ({y2} > lat) and lon < ({x2 - x1!r})::double * (lat - ({y1})) / ({y2 - y1!r})::double + ({x1}) then 1 else 0 end)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(
    "f5_select_region",
    f"select event_id from photons where sqrt(lon * lon + lat * lat) < 0.30005 or (sqrt(power(lon - 1, 2) + power(lat - 1, 2)) < 0.50005 and not sqrt(power(lon - 1, 2) + power(lat - 1, 2)) < 0.20005)"
    " or (abs((lon - 1) * cos(radians(30)) + (lat + 1) * sin(radians(30))) < 0.40003 and abs((lat + 1) * cos(radians(30)) - (lon - 1) * sin(radians(30))) < 0.15003)"
    f" or power(2 * (lon + 1) / 0.80003, 2) + power(2 * (lat - 1) / 0.40003, 2) < 1 or {_poly_sql()}",
    D.SQL,
)
def f5(spark, sf):
    regions = [
        sky.in_circle("lon", "lat", 0.0, 0.0, 0.30005),
        sky.in_annulus("lon", "lat", 1.0, 1.0, 0.20005, 0.50005),
        sky.in_rectangle("lon", "lat", 1.0, -1.0, 0.80006, 0.30006, 30.0),
        sky.in_ellipse("lon", "lat", -1.0, 1.0, 0.80003, 0.40003),
        sky.in_polygon("lon", "lat", _POLY),
    ]
    return S.select_region(D.photons(spark, sf), regions).select("event_id")


_PIX = "floor((lon + 2.0005::double) / 0.1::double)::int as px, floor((lat + 2.0005::double) / 0.1::double)::int as py"


@query("f6_select_mask", f"select event_id from (select event_id, {_PIX} from photons) join (select px, py from img where counts % 3 = 1) using (px, py)", D.SQL)
def f6(spark, sf):
    events = D.photons(spark, sf)
    mask = D.image(D.counts_map(events)).select("px", "py", (F.col("counts") % 3 == 1).cast("int").alias("value"))
    binned = events.withColumn("px", F.floor((F.col("lon") + 2.0005) / 0.1).cast("int")).withColumn("py", F.floor((F.col("lat") + 2.0005) / 0.1).cast("int"))
    return S.select_mask(binned, mask, ["px", "py"]).select("event_id")


@query("f7_select_radius", f"select event_id from (select event_id, energy, {sep_sql('p.lon', 'p.lat', 'o.lon_pnt', 'o.lat_pnt')} as away from {_EVENT_OBS}) where (energy >= 0.1 and energy < 1 and away <= 0.60003) or (energy >= 1 and energy < 10 and away <= 0.40003) or (energy >= 10 and energy < 100 and away <= 0.20003)", D.SQL)
def f7(spark, sf):
    table = spark.createDataFrame([(0.1, 1.0, 0.60003), (1.0, 10.0, 0.40003), (10.0, 100.0, 0.20003)], "lo double, hi double, rad_max double")
    placed = _located(spark, sf).withColumn("offset", sky.separation("lon", "lat", "lon_pnt", "lat_pnt"))
    return S.in_radius_table(placed, table, "energy", "offset").select("event_id")


@query("f8_select_rows", f"{_IDS} from photons where event_id in (0, 3, 5, 100, 999)", D.SQL)
def f8(spark, sf):
    return S.select_rows(D.photons(spark, sf), "event_id", [0, 3, 5, 100, 999]).select("event_id", F.round("energy", 6).alias("energy"))


@query("f9_select_obs_ids", "select obs_id, n_events from obs where obs_id in (select distinct obs_id from photons where obs_id % 4 = 1)", D.SQL)
def f9(spark, sf):
    events = D.photons(spark, sf)
    return S.select_ids(D.observations(events), events.select("obs_id").filter("obs_id % 4 = 1").distinct()).select("obs_id", "n_events")


@query("f10_select_box", "select obs_id from obs where lon_pnt = 0.5 and not (n_events >= 60 and n_events < 70)", D.SQL)
def f10(spark, sf):
    obs = D.observations(D.photons(spark, sf))
    return S.select_box(S.select_box(obs, "lon_pnt", 0.5, 0.5), "n_events", 60, 70, inverted=True).select("obs_id")


@query("f11_select_span", "select obs_id, 'inside' as how from obs where t0 >= 1704100000000000 and t1 <= 1706640000000000 union all select obs_id, 'overlap' from obs where t1 >= 1704100000000000 and t0 <= 1704110000000000 union all select obs_id, 'out' from obs where not (t0 >= 1704100000000000 and t1 <= 1706640000000000)", D.SQL)
def f11(spark, sf):
    obs = D.observations(D.photons(spark, sf))
    a, b = 1704100000000000, 1706640000000000
    parts = ((S.select_span(obs, a, b), "inside"), (S.select_span(obs, a, 1704110000000000, partial_overlap=True), "overlap"), (S.select_span(obs, a, b, inverted=True), "out"))
    out = [p.select("obs_id", F.lit(how).alias("how")) for p, how in parts]
    return out[0].union(out[1]).union(out[2])


@query("f12_select_cone", f"select obs_id from obs where {sep_sql('lon_pnt', 'lat_pnt', '0.4', '0.1')} < 0.6", D.SQL)
def f12(spark, sf):
    return S.select_cone(D.observations(D.photons(spark, sf)), "lon_pnt", "lat_pnt", 0.4, 0.1, 0.5, border=0.1).select("obs_id")


@query("f13_select_observations", f"select obs_id from obs where {sep_sql('lon_pnt', 'lat_pnt', '0.0', '0.0')} < 1.0 and t1 >= 1704100000000000 and t0 <= 1704400000000000 and n_events >= 50 and n_events < 80", D.SQL)
def f13(spark, sf):
    obs = D.observations(D.photons(spark, sf))
    criteria = [
        lambda d: S.select_cone(d, "lon_pnt", "lat_pnt", 0.0, 0.0, 1.0),
        lambda d: S.select_span(d, 1704100000000000, 1704400000000000, partial_overlap=True),
        lambda d: S.select_box(d, "n_events", 50, 80),
    ]
    for c in criteria:
        obs = c(obs)
    return obs.select("obs_id")


@query("f14_filter_phase", "select obs_id, count(*)::bigint as n, round(max(livetime) * 0.2::double, 5) as livetime from photons join obs using (obs_id) where (phase >= 0.895 or phase < 0.095) and t_us >= 1704100000000000 and t_us < 1706600000000000 group by obs_id", D.SQL)
def f14(spark, sf):
    windows = [(0.895, 1.095)]
    events = S.select_phase(S.select_time(_located(spark, sf), "t_us", 1704100000000000, 1706600000000000), "phase", windows)
    return events.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.max("livetime") * S.live_fraction(windows), 5).alias("livetime"))


@query("f15_required_tables", "select obs_id from (select distinct obs_id, event_type from photons) group by obs_id having count(*) filter (where event_type in ('click', 'view', 'error')) = 3", D.SQL)
def f15(spark, sf):
    index = D.photons(spark, sf).groupBy("obs_id").agg(F.collect_set("event_type").alias("has"))
    return index.filter(F.size(F.array_intersect("has", F.array(*map(F.lit, ("click", "view", "error"))))) == 3).select("obs_id")


@query("f16_catalog_names", "select source_id, trim(a) as alias from (select source_id, unnest(list_concat([name], string_split(aliases, ','))) as a from sources) where trim(a) in ('A3', 'B5', 'C7', 'Supplier#000000004')", D.SQL)
def f16(spark, sf):
    return S.aliases(D.catalog(spark, sf)).filter(F.col("alias").isin("A3", "B5", "C7", "Supplier#000000004"))


@query("f17_select_dataset", "select g.obs_id, g.first, g.last from (select obs_id, min(start) as first, max(stop) as last from gti group by obs_id) g where g.first >= 694224000 and g.last < 1000000000", D.SQL)
def f17(spark, sf):
    spans = D.intervals(spark, sf).groupBy("obs_id").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    return spans.filter((F.col("first") >= 694224000) & (F.col("last") < 1000000000))
