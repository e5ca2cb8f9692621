"""Queries on time intervals and on joins of events and runs with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.operators import intervals as I
from photonlake.operators import scan
from photonlake.registry import query
from photonlake.sources import domain as D
from photonlake.sources import store

_UNION = """
, m as (select obs_id, start, stop, max(stop) over (partition by obs_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from gti)
, k as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by obs_id order by start, stop rows between unbounded preceding and current row) as island from m)
, merged as (select obs_id, min(start) as start, max(stop) as stop from k group by obs_id, island)
"""


@query("io2_intervals", "select obs_id, min(start) as first, max(stop) as last, count(*)::bigint as n from gti group by obs_id", D.SQL)
def io2(spark, sf):
    """Intervals written as seconds after a reference and read back."""
    path = store.new_folder(spark, "intervals")
    store.write_intervals(D.intervals(spark, sf), path, 694224000)
    return store.read_intervals(spark, path).groupBy("obs_id").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count("*").alias("n"))


@query("w1_interval_union", _UNION + "select * from merged", D.SQL)
def w1(spark, sf):
    return I.union(D.intervals(spark, sf), ["obs_id"])


@query(
    "w1_interval_union_global",
    """, m as (select start, stop, max(stop) over (order by start, stop rows between unbounded preceding and 1 preceding) as reach from gti)
, k as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (order by start, stop rows between unbounded preceding and current row) as island from m)
select min(start) as start, max(stop) as stop from k group by island""",
    D.SQL,
)
def w1_global(spark, sf):
    return scan.interval_union(D.intervals(spark, sf))


@query("g1_durations", "select obs_id, sum(stop - start)::bigint as duration, count(*)::bigint as n from gti group by obs_id", D.SQL)
def g1(spark, sf):
    return I.durations(D.intervals(spark, sf), ["obs_id"])


@query("g2_crop", "select obs_id, greatest(start, 800000000) as start, least(stop, 820000000) as stop, 'in' as how from gti where start <= 820000000 and stop > 800000000 union all select obs_id, start, stop, 'out' from gti where not (start <= 820000000 and stop > 800000000)", D.SQL)
def g2(spark, sf):
    gti = D.intervals(spark, sf)
    inside = I.crop(gti, 800000000, 820000000).withColumn("how", F.lit("in"))
    return inside.union(I.crop(gti, 800000000, 820000000, inverted=True).withColumn("how", F.lit("out")))


@query("g3_span", "select obs_id, min(start) as start, max(stop) as stop from gti group by obs_id", D.SQL)
def g3(spark, sf):
    return D.intervals(spark, sf).groupBy("obs_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


@query("g4_contiguous_axis", ", e as (select distinct obs_id, unnest([start, stop]) as lo from gti), l as (select obs_id, lo, lead(lo) over (partition by obs_id order by lo) as hi, (row_number() over (partition by obs_id order by lo) - 1)::int as idx from e) select obs_id, lo, hi, idx from l where hi is not null", D.SQL)
def g4(spark, sf):
    return I.contiguous(D.intervals(spark, sf), ["obs_id"])


@query("u1_stack", "select obs_id, start, stop from gti where obs_id % 2 = 0 union all select obs_id, start + 10, stop + 10 from gti where obs_id % 2 = 1", D.SQL)
def u1(spark, sf):
    gti = D.intervals(spark, sf)
    later = gti.filter("obs_id % 2 = 1").select("obs_id", (F.col("start") + 10).alias("start"), (F.col("stop") + 10).alias("stop"))
    return gti.filter("obs_id % 2 = 0").unionByName(later)


@query("u3_delete_interval", "select obs_id, start, least(stop, 800000000) as stop from gti where start < 800000000 union all select obs_id, greatest(start, 830000000), stop from gti where stop > 830000000", D.SQL)
def u3(spark, sf):
    return I.delete(D.intervals(spark, sf), 800000000, 830000000)


@query("j1_attach_observation", "select event_id, obs_id, lon_pnt, round(livetime, 5) as livetime from photons join obs using (obs_id)", D.SQL)
def j1(spark, sf):
    events = D.photons(spark, sf)
    return events.join(D.observations(events), "obs_id").select("event_id", "obs_id", "lon_pnt", F.round("livetime", 5).alias("livetime"))


#: Intervals near the photons: the run's order intervals moved into the month of the events.
_NEAR = ", near as (select obs_id, 1704067200 + (start % 2592000) as start, 1704067200 + (start % 2592000) + (stop - start) % 200000 as stop from gti)"


def _near(spark, sf):
    gti = D.intervals(spark, sf)
    start = 1704067200 + F.pmod("start", F.lit(2592000))
    return gti.select("obs_id", start.alias("start"), (start + F.pmod(F.col("stop") - F.col("start"), F.lit(200000))).alias("stop"))


@query("j2_events_in_intervals", _NEAR + " select event_id from photons p where exists (select 1 from near g where g.obs_id = p.obs_id and p.t_us // 1000000 >= g.start and p.t_us // 1000000 < g.stop)", D.SQL)
def j2(spark, sf):
    events = D.photons(spark, sf).withColumn("t_s", F.floor(F.col("t_us") / 1000000))
    return I.events_within(events, _near(spark, sf), "obs_id", "t_s", 43200).select("event_id")


_WINDOWS = [(0, 700000000, 760000000), (1, 760000000, 800000000), (2, 850000000, 900000000)]
_WSQL = ", w as (select * from (values (0, 700000000, 760000000), (1, 760000000, 800000000), (2, 850000000, 900000000)) t(w_idx, w_start, w_stop))"


def _windows(spark):
    return spark.createDataFrame(_WINDOWS, "w_idx int, w_start bigint, w_stop bigint")


@query("j3_runs_by_window", _WSQL + " select obs_id, w_idx, greatest(start, w_start)::bigint as start, least(stop, w_stop)::bigint as stop from gti join w on start <= w_stop and stop > w_start", D.SQL)
def j3(spark, sf):
    return I.overlapping(D.intervals(spark, sf), _windows(spark)).select("obs_id", "w_idx", "start", "stop")


@query("j4_time_bins", _WSQL + " select obs_id, start, coalesce((select min(w_idx) from w where start > w_start and start <= w_stop), -1)::int as t_idx from gti", D.SQL)
def j4(spark, sf):
    bins = _windows(spark).toDF("t_idx", "t_lo", "t_hi")
    return I.time_bin(D.intervals(spark, sf), "start", bins).select("obs_id", "start", "t_idx")


@query("j5_group_by_windows", _WSQL + " , x as (select obs_id, start, stop, (select min(w_idx) from w where start >= w_start - 1000 and stop <= w_stop + 1000) as w_idx from gti) select obs_id, start, stop, w_idx, case when w_idx is not null then 'normal' when stop <= 700000000 + 1000 then 'underflow' when start >= 900000000 - 1000 then 'overflow' else 'outflow' end as kind from x", D.SQL)
def j5(spark, sf):
    return I.group_by_windows(D.intervals(spark, sf), _windows(spark), 1000).select("obs_id", "start", "stop", "w_idx", "kind")
