"""Event lists, observations, time intervals, light curves and catalogs, read from the generic tables.

Values that decide bins are integers or lie off all bin edges, so that any engine bins them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dead time leaves this fraction of the on-time.
LIVE_FRACTION = 0.95


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, event_id, event_type, time, t_us, energy, phase, lon, lat): one row per photon, in a field of 4 x 4 degrees."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("obs_id"),
        "event_id",
        "event_type",
        F.col("ts").alias("time"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.col("value") / 10).alias("energy"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("phase"),
        (F.pmod(F.col("event_id") * 7919, F.lit(4001)) / 1000 - 2).alias("lon"),
        (F.pmod(F.col("event_id") * 104729, F.lit(4001)) / 1000 - 2).alias("lat"),
    )


def observations(events: DataFrame) -> DataFrame:
    """The observation index of an event list: a row per run with its span, pointing, on-time and live time."""
    o = events.groupBy("obs_id").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.count("*").alias("n_events"))
    return o.select(
        "obs_id",
        "t0",
        "t1",
        "n_events",
        ((F.pmod("obs_id", F.lit(5)) - 2) * 0.5).alias("lon_pnt"),
        ((F.pmod("obs_id", F.lit(3)) - 1) * 0.5).alias("lat_pnt"),
        ((F.col("t1") - F.col("t0")) / 1e6).alias("ontime"),
        ((F.col("t1") - F.col("t0")) / 1e6 * LIVE_FRACTION).alias("livetime"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, start, stop): good time intervals in seconds."""
    o = read(spark, sf_dir, "orders")
    start = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000).cast("bigint")
    return o.select(F.col("o_custkey").alias("obs_id"), start.alias("start"), (start + F.floor("o_totalprice").cast("bigint") * 10).alias("stop"))


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, flux, err): a light curve per supplier; fluxes are exact sums of cents."""
    li = read(spark, sf_dir, "lineitem")
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400000000).cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    flux = li.groupBy(F.col("l_suppkey").alias("series"), day.alias("day")).agg((F.sum(cents) / 100).alias("flux"))
    return flux.withColumn("err", F.col("flux") * 0.05 + F.pmod("day", F.lit(7)))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, name, aliases, lon, lat, index, amplitude): a source catalog."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("source_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("A"), k, F.lit(", B"), k, F.lit(" ,C"), k).alias("aliases"),
        (F.pmod(k * 7919, F.lit(3600)) / 10).alias("lon"),
        (F.pmod(k * 104729, F.lit(1601)) / 10 - 80).alias("lat"),
        (F.pmod(k, F.lit(20)) / 10 + 1.55).alias("index"),
        (F.pmod(k, F.lit(50)) + 1).cast("double").alias("amplitude"),
    )


def band_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, flux array): catalog rows with fluxes by band."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("flux"))


def response_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(irf_id, kind, energy, offset, value): effective area, energy bias and background rate of each response, on eight energies and eight offsets of its own.

    Embeddings lend their values; those of fewer than 64 components are no response.
    """
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("irf_id"), F.col("embedding").cast("array<double>").alias("x")).filter(F.size("x") >= 64)
    k = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")
    n = v.select("irf_id", "x", k).withColumn("c", F.abs(F.get("x", F.col("k")))).withColumn("i", F.floor(F.col("k") / 8).cast("double")).withColumn("j", (F.col("k") % 8).cast("double"))
    energy = 0.05 * (1 + 0.1 * (F.col("irf_id") % 4)) * F.pow(F.lit(4.0), "i")
    offset = 0.4 * (1 + 0.05 * (F.col("irf_id") % 3)) * F.col("j")
    kinds = {
        "aeff": (F.col("i") + 1) * (F.col("i") + 1) / (1 + 0.3 * F.col("j")) * (1 + F.col("c") / 2),
        "bias": 0.8 / ((F.col("i") + 1) * (F.col("i") + 1)) - 0.05 * F.col("c"),
        "bkg": (0.1 + F.col("c")) / ((F.col("i") + 1) * (F.col("i") + 1) * (F.col("i") + 1) * (F.col("j") + 1)),
    }
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), x.alias("value")) for name, x in kinds.items()])).alias("v")
    return n.select("irf_id", energy.alias("energy"), offset.alias("offset"), values).select("irf_id", "v.kind", "energy", "offset", "v.value")


def run_responses(spark: SparkSession, sf_dir: str, obs: DataFrame) -> DataFrame:
    """The runs with the name of their response and the energies that it gives as safe (null: none)."""
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_irf"))
    named = obs.crossJoin(F.broadcast(n)).withColumn("irf_id", F.col("obs_id") % F.col("n_irf")).drop("n_irf")
    return named.withColumn("lo_thres", F.when(F.col("irf_id") % 2 == 1, 2.5)).withColumn("hi_thres", F.when(F.col("irf_id") % 5 == 0, 7.6))


def counts_map(events: DataFrame) -> DataFrame:
    """(px, py, e, counts): a counts cube with 41 x 41 pixels of 0.1 degrees and four energy bins of 2.5."""
    px = F.floor((F.col("lon") + 2.0005) / 0.1).cast("int")
    py = F.floor((F.col("lat") + 2.0005) / 0.1).cast("int")
    e = F.floor(F.col("energy") / 2.500013).cast("int")
    return events.groupBy(px.alias("px"), py.alias("py"), e.alias("e")).agg(F.count("*").alias("counts")).filter("e between 0 and 3")


#: The same tables as common table expressions.
SQL = """
with photons as (
  select user_id as obs_id, event_id, event_type, ts as time, epoch_us(ts) as t_us, value / 10 as energy,
    json_extract_string(props, '$.k')::double / 100 as phase,
    ((event_id * 7919) % 4001)::double / 1000 - 2 as lon, ((event_id * 104729) % 4001)::double / 1000 - 2 as lat from events
), obs as (
  select obs_id, min(t_us) as t0, max(t_us) as t1, count(*) as n_events, ((obs_id % 5) - 2) * 0.5::double as lon_pnt,
    ((obs_id % 3) - 1) * 0.5::double as lat_pnt, (max(t_us) - min(t_us))::double / 1e6::double as ontime,
    (max(t_us) - min(t_us))::double / 1e6::double * 0.95::double as livetime from photons group by obs_id
), gti as (
  select o_custkey as obs_id, (epoch_us(o_orderdate) // 1000000)::bigint as start,
    (epoch_us(o_orderdate) // 1000000)::bigint + floor(o_totalprice)::bigint * 10 as stop from orders
), lc as (
  select l_suppkey as series, (epoch_us(l_shipdate) // 86400000000)::bigint as day, sum(round(l_extendedprice * 100)::bigint)::double / 100 as flux from lineitem group by all
), curves as (
  select series, day, flux, flux * 0.05::double + (day % 7) as err from lc
), sources as (
  select s_suppkey as source_id, s_name as name, 'A' || s_suppkey || ', B' || s_suppkey || ' ,C' || s_suppkey as aliases,
    ((s_suppkey * 7919) % 3600)::double / 10 as lon, ((s_suppkey * 104729) % 1601)::double / 10 - 80 as lat,
    (s_suppkey % 20)::double / 10 + 1.55::double as index, (s_suppkey % 50 + 1)::double as amplitude from supplier
), bands as (
  select vec_id, list_transform(embedding, lambda x: abs(x::double)) as flux from embeddings
), cube as (
  select floor((lon + 2.0005::double) / 0.1::double)::int as px, floor((lat + 2.0005::double) / 0.1::double)::int as py,
    floor(energy / 2.500013::double)::int as e, count(*) as counts from photons where floor(energy / 2.500013::double) between 0 and 3 group by all
), img as (
  select px, py, sum(counts)::bigint as counts from cube group by all
)
"""

#: Responses, their values in lists, for each run (after ``SQL``).
IRF_SQL = """
, irf as (
  select vec_id as irf_id, list_transform(range(8), lambda i: 0.05::double * (1 + 0.1::double * (vec_id % 4)) * power(4.0::double, i)) as en,
    list_transform(range(8), lambda j: 0.4::double * (1 + 0.05::double * (vec_id % 3)) * j) as off,
    list_transform(range(64), lambda k: (k // 8 + 1) * (k // 8 + 1) / (1 + 0.3::double * (k % 8)) * (1 + abs(embedding[k + 1]::double) / 2)) as aeff,
    list_transform(range(64), lambda k: 0.8::double / ((k // 8 + 1) * (k // 8 + 1)) - 0.05::double * abs(embedding[k + 1]::double)) as bias,
    list_transform(range(64), lambda k: (0.1::double + abs(embedding[k + 1]::double)) / ((k // 8 + 1) * (k // 8 + 1) * (k // 8 + 1) * (k % 8 + 1))) as bkg
  from embeddings
), runs_irf as (
  select obs.*, irf.*, case when irf_id % 2 = 1 then 2.5::double end as lo_thres, case when irf_id % 5 = 0 then 7.6::double end as hi_thres
  from obs join irf on irf_id = obs_id % (select count(*) from embeddings)
)
"""


def image(cube: DataFrame) -> DataFrame:
    """(px, py, counts): the cube summed over energy."""
    return cube.groupBy("px", "py").agg(F.sum("counts").alias("counts"))
