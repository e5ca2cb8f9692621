"""From observations to data sets: safe ranges from responses, reflected off regions, theta-squared, light curves.

A run's response is rows (keys..., e, e_lo, e_hi, aeff, bias, bkg, lo_thres, hi_thres), one per energy bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions import tails

METHODS = ("aeff_default", "aeff_max", "edisp_bias", "bkg_peak", "bkg_invalid")


def safe_bins(responses: DataFrame, keys: list[str], aeff_percent: float = 10.0, bias_percent: float = 10.0) -> DataFrame:
    """The bins with a column per method: whether the bin is safe by it.

    ``aeff_default``: inside the thresholds that the response names (null: none). ``aeff_max``: from the lowest bin
    whose area exceeds a share of the run's largest. ``edisp_bias``: from the energy where the bias falls to its limit,
    interpolated in log energy between bin centers. ``bkg_peak``: from the bin with the largest background (the first of
    equal ones). ``bkg_invalid``: where the background is finite and positive.
    """
    run = Window.partitionBy(*keys)
    by_e = run.orderBy("e")
    center = F.log((F.col("e_lo") + F.col("e_hi")) / 2)
    limit = bias_percent / 100
    rows = responses.withColumn("_next", F.lead("bias").over(by_e)).withColumn("_c", center).withColumn("_cn", F.lead(center).over(by_e))
    cross = F.exp(F.col("_c") + (F.col("bias") - limit) / (F.col("bias") - F.col("_next")) * (F.col("_cn") - F.col("_c")))
    falls = (F.col("bias") > limit) & (F.col("_next") <= limit)
    rows = rows.withColumn("_most", F.max("aeff").over(run))
    sums = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("aeff") > aeff_percent / 100 * F.col("_most"), F.col("e_lo"))).alias("_area"),
        F.max(F.when(falls, cross)).alias("_cross"),
        F.min("bias").alias("_least"),
        F.max("_c").alias("_last"),
        F.max_by("e_lo", F.struct(F.coalesce("bkg", F.lit(0.0)), -F.col("e"))).alias("_peak"),
    )
    from_bias = F.coalesce("_cross", F.when(F.col("_least") > limit, F.exp("_last")).otherwise(F.lit(0.0)))
    low, high = F.col("e_lo"), F.col("e_hi")
    return (
        responses.join(sums, keys)
        .withColumn("aeff_default", (low >= F.coalesce("lo_thres", low)) & (high <= F.coalesce("hi_thres", high)))
        .withColumn("aeff_max", F.coalesce(low >= F.col("_area"), F.lit(False)))
        .withColumn("edisp_bias", low >= from_bias)
        .withColumn("bkg_peak", low >= F.col("_peak"))
        .withColumn("bkg_invalid", F.coalesce((F.col("bkg") > 0) & ~F.isnan("bkg") & (F.col("bkg") < float("inf")), F.lit(False)))
        .drop("_area", "_cross", "_least", "_last", "_peak")
    )


def reflected(obs: DataFrame, radius: float, excluded: list[tuple[float, float, float]], increment: float = 0.1, first: float = 0.1) -> DataFrame:
    """The rows of ``obs`` (lon_pnt, lat_pnt, ...) with ``regions``: centers of the off regions that reflect a circle about the origin.

    The circle is turned about the pointing, from its own angular size and ``first`` on; a region that touches an
    excluded circle (x, y, radius) makes way by ``increment``, one that serves by the angular size. A pointing inside
    the circle has no regions. The walk is one fold over the steps that a full turn can hold, made once for each pointing
    and settled by a generator of one row, since a filter on regions would otherwise repeat it; pointings are few bytes
    and much work, so they are dealt to a fixed number of tasks.
    """
    spark = obs.sparkSession
    pointing = ["lon_pnt", "lat_pnt"]
    away = F.sqrt(F.col("lon_pnt") * F.col("lon_pnt") + F.col("lat_pnt") * F.col("lat_pnt"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = obs.select(*pointing).distinct().repartition(tasks, *pointing).withColumn("_size", F.when(away > radius, 2 * F.asin(radius / away))).filter("_size is not null")
    steps = F.sequence(F.lit(1), F.ceil(2 * math.pi / F.least(F.lit(increment), F.col("_size"))).cast("int") + 1)
    none = F.expr("cast(array() as array<struct<x: double, y: double>>)")
    lp, bp = F.col("lon_pnt"), F.col("lat_pnt")

    def turned(s: Column, p: Column) -> Column:
        clash = F.lit(False)
        for ex, ey, er in excluded:
            clash = clash | ((p["x"] - ex) * (p["x"] - ex) + (p["y"] - ey) * (p["y"] - ey) < (radius + er) ** 2)
        makes_way = F.struct((s["angle"] + increment).alias("angle"), s["found"].alias("found"))
        serves = F.struct((s["angle"] + F.col("_size")).alias("angle"), F.concat(s["found"], F.array(p)).alias("found"))
        return F.when(clash, makes_way).otherwise(serves)

    def step(s: Column, _: Column) -> Column:
        t = s["angle"]
        place = lambda c: F.struct((lp - c["cos"] * lp + c["sin"] * bp).alias("x"), (bp - c["sin"] * lp - c["cos"] * bp).alias("y"))
        at = tails.given(F.struct(F.cos(t).alias("cos"), F.sin(t).alias("sin")), place)
        return F.when(t < 2 * math.pi - F.col("_size") - first, tails.given(at, lambda p: turned(s, p))).otherwise(s)

    walk = F.aggregate(steps, F.struct((F.col("_size") + first).alias("angle"), none.alias("found")), step, lambda s: s["found"])
    walked = rows.select(*[F.col(c).alias(f"_{c}") for c in pointing], F.explode(F.array(walk)).alias("_regions"))
    met = obs.join(walked, (F.col("lon_pnt") == F.col("_lon_pnt")) & (F.col("lat_pnt") == F.col("_lat_pnt")), "left")
    return met.select(*obs.columns, F.coalesce("_regions", none).alias("regions"))


def on_off(events: DataFrame, regions: DataFrame, radius: float) -> DataFrame:
    """(obs_id, counts, counts_off, acceptance, acceptance_off) of each run of ``regions`` (obs_id, regions): off counts over all its regions.

    A run's regions are few and travel with it; each event of the run looks at them, once on a side.
    """
    spots = F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), F.col("regions"))
    inside = lambda c: (F.col("lon") - c["x"]) * (F.col("lon") - c["x"]) + (F.col("lat") - c["y"]) * (F.col("lat") - c["y"]) < radius * radius
    met = events.join(regions.select("obs_id", spots.alias("spots")), "obs_id").withColumn("hit", F.transform("spots", inside))
    sums = met.groupBy("obs_id").agg(F.count_if(F.col("hit")[0]).alias("counts"), F.sum(F.size(F.filter(F.slice("hit", 2, 1 << 20), lambda h: h))).alias("counts_off"))
    out = regions.select("obs_id", F.size("regions").alias("acceptance_off")).join(sums, "obs_id", "left")
    return out.select("obs_id", F.coalesce("counts", F.lit(0)).cast("bigint").alias("counts"), F.coalesce("counts_off", F.lit(0)).cast("bigint").alias("counts_off"), F.lit(1.0).alias("acceptance"), F.col("acceptance_off").cast("double").alias("acceptance_off"))


def theta_squared(events: DataFrame, obs: DataFrame, edges: list[float], turns: int) -> DataFrame:
    """(bin, counts, counts_off, acceptance, acceptance_off, alpha) of squared distances to the origin and to its ``turns`` turned images.

    ``edges`` are those of equal bins. A run's alpha is one over the number of off positions; the total is weighted by live time.
    """
    width, bins = edges[1] - edges[0], len(edges) - 1
    place = lambda x, y: F.floor((x * x + y * y - edges[0]) / width).cast("int")
    lp, bp = F.col("lon_pnt"), F.col("lat_pnt")
    angles = [2 * math.pi * k / (turns + 1) for k in range(1, turns + 1)]
    spots = [(F.lit(1), place(F.col("lon"), F.col("lat")))]
    for t in angles:
        x, y = lp - math.cos(t) * lp + math.sin(t) * bp, bp - math.sin(t) * lp - math.cos(t) * bp
        spots.append((F.lit(0), place(F.col("lon") - x, F.col("lat") - y)))
    sides = F.explode(F.array(*[F.struct(b.alias("bin"), on.alias("on")) for on, b in spots]))
    h = events.join(obs.select("obs_id", "lon_pnt", "lat_pnt"), "obs_id").select(sides.alias("s")).filter(F.col("s.bin").between(0, bins - 1))
    h = h.groupBy("s.bin").agg(F.sum("s.on").alias("counts"), F.sum(1 - F.col("s.on")).alias("counts_off"))
    runs = obs.agg(F.count("*").alias("runs"), (F.sum(F.lit(1.0 / turns) * F.col("livetime")) / F.sum("livetime")).alias("alpha"))
    axis = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    rows = runs.select(axis, F.col("runs").cast("double").alias("acceptance"), (F.col("runs") * turns).cast("double").alias("acceptance_off"), "alpha")
    return rows.join(F.broadcast(h), "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("counts", "counts_off")], "acceptance", "acceptance_off", "alpha")


def light_curve(sets: DataFrame, base: float, width: float, bins: int, tolerance: float) -> DataFrame:
    """(t_idx, n_sets, counts, counts_off, exposure) of equal time bins: the data sets (t0, t1, counts, counts_off, exposure) that lie in one of them, stacked.

    A data set belongs to the bin of its middle, if it keeps within the bin's bounds but for the tolerance; others go.
    """
    middle = F.floor(((F.col("t0") + F.col("t1")) / 2 - base) / width).cast("int")
    low = base + F.col("t_idx") * width
    kept = sets.withColumn("t_idx", middle).filter((F.col("t_idx") >= 0) & (F.col("t_idx") < bins) & (F.col("t0") >= low - tolerance) & (F.col("t1") <= low + width + tolerance))
    return kept.groupBy("t_idx").agg(F.count("*").alias("n_sets"), *[F.sum(c).alias(c) for c in ("counts", "counts_off", "exposure")])
