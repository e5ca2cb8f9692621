"""Good time intervals: unions, cuts, joins with events, and time bins. Intervals are rows (keys..., start, stop)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: list[str], merge_equal: bool = True, overlap_ok: bool = True) -> DataFrame:
    """Merge overlapping intervals of each key, and touching ones if ``merge_equal``.

    With ``overlap_ok=False`` an overlap raises when the result is computed.
    """
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start") > F.col("reach") if merge_equal else F.col("start") >= F.col("reach")
    marked = df.withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | gap, 1).otherwise(0))
    if not overlap_ok:
        clash = F.col("start") < F.col("reach")
        marked = marked.withColumn("new", F.when(clash, F.raise_error(F.lit("overlapping intervals")).cast("int")).otherwise(F.col("new")))
    islands = marked.withColumn("island", F.sum("new").over(order))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def crop(df: DataFrame, low, high, inverted: bool = False) -> DataFrame:
    """Intervals cut to a window; inverted, those that do not touch it at all."""
    touches = (F.col("start") <= high) & (F.col("stop") > low)
    if inverted:
        return df.filter(~touches)
    return df.filter(touches).withColumn("start", F.greatest("start", F.lit(low))).withColumn("stop", F.least("stop", F.lit(high)))


def delete(df: DataFrame, low, high) -> DataFrame:
    """Take a bad interval out: trim, drop, or split in two the intervals that it touches."""
    left = F.struct(F.col("start").alias("a"), F.least("stop", F.lit(low)).alias("b"))
    right = F.struct(F.greatest("start", F.lit(high)).alias("a"), F.col("stop").alias("b"))
    parts = F.filter(F.array(left, right), lambda x: x["a"] < x["b"])
    rest = [c for c in df.columns if c not in ("start", "stop")]
    return df.select(*rest, F.explode(parts).alias("x")).select(*rest, F.col("x.a").alias("start"), F.col("x.b").alias("stop"))


def durations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("duration"), F.count("*").alias("n"))


def events_within(events: DataFrame, gti: DataFrame, key: str, time: str, slice_s: int) -> DataFrame:
    """Events inside an interval of their key, each once: start <= time < stop.

    Both sides are keyed by time slice as well, an interval once per slice it touches, so that a key with
    very many intervals is an equi-join on (key, slice) and not a nested loop.
    """
    slices = F.explode(F.sequence(F.floor(F.col("start") / slice_s), F.floor(F.col("stop") / slice_s)))
    cut = gti.select(F.col(key).alias("g_key"), "start", "stop", slices.alias("slice"))
    keyed = events.withColumn("slice", F.floor(F.col(time) / slice_s))
    inside = (keyed[key] == cut.g_key) & (keyed["slice"] == cut["slice"]) & (keyed[time] >= cut.start) & (keyed[time] < cut.stop)
    return keyed.join(cut, inside, "left_semi").drop("slice")


def overlapping(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs (start, stop) with each window (w_start, w_stop) that they overlap, cut to it; ``windows`` is a short list."""
    met = runs.join(F.broadcast(windows), (F.col("start") <= F.col("w_stop")) & (F.col("stop") > F.col("w_start")))
    return met.withColumn("start", F.greatest("start", "w_start")).withColumn("stop", F.least("stop", "w_stop"))


def time_bin(df: DataFrame, time: str, bins: DataFrame) -> DataFrame:
    """Rows with ``t_idx``, the first bin (t_idx, t_lo, t_hi) with t_lo < time <= t_hi, or -1.

    ``bins`` is a time axis; its bins are folded into one row, which is broadcast.
    """
    axis = bins.agg(F.sort_array(F.collect_list(F.struct("t_idx", "t_lo", "t_hi"))).alias("axis"))
    hit = F.filter("axis", lambda b: (F.col(time) > b["t_lo"]) & (F.col(time) <= b["t_hi"]))
    return df.crossJoin(F.broadcast(axis)).withColumn("t_idx", F.coalesce(F.try_element_at(hit, F.lit(1))["t_idx"], F.lit(-1))).drop("axis")


def group_by_windows(df: DataFrame, windows: DataFrame, tolerance) -> DataFrame:
    """Label each interval: the window that contains it within a tolerance, or underflow, overflow or outflow.

    Below all windows is underflow, above all overflow, else (between or across windows) outflow.
    """
    axis = windows.agg(F.sort_array(F.collect_list(F.struct("w_idx", "w_start", "w_stop"))).alias("axis"), F.min("w_start").alias("first"), F.max("w_stop").alias("last"))
    inside = F.filter("axis", lambda w: (F.col("start") >= w["w_start"] - tolerance) & (F.col("stop") <= w["w_stop"] + tolerance))
    kind = F.when(F.size("inside") > 0, "normal").when(F.col("stop") <= F.col("first") + tolerance, "underflow").when(F.col("start") >= F.col("last") - tolerance, "overflow").otherwise("outflow")
    met = df.crossJoin(F.broadcast(axis)).withColumn("inside", inside)
    return met.withColumn("kind", kind).withColumn("w_idx", F.try_element_at("inside", F.lit(1))["w_idx"]).drop("axis", "first", "last", "inside")


def contiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bins between neighbouring edges of all intervals: overlaps are split, gaps are bins too."""
    edges = df.select(*keys, F.explode(F.array("start", "stop")).alias("lo")).distinct()
    order = Window.partitionBy(*keys).orderBy("lo")
    return edges.withColumn("hi", F.lead("lo").over(order)).filter("hi is not null").withColumn("idx", F.row_number().over(order) - 1)
