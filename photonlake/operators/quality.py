"""Checks of tables by rules: columns against a schema, events and intervals against their runs.

All give rows (level, table, obs_id, msg); a rule that nothing breaks gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.functions import sky

#: Columns that each table must have, with the kinds of value they may hold.
REQUIRED = {
    "events": {"event_id": ("bigint", "int"), "time": ("timestamp", "timestamp_ntz", "double"), "ra": ("double", "float"), "dec": ("double", "float"), "energy": ("double", "float")},
    "runs": {"obs_id": ("bigint", "int"), "ra_pnt": ("double", "float"), "dec_pnt": ("double", "float"), "start": ("double", "bigint"), "stop": ("double", "bigint")},
    "intervals": {"obs_id": ("bigint", "int"), "start": ("double", "bigint"), "stop": ("double", "bigint")},
}
_SCHEMA = "level string, table string, obs_id bigint, msg string"


def columns(spark: SparkSession, df: DataFrame, table: str, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """What a frame lacks of the columns of ``table``, from its schema alone."""
    types, found = dict(df.dtypes), []
    for name, kinds in (required or REQUIRED[table]).items():
        if name not in types:
            found.append(("error", table, None, f"missing column {name}"))
        elif types[name] not in kinds:
            found.append(("error", table, None, f"column {name} holds {types[name]}"))
    return spark.createDataFrame(found, _SCHEMA)


def _messages(rules: list[tuple[str, Column, str]]) -> Column:
    told = [F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(msg).alias("msg"))) for level, broken, msg in rules]
    return F.explode(F.array_compact(F.array(*told))).alias("m")


def events(df: DataFrame, runs: DataFrame, time_slack: float = 1e-6, angle_slack: float = 1 / 3600) -> DataFrame:
    """Events (obs_id, event_id, time in seconds, ra, dec, glon, glat, energy) against their runs (obs_id, start, stop): one aggregation by run.

    Errors: no events, events of no run, times before the start or after the stop by more than ``time_slack``, times not in the order of
    event_id, Galactic coordinates further than ``angle_slack`` degrees from the equatorial ones. Warnings: energies that are
    not positive and finite, repeated event_ids.
    """
    lon, lat = sky.to_galactic("ra", "dec")
    apart = sky.separation(lon, lat, "glon", "glat") > angle_slack
    bad = F.col("energy").isNull() | F.isnan("energy") | (F.col("energy") <= 0) | (F.col("energy") == float("inf"))
    # Order within a run: the time that comes before each event, by windows of one run.
    before = F.lag("time").over(Window.partitionBy("obs_id").orderBy("event_id", "time"))
    same = F.lag("event_id").over(Window.partitionBy("obs_id").orderBy("event_id", "time"))
    marked = df.select("obs_id", "event_id", "time", apart.alias("_apart"), bad.alias("_bad"), before.alias("_before"), same.alias("_same"))
    sums = marked.groupBy("obs_id").agg(
        F.min("time").alias("_first"), F.max("time").alias("_last"), F.max("_apart").alias("_apart"), F.max("_bad").alias("_bad"),
        F.max((F.col("time") <= F.col("_before")) & (F.col("event_id") != F.col("_same"))).alias("_disordered"), F.max(F.col("event_id") == F.col("_same")).alias("_repeated"),
    )
    met = runs.select("obs_id", "start", "stop", F.lit(True).alias("_run")).join(sums, "obs_id", "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        ("error", F.col("_first").isNull(), "no events"),
        ("error", F.col("_run").isNull(), "events of no run"),
        ("error", F.coalesce(F.col("_first") < F.col("start") - time_slack, F.lit(False)), "events before the run's start"),
        ("error", F.coalesce(F.col("_last") > F.col("stop") + time_slack, F.lit(False)), "events after the run's stop"),
        ("error", yes("_disordered"), "events not in order of time"),
        ("error", yes("_apart"), "galactic and equatorial coordinates disagree"),
        ("warning", yes("_bad"), "energies that are not positive"),
        ("warning", yes("_repeated"), "repeated event_id"),
    ]
    return met.select("obs_id", _messages(rules)).select("m.level", F.lit("events").alias("table"), F.col("obs_id").cast("bigint").alias("obs_id"), "m.msg")


def intervals(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Intervals (obs_id, start, stop) against their runs: none at all, empty ones, ones outside of the run, of no run."""
    sums = df.groupBy("obs_id").agg(F.min("start").alias("_first"), F.max("stop").alias("_last"), F.max(F.col("stop") <= F.col("start")).alias("_empty"))
    met = runs.select("obs_id", "start", "stop", F.lit(True).alias("_run")).join(sums, "obs_id", "full_outer")
    rules = [
        ("error", F.col("_first").isNull(), "no interval"),
        ("error", F.col("_run").isNull(), "intervals of no run"),
        ("error", F.coalesce(F.col("_empty"), F.lit(False)), "interval is empty"),
        ("warning", F.coalesce((F.col("_first") < F.col("start")) | (F.col("_last") > F.col("stop")), F.lit(False)), "intervals reach out of the run"),
    ]
    return met.select("obs_id", _messages(rules)).select("m.level", F.lit("intervals").alias("table"), F.col("obs_id").cast("bigint").alias("obs_id"), "m.msg")
