"""Cone joins on the sphere by sky cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions import sky


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``a`` (lon, lat) and ``b`` (lon2, lat2) less than ``radius`` degrees apart, with their ``separation``.

    The sky is cut into bands of latitude as high as the radius, each into cells at least as wide as the radius
    reaches in it. Rows of ``b`` go to every cell that their cone can touch (in bands near a pole to all of
    them), rows of ``a`` to one; the join is on cells and the exact distance decides.
    """
    band = lambda lat: F.floor((lat + 90) / radius).cast("int")
    reach = lambda k: F.greatest(F.abs(k * radius - 90), F.abs((k + 1) * radius - 90)) + radius
    # Half width in longitude of a cone anywhere in the band, all around where it may hold a pole.
    half = lambda k: F.when(reach(k) >= 89.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(radius)) / F.cos(F.radians(reach(k)))))))
    cells = lambda k: F.greatest(F.lit(1), F.floor(360 / F.greatest(half(k), F.lit(radius)))).cast("int")
    ka = band(F.col("lat"))
    left = a.withColumn("_band", ka).withColumn("_n", cells(F.col("_band"))).withColumn("_cell", F.floor(F.pmod("lon", F.lit(360.0)) / 360 * F.col("_n")).cast("int"))
    kb = band(F.col("lat2"))
    spread = b.withColumn("_band", F.explode(F.sequence(kb - 1, kb + 1))).withColumn("_n", cells(F.col("_band")))
    own = F.floor(F.pmod("lon2", F.lit(360.0)) / 360 * F.col("_n")).cast("int")
    near = F.when(F.col("_n") <= 3, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.transform(F.sequence(own - 1, own + 1), lambda c: F.pmod(c, F.col("_n"))))
    right = spread.withColumn("_cell", F.explode(near)).drop("_n")
    met = left.drop("_n").join(right, ["_band", "_cell"]).withColumn("separation", sky.separation("lon", "lat", "lon2", "lat2"))
    return met.filter(F.col("separation") < radius).drop("_band", "_cell")


def nearest(a: DataFrame, b: DataFrame, key: str, other: str, radius: float) -> DataFrame:
    """(key, other, separation): the nearest row of ``b`` within the radius of each row of ``a``."""
    met = within(a, b, radius)
    return met.groupBy(key).agg(F.min(F.struct("separation", other)).alias("m")).select(key, F.col(f"m.{other}").alias(other), F.col("m.separation").alias("separation"))
