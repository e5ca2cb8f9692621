"""Maps carried between projections and frames, and predictions of sources on a map.

A plane holds pixels of a plate-carree or tangent projection about a center, in equatorial or Galactic coordinates. Everything is a
Column: pixel to sky, frame to frame, sky to pixel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import sky
from photonlake.operators import maps as M


@dataclass(frozen=True)
class Plane:
    """``width`` x ``height`` pixels of ``step`` degrees; the center of the projection (lon0, lat0) lies at pixel (px0, py0). Longitudes grow to the right for a positive ``step_lon``."""

    kind: str
    lon0: float
    lat0: float
    step_lon: float
    step_lat: float
    px0: float
    py0: float
    width: int
    height: int
    frame: str = "icrs"

    def sky(self, px: Column, py: Column) -> tuple[Column, Column]:
        """(lon, lat) of pixel coordinates, in the plane's frame."""
        x, y = (px - self.px0) * self.step_lon, (py - self.py0) * self.step_lat
        if self.kind == "car":
            return self.lon0 + x, self.lat0 + y
        return sky.tan_world(-x, y, self.lon0, self.lat0, 1.0)

    def pixel(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Pixel coordinates of a position in the plane's frame; null where the projection does not show it."""
        if self.kind == "car":
            turn = F.pmod(lon - self.lon0 + 180.0, F.lit(360.0)) - 180.0
            x, y = turn, lat - self.lat0
        else:
            x, y = sky.tan_pixel(lon, lat, self.lon0, self.lat0, 1.0)
            x = -x
        return x / self.step_lon + self.px0, y / self.step_lat + self.py0

    def inside(self, px: Column, py: Column) -> Column:
        return px.between(0, self.width - 1) & py.between(0, self.height - 1)

    def pixels(self, spark: SparkSession) -> DataFrame:
        return M.grid(spark, self.width, self.height)

    def reach(self) -> float:
        """Degrees from the projection's center within which all pixels lie."""
        x = max(abs(-0.5 - self.px0), abs(self.width - 0.5 - self.px0)) * abs(self.step_lon)
        y = max(abs(-0.5 - self.py0), abs(self.height - 0.5 - self.py0)) * abs(self.step_lat)
        return min(180.0, math.hypot(x, y) + abs(self.step_lon) + abs(self.step_lat))


def between(source: str, target: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """A position of one frame in another."""
    if source == target:
        return lon, lat
    return sky.to_galactic(lon, lat) if target == "galactic" else sky.from_galactic(lon, lat)


def _settled(df: DataFrame, kept: tuple[str, ...], *names: str) -> DataFrame:
    """``df`` with columns that later steps and filters take as values: a generator of one row keeps Catalyst from writing their expressions out again in each use."""
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def _located(df: DataFrame, kept: tuple[str, ...], source: Plane, target: Plane, px: Column, py: Column) -> DataFrame:
    """``kept`` and the position (_lon, _lat) of the source's pixel coordinates in the target's frame."""
    lon, lat = source.sky(px, py)
    at = _settled(df.select(*kept, lon.alias("_lon"), lat.alias("_lat")), kept, "_lon", "_lat")
    if source.frame == target.frame:
        return at
    lon, lat = between(source.frame, target.frame, F.col("_lon"), F.col("_lat"))
    return _settled(at.select(*kept, lon.alias("_lon"), lat.alias("_lat")), kept, "_lon", "_lat")


def reproject(image: DataFrame, source: Plane, target: Plane, factor: int = 1, preserve_counts: bool = True, others: tuple[str, ...] = ()) -> DataFrame:
    """(px, py, others, value): the map (px, py, others, value) on the target's pixels.

    Each pixel is cut into ``factor`` squared parts, whose centers fall into pixels of the target. Counts are shared out, so
    that the sum of what the target shows is kept; other quantities are the mean of the parts in a pixel. Pixels further
    from the target's center than it reaches are left out first.
    """
    rows = image.select("px", "py", *others, F.col("value").cast("double").alias("value"))
    held = ("px", "py", *others, "value")
    centers = _located(rows, held, source, target, F.col("px").cast("double"), F.col("py").cast("double"))
    slack = abs(source.step_lon) + abs(source.step_lat)
    near = centers.filter(sky.separation("_lon", "_lat", target.lon0, target.lat0) <= min(180.0, target.reach() + slack))
    parts = F.explode(F.array(*[F.lit((i + 0.5) / factor - 0.5) for i in range(factor)]))
    cut = near.select(*held, parts.alias("_dx")).withColumn("_dy", parts)
    located = _located(cut, (*others, "value"), source, target, F.col("px") + F.col("_dx"), F.col("py") + F.col("_dy"))
    x, y = target.pixel(F.col("_lon"), F.col("_lat"))
    placed = located.select(*others, "value", F.floor(x + 0.5).cast("int").alias("px"), F.floor(y + 0.5).cast("int").alias("py"))
    shown = _settled(placed, (*others, "value"), "px", "py").filter(target.inside(F.col("px"), F.col("py")))
    value = F.sum("value") / (factor * factor) if preserve_counts else F.avg("value")
    return shown.groupBy("px", "py", *others).agg(value.alias("value"))


def interpolate(image: DataFrame, source: Plane, target: Plane) -> DataFrame:
    """(px, py, value) at the centers of the target's pixels, bilinear in the source's; beyond it pixels count as zero."""
    grid = target.pixels(image.sparkSession).toDF("tx", "ty")
    at = _located(grid, ("tx", "ty"), target, source, F.col("tx").cast("double"), F.col("ty").cast("double"))
    x, y = source.pixel(F.col("_lon"), F.col("_lat"))
    placed = _settled(at.select("tx", "ty", x.alias("fx"), y.alias("fy")), ("tx", "ty"), "fx", "fy").filter("fx is not null")
    return M.interpolate(placed, F.col("fx"), F.col("fy"), image).select(F.col("tx").alias("px"), F.col("ty").alias("py"), "value")


def predict(sources: DataFrame, plane: Plane, exposure: DataFrame, kernel: DataFrame, dispersion: DataFrame, background: DataFrame, offset_step: float) -> DataFrame:
    """(px, py, e, npred): counts of all sources through exposure, point spread and dispersion, with the background, not below zero.

    ``sources`` (lon, lat, e_true, flux), in the plane's frame; ``exposure`` (px, py, e_true, exposure); ``kernel`` (e_true, offset_bin, dx, dy, p),
    a point spread for every energy and bin of distances from the plane's center; ``dispersion`` (e_true, e_reco, p); ``background`` (px, py, e, value).
    A source counts with the exposure of its pixel and scatters over the kernel of its energy and distance; counts are
    summed by pixel and true energy before they are folded.
    """
    x, y = plane.pixel(F.col("lon"), F.col("lat"))
    away = F.floor(sky.separation("lon", "lat", plane.lon0, plane.lat0) / offset_step).cast("int")
    placed = sources.select("e_true", "flux", F.floor(x + 0.5).cast("int").alias("px"), F.floor(y + 0.5).cast("int").alias("py"), away.alias("offset_bin"))
    placed = placed.filter(plane.inside(F.col("px"), F.col("py")))
    # Sources of a pixel and energy are one before they scatter.
    merged = placed.groupBy("px", "py", "e_true", "offset_bin").agg(F.sum("flux").alias("flux"))
    counts = merged.join(exposure, ["px", "py", "e_true"]).select("px", "py", "e_true", "offset_bin", (F.col("flux") * F.col("exposure")).alias("n"))
    spread = counts.join(kernel, ["e_true", "offset_bin"]).select((F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"), "e_true", (F.col("n") * F.col("p")).alias("n"))
    true = spread.filter(plane.inside(F.col("px"), F.col("py"))).groupBy("px", "py", "e_true").agg(F.sum("n").alias("n"))
    folded = true.join(dispersion, "e_true").select("px", "py", F.col("e_reco").alias("e"), (F.col("n") * F.col("p")).alias("value"))
    total = folded.unionByName(background.select("px", "py", "e", F.col("value").cast("double").alias("value"))).groupBy("px", "py", "e").agg(F.sum("value").alias("value"))
    return total.select("px", "py", "e", F.greatest("value", F.lit(0.0)).alias("npred"))


def gaussian_kernels(spark: SparkSession, sigmas: dict[tuple[int, int], float], half: int) -> DataFrame:
    """(e_true, offset_bin, dx, dy, p): Gaussians of sigma pixels by energy and offset bin, each summing to one within ``half`` pixels."""
    names = spark.createDataFrame([(e, o, float(s)) for (e, o), s in sigmas.items()], "e_true int, offset_bin int, sigma double")
    steps = F.sequence(F.lit(-half), F.lit(half))
    raw = names.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("w", F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * F.col("sigma") * F.col("sigma"))))
    total = raw.groupBy("e_true", "offset_bin").agg(F.sum("w").alias("all"))
    return raw.join(total, ["e_true", "offset_bin"]).select("e_true", "offset_bin", "dx", "dy", (F.col("w") / F.col("all")).alias("p"))
