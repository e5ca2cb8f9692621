"""Data sets in long form: stacking under masks, background estimates, predicted counts.

A data set's bins are rows (dataset, bins..., counts, background, mask_safe, ...); every merge is a plain sum,
so any number of data sets stack in one aggregation, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.operators import scan


def clean(x: Column) -> Column:
    """Zero where a value is missing or not finite."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def stack_maps(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    value = clean(F.col("value"))
    return df.groupBy(*keys).agg(F.sum(value if weight is None else value * F.col(weight)).alias("value"))


def stack(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and background where the safe mask holds; the mask of the stack holds where any does."""
    safe = lambda c: F.sum(F.when(F.col("mask_safe"), F.col(c)).otherwise(0))
    return df.groupBy(*keys).agg(safe("counts").alias("counts"), safe("background").alias("background"), F.bool_or("mask_safe").alias("mask_safe"))


def stack_whole(bins: DataFrame, pixel: list[str], energy: str, exposure: DataFrame, true_energy: str, livetime: DataFrame, intervals: DataFrame) -> dict[str, DataFrame]:
    """Every part of the stack of data sets, each by one aggregation over all of them.

    ``bins`` (dataset, pixel, energy, counts, background, mask_safe), ``exposure`` (dataset, pixel, true energy, exposure), ``livetime``
    (dataset, livetime), ``intervals`` (dataset, start, stop). A set's exposure counts in the pixels where any of its bins is safe,
    its live time and intervals if there is one anywhere; intervals of all sets are united.
    """
    safe_pixels = bins.groupBy("dataset", *pixel).agg(F.bool_or("mask_safe").alias("_safe"))
    used = bins.filter("mask_safe").select("dataset").distinct()
    masked = exposure.join(safe_pixels, ["dataset", *pixel])
    return {
        "bins": stack(bins, [*pixel, energy]),
        "exposure": masked.groupBy(*pixel, true_energy).agg(F.sum(F.when(F.col("_safe"), clean(F.col("exposure"))).otherwise(0.0)).alias("exposure")),
        "livetime": livetime.join(used, "dataset").agg(F.sum("livetime").alias("livetime"), F.count("*").alias("n_sets")),
        "intervals": scan.interval_union(intervals.join(used, "dataset", "left_semi")),
    }


def stack_on_off(df: DataFrame, keys: list[str]) -> DataFrame:
    """On and off counts and acceptances where safe; the stacked off acceptance keeps the summed background.

    Bins without off counts take the mean alpha over all bins. Numerators and denominators are summed, never
    ratios, so the order of the data sets does not matter.
    """
    alpha = F.when(F.col("acceptance_off") > 0, F.col("acceptance") / F.col("acceptance_off")).otherwise(0.0)
    safe = df.filter("mask_safe").withColumn("background", alpha * F.col("counts_off"))
    bins = safe.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("counts", "counts_off", "acceptance", "background")])
    mean = bins.agg((F.sum("background") / F.sum("counts_off")).alias("mean_alpha"))
    off = F.when(F.col("counts_off") > 0, F.col("acceptance") * F.col("counts_off") / F.col("background")).otherwise(F.col("acceptance") / F.col("mean_alpha"))
    return bins.crossJoin(F.broadcast(mean)).withColumn("acceptance_off", off).drop("mean_alpha")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Responses stacked with their exposures as weights."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def ring_background(on: DataFrame, ring_sums: DataFrame, keys: list[str]) -> DataFrame:
    """Alpha and background of each pixel from the acceptance and counts of its ring."""
    alpha = F.when(F.col("acceptance_off") > 0, F.col("acceptance") / F.col("acceptance_off"))
    return on.join(ring_sums, keys, "left").withColumn("alpha", alpha).withColumn("background", F.col("alpha") * F.col("counts_off"))


def field_of_view_scale(df: DataFrame, key: str) -> DataFrame:
    """Scale of each data set's background outside of the exclusion mask, with its error."""
    outside = df.filter("not excluded").groupBy(key).agg(F.sum("counts").alias("n"), F.sum("background").alias("b"))
    return outside.select(key, (F.col("n") / F.col("b")).alias("scale"), (F.sqrt("n") / F.col("b")).alias("scale_err"))


def fold(df: DataFrame, dispersion: DataFrame, keys: list[str]) -> DataFrame:
    """Counts in true energy through an energy-dispersion matrix (e_true, e_reco, p), which is of a response's size."""
    return df.join(F.broadcast(dispersion), "e_true").groupBy(*keys, "e_reco").agg(F.sum(F.col("value") * F.col("p")).alias("value"))


def residuals(counts: Column, model: Column) -> dict[str, Column]:
    diff = counts - model
    return {"diff": diff, "relative": F.when(model != 0, diff / model), "scaled": F.when(model > 0, diff / F.sqrt(model))}
