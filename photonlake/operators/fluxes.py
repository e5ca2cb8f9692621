"""Flux points in all their quantities from fitted norms, and pulse profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantities of a norm that scale with the reference model.
SCALED = ("norm", "norm_err", "norm_errn", "norm_errp", "norm_ul")


def power_law(index: Column, amplitude: Column, reference: Column, low: Column, high: Column) -> dict[str, Column]:
    """dnde at the geometric center of an energy bin, and flux and energy flux over it, of a power law through ``amplitude`` at ``reference``."""
    center = F.sqrt(low * high)

    def integral(power: Column) -> Column:
        steep = F.abs(power + 1) > 1e-10
        scale = amplitude * F.pow(reference, index)
        return scale * F.when(steep, (F.pow(high, power + 1) - F.pow(low, power + 1)) / F.when(steep, power + 1)).otherwise(F.log(high / low))

    return {"dnde": amplitude * F.pow(center / reference, -index), "flux": integral(-index), "eflux": integral(1 - index), "e2dnde": center * center * amplitude * F.pow(center / reference, -index)}


def quantities(points: DataFrame, keys: list[str], references: dict[str, Column], threshold: float = 2.0) -> DataFrame:
    """(keys, and for each reference its value, error, errors to both sides and limit; sqrt_ts, is_ul) of fitted norms.

    ``points`` hold norm, norm_err, norm_errn, norm_errp, norm_ul (null where there is none) and ts. A point of less than
    ``threshold`` sigma is an upper limit.
    """
    root = F.when(F.col("norm") > 0, 1.0).otherwise(-1.0) * F.sqrt(F.greatest("ts", F.lit(0.0)))
    scaled = [(F.col(n) * ref).alias(n.replace("norm", name)) for name, ref in references.items() for n in SCALED]
    return points.select(*keys, *scaled, root.alias("sqrt_ts"), (root < threshold).alias("is_ul"))


def pulse_profiles(events: DataFrame, keys: list[str], phase: str, energy: str, bands: list[tuple[str, float, float]], bins: int, weight: Column | None = None) -> DataFrame:
    """(keys, band, phase_bin, value, unc): weighted counts by phase in each energy band, low <= energy < high; an event may lie in several bands."""
    w = F.lit(1.0) if weight is None else weight
    inside = [F.when((F.col(energy) >= low) & (F.col(energy) < high), name) for name, low, high in bands]
    spread = events.select(*keys, F.least(F.floor(F.col(phase) * bins), F.lit(bins - 1)).cast("int").alias("phase_bin"), w.alias("_w"), F.explode(F.array_compact(F.array(*inside))).alias("band"))
    return spread.groupBy(*keys, "band", "phase_bin").agg(F.sum("_w").alias("value"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("unc"))
