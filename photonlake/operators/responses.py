"""Instrument responses: lookups in bins and moments; norm fits in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_bin(df: DataFrame, table: DataFrame, energy: str, offset: str) -> DataFrame:
    """Rows with the value of the response bin (e_lo, e_hi, o_lo, o_hi, value) they fall in; null outside. The table is an axis product."""
    inside = (F.col(energy) >= F.col("e_lo")) & (F.col(energy) < F.col("e_hi")) & (F.col(offset) >= F.col("o_lo")) & (F.col(offset) < F.col("o_hi"))
    return df.join(F.broadcast(table), inside, "left").drop("e_lo", "e_hi", "o_lo", "o_hi")


def psf_containment(df: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """(keys, radius): where the running integral of a point spread (rad, value, solid) comes closest to a fraction."""
    w = Window.partitionBy(*keys).orderBy("rad").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("value") * F.col("solid")
    near = df.withColumn("miss", F.abs(F.sum(part).over(w) / F.sum(part).over(Window.partitionBy(*keys)) - fraction))
    return near.groupBy(*keys).agg(F.min(F.struct("miss", "rad")).alias("m")).select(*keys, F.col("m.rad").alias("radius"))


def dispersion_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, bias, resolution) of a dispersion (e_true, e_reco, p)."""
    g = df.groupBy(*keys, "e_true").agg(F.sum("p").alias("n"), F.sum(F.col("p") * F.col("e_reco")).alias("a"), F.sum(F.col("p") * F.col("e_reco") * F.col("e_reco")).alias("b"))
    mean = F.col("a") / F.col("n")
    return g.select(*keys, "e_true", mean.alias("mean"), ((mean - F.col("e_true")) / F.col("e_true")).alias("bias"), (F.sqrt(F.greatest(F.col("b") / F.col("n") - mean * mean, F.lit(0.0))) / F.col("e_true")).alias("resolution"))


#: Halvings of the interval that holds a norm.
HALVINGS = 60


def fit_sql(bins: str, keys: str) -> str:
    """The same fit in SQL over ``bins`` (keys, counts, background, signal), as a recursion of halvings."""
    on = " and ".join(f"x.{k} = r.{k}" for k in keys.split(", "))
    return (
        f", x as ({bins}), z as (select {keys}, -min(background / signal) as lowest, max(counts / signal) + 1.0 as highest, sum(counts) as total, sum(signal) as signals from x group by {keys}), "
        f"r as (select {keys}, 0 as step, lowest + 1e-9::double * (1 + abs(lowest)) as low, highest as high from z union all "
        f"select {keys}, step + 1, case when slope < 0 then (low + high) / 2 else low end, case when slope < 0 then high else (low + high) / 2 end from ("
        f"select r.*, (select sum(signal * (1 - counts / greatest((low + high) / 2 * signal + background, 1e-300::double))) from x where {on}) as slope from r where step < {HALVINGS})), "
        f"v as (select {keys}, (low + high) / 2 as norm, lowest, total, signals from r join z using ({keys}) where step = {HALVINGS}), "
        f"w as (select {keys}, norm, lowest, total, signals, 1 / sqrt(nullif(sum(counts * signal * signal / power(greatest(norm * signal + background, 1e-300::double), 2)), 0)) as err, "
        f"sum(2 * (background - norm * signal - background + case when counts > 0 then counts * (ln(greatest(norm * signal + background, 1e-300::double)) - ln(background)) else 0 end)) as ts from v join x using ({keys}) group by all) "
        f"select {keys}, case when total = 0 then lowest else norm end as norm, case when total > 0 then err end as norm_err, case when total = 0 then 2 * lowest * signals else ts end as ts from w"
    )
