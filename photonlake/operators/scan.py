"""Running sums and maxima over a whole table in an order, without a task that sorts all of it.

Rows are dealt to slices by ranges of the order. Each slice runs over its own rows, and starts from what lies before it: the
slices' totals, of which there are as many as slices (and keys), are scanned in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.sources.store import Rounds

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str | Column], rounds: Rounds, slices: int | None = None) -> DataFrame:
    """The rows with the number of their slice; slices are ranges of (keys, order), written so that the numbers stay."""
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rounds.table(df.repartitionByRange(n, *by).withColumn(SLICE, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, earlier: bool = False) -> DataFrame:
    """Rows of ``sliced`` with running ``sums`` and ``maxes`` (name -> value) of each key up to each row, or with ``earlier`` of the rows before it.

    The first row of a key has null for what is before it.
    """
    sums, maxes = sums or {}, maxes or {}
    fold = {name: F.sum for name in sums} | {name: F.max for name in maxes}
    values = sums | maxes
    total = rows.groupBy(SLICE, *keys).agg(*[f(values[n]).alias(f"_t_{n}") for n, f in fold.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(SLICE, *keys, *[f(f"_t_{n}").over(before).alias(f"_c_{n}") for n, f in fold.items()])
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    own = rows.select("*", *[f(values[n]).over(inside).alias(f"_w_{n}") for n, f in fold.items()])
    met = own.join(carried, [SLICE, *keys])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = {n: F.when(F.col(f"_w_{n}").isNull() & F.col(f"_c_{n}").isNull(), None).otherwise(zero(f"_w_{n}") + zero(f"_c_{n}")) for n in sums}
    both |= {n: F.greatest(f"_w_{n}", f"_c_{n}") for n in maxes}
    return met.select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def containment(df: DataFrame, keys: list[str], fraction: float, order: list[str | Column], what: str, value: str = "value", slices: int | None = None) -> DataFrame:
    """(keys, what): the ``what`` of the row at which the share of the running sum in the order comes closest to ``fraction``, the smallest of equal ones."""
    rounds = Rounds(df.sparkSession, "containment")
    rows = sliced(df, keys, order, rounds, slices)
    run = running(rows, keys, order, sums={"_upto": F.col(value)})
    total = rows.groupBy(*keys).agg(F.sum(value).alias("_all"))
    near = run.join(total, keys) if keys else run.crossJoin(F.broadcast(total))
    miss = F.abs(F.col("_upto") / F.col("_all") - fraction)
    return near.groupBy(*keys).agg(F.min(F.struct(miss.alias("miss"), F.col(what))).alias("m")).select(*keys, F.col(f"m.{what}").alias(what))


def interval_union(df: DataFrame, slices: int | None = None) -> DataFrame:
    """(start, stop): the union of all intervals of a table, touching ones merged, whatever their lengths.

    An interval opens an island if it starts after all that began before it have stopped; islands are numbered by
    a running sum and taken together by an aggregation with partial results.
    """
    rounds = Rounds(df.sparkSession, "union")
    order = ["start", "stop"]
    rows = sliced(df.select("start", "stop"), [], order, rounds, slices)
    reached = running(rows, [], order, maxes={"reach": F.col("stop")}, earlier=True)
    opened = rounds.table(reached.withColumn("opens", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("bigint")))
    numbered = running(opened, [], order, sums={"island": F.col("opens")})
    return numbered.groupBy("island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
