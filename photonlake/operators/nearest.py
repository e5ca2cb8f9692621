"""The nearest row of another table for every row, without a radius: descent through a tree of cells.

Positions are cut into ever smaller cells, each by halving its axes; a cell of few positions is a leaf. In each round the rows
that look for a neighbour meet the children of the cells they still consider, and drop those whose nearest corner is
further than the farthest corner of another. Bounds are those of the box that a cell's positions fill. At the end
only leaves are left, and exact distances decide. Every round is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions import sky
from photonlake.sources.store import Rounds

#: Halvings of the axes at most.
DEEPEST = 40


def _cells(axes: list[str], level: int) -> list[Column]:
    return [F.shiftright(f"_i_{a}", DEEPEST - level).alias(f"_k_{a}") for a in axes]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def nearest(a: DataFrame, b: DataFrame, axes: list[str], key: str, other: str, distance: Callable[[], Column] | None = None, payload: list[str] = (), distinct_from_itself: bool = False, leaf: int = 16) -> DataFrame:
    """(key, other, distance): the row of ``b`` (other, axes) nearest to each row of ``a`` (key, axes), ties to the smallest ``other``.

    Distances in the cells are Euclidean over ``axes``; ``distance`` is a Column of what is compared at last, which must order
    rows in the same way: it sees a's ``axes`` and ``payload``, and those of ``b`` with a leading ``b_``. The default is the
    squared distance. With ``distinct_from_itself`` a row of ``b`` is no neighbour of the row of ``a`` whose key it has. Rows with a
    null axis take no part; rows of ``a`` for which ``b`` has no other row are missing. ``key`` must be unique in ``a`` and ``other``
    in ``b``.
    """
    rounds = Rounds(a.sparkSession, "nearest")
    valid = lambda df, *more: df.select(*more, *[F.col(x).cast("double").alias(x) for x in [*axes, *payload]]).na.drop(subset=[*more, *axes])
    asking = valid(a, key)
    points = valid(b, other)
    ends = points.agg(*[f(x).alias(f"{n}_{x}") for x in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    empty = asking.select(key).join(points.select(other), F.lit(False)).select(key, other, F.lit(0.0).alias("distance"))
    if ends[f"low_{axes[0]}"] is None:
        return empty
    side = max(max(ends[f"high_{x}"] - ends[f"low_{x}"] for x in axes), 1e-300)
    place = lambda x: F.least(F.floor((F.col(x) - ends[f"low_{x}"]) / side * float(1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("bigint")
    # Rows at one place are one position, with its two smallest ids.
    first = points.groupBy(*axes, *payload).agg(F.min(other).alias("_one"), F.count("*").alias("_rows"))
    if distinct_from_itself:
        two = points.join(first.filter("_rows > 1"), [*axes, *payload]).filter(F.col(other) > F.col("_one")).groupBy(*axes, *payload).agg(F.min(other).alias("_two"))
        first = first.join(two, [*axes, *payload], "left")
    else:
        first = first.withColumn("_two", F.lit(None).cast(dict(points.dtypes)[other]))
    inner = rounds.table(first.select("*", *[place(x).alias(f"_i_{x}") for x in axes]))
    names, bounds = [f"_k_{x}" for x in axes], [f"_{n}_{x}" for x in axes for n in ("low", "high")]
    candidates, leaves = None, []
    level = 0
    while True:
        level += 1
        cells = inner.groupBy(*_cells(axes, level)).agg(F.count("*").alias("_n"), F.sum("_rows").alias("_rows"), F.min("_one").alias("_least"), *[f(x).alias(f"_{n}_{x}") for x in axes for n, f in (("low", F.min), ("high", F.max))])
        cells = rounds.table(cells.withColumn("_leaf", (F.col("_n") <= leaf) | F.lit(level >= DEEPEST)))
        if candidates is None:
            met, kept = asking.crossJoin(F.broadcast(cells)), None  # of halves of the root: 2 to the number of axes
        else:
            parents = cells.select("*", *[F.shiftright(n, 1).alias(f"_p{n}") for n in names])
            going = candidates.filter("not _leaf").select(key, *axes, *payload, *[F.col(n).alias(f"_p{n}") for n in names])
            met, kept = going.join(parents, [f"_p{n}" for n in names]).drop(*[f"_p{n}" for n in names]), candidates.filter("_leaf")
        if distinct_from_itself:
            met = met.filter((F.col("_rows") > 1) | (F.col("_least") != F.col(key)))
        zero = F.lit(0.0)
        near = _sum([F.pow(F.greatest(F.col(f"_low_{x}") - F.col(x), F.col(x) - F.col(f"_high_{x}"), zero), 2) for x in axes])
        far = _sum([F.pow(F.greatest(F.abs(F.col(x) - F.col(f"_low_{x}")), F.abs(F.col(x) - F.col(f"_high_{x}"))), 2) for x in axes])
        met = met.select(key, *axes, *payload, *names, "_leaf", F.lit(level).alias("_level"), near.alias("_near"), far.alias("_far"))
        met = met if kept is None else met.unionByName(kept)
        least = F.min("_far").over(Window.partitionBy(key))
        candidates = rounds.table(met.withColumn("_best", least).filter(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-30).drop("_best"))
        own = inner.select("*", *_cells(axes, level)).join(cells.select(*names, "_leaf"), names)
        leaves.append(rounds.table(own.filter("_leaf").withColumn("_level", F.lit(level))))
        inner = rounds.table(own.filter("not _leaf").drop(*names, "_leaf"))
        if inner.isEmpty():
            break
    held = reduce(DataFrame.unionByName, leaves).select("_level", *names, "_one", "_two", *[F.col(x).alias(f"b_{x}") for x in [*axes, *payload]])
    pairs = candidates.select(key, *axes, *payload, "_level", *names).join(held, ["_level", *names])
    mine = F.col("_one") == F.col(key)
    found = F.when(mine, F.col("_two")).otherwise(F.col("_one")) if distinct_from_itself else F.col("_one")
    how = distance() if distance else _sum([F.pow(F.col(x) - F.col(f"b_{x}"), 2) for x in axes])
    best = pairs.select(key, how.alias("distance"), found.alias(other)).filter(F.col(other).isNotNull()).groupBy(key).agg(F.min(F.struct("distance", other)).alias("m"))
    return best.select(key, F.col(f"m.{other}").alias(other), F.col("m.distance").alias("distance"))


def nearest_on_sky(a: DataFrame, b: DataFrame, key: str, other: str, distinct_from_itself: bool = False) -> DataFrame:
    """(key, other, separation in degrees): the nearest of ``b`` (other, lon, lat) on the sphere for each of ``a`` (key, lon, lat)."""

    def vectors(df: DataFrame) -> DataFrame:
        lon, lat = F.radians("lon"), F.radians("lat")
        return df.withColumn("_x", F.cos(lat) * F.cos(lon)).withColumn("_y", F.cos(lat) * F.sin(lon)).withColumn("_z", F.sin(lat))

    found = nearest(vectors(a), vectors(b), ["_x", "_y", "_z"], key, other, lambda: sky.separation("lon", "lat", "b_lon", "b_lat"), ["lon", "lat"], distinct_from_itself)
    return found.withColumnRenamed("distance", "separation")
