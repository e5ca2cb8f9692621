"""Maps in long form: rows (bins..., value), a missing row being zero. Filling, reducing, resampling and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.operators import nearest


def fill(events: DataFrame, bins: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Counts, or summed weights, per bin; rows with a null bin lie outside. Partial sums precede the shuffle of bins."""
    binned = events.select(*[c.alias(n) for n, c in bins.items()], (F.lit(1) if weight is None else weight).alias("w"))
    return binned.na.drop(subset=list(bins)).groupBy(*bins).agg(F.sum("w").alias("value"))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All pixels (px, py), made by the executors."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))


def reduce(df: DataFrame, keep: list[str], how: str = "sum", value: str = "value", weight: Column | None = None) -> DataFrame:
    """Reduce over all bins but ``keep``; NaN is passed over. ``how``: sum, max, min, prod, any, all, mean."""
    return reductions(df, keep, {value: how}, value, weight)


def reductions(df: DataFrame, keep: list[str], wanted: dict[str, str], value: str = "value", weight: Column | None = None) -> DataFrame:
    """Several reductions, new name -> how, in one aggregation."""
    x = F.when(~F.isnan(value), F.col(value).cast("double"))
    x = x if weight is None else x * weight
    out = {"sum": F.sum(x), "max": F.max(x), "min": F.min(x), "mean": F.avg(x), "prod": F.product(x), "any": F.max((x != 0).cast("int")), "all": F.min((x != 0).cast("int"))}
    return df.groupBy(*keep).agg(*[out[how].alias(name) for name, how in wanted.items()])


def reduce_with(df: DataFrame, keep: list[str], f: Callable[[pd.Series], float], value: str = "value") -> DataFrame:
    """Reduce with a user's function of a pandas Series; each group of ``keep`` must fit one task."""
    udf = F.pandas_udf(f, T.DoubleType(), F.PandasUDFType.GROUPED_AGG)
    return df.groupBy(*keep).agg(udf(F.col(value).cast("double")).alias(value))


def per_key(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, parts: int = 4) -> DataFrame:
    """Run a user's function on the rows of each observation, data set or interval.

    With ``merge``, a key's rows are dealt to ``parts`` tasks first, and both functions get batches of rows of many keys and return
    rows of each: ``f`` turns rows into results of parts, ``merge`` results of parts into one a key, of the same schema.
    """
    if merge is None:
        return df.groupBy(*keys).applyInPandas(f, schema)
    dealt = df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(parts))).sortWithinPartitions(*keys)

    def one(batches):
        for rows in batches:
            if len(rows):
                yield f(rows)

    def whole(batches):
        """Merge sorted results batch by batch; the last key waits for the next batch."""
        held = None
        for rows in batches:
            if not len(rows):
                continue
            held = merge(rows if held is None else pd.concat([held, rows], ignore_index=True))
            last = rows[keys].iloc[-1]
            open_ = (held[keys].eq(last) | (held[keys].isna() & last.isna())).all(axis=1)
            yield held[~open_]
            held = held[open_]
        if held is not None:
            yield held

    return dealt.mapInPandas(one, schema).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(whole, schema)


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """(limit,): the interpolated quantile of a column of few distinct values, such as counts, from how often each occurs."""
    by = df.groupBy(value).agg(F.count("*").alias("times"))
    upto = by.withColumn("upto", F.sum("times").over(Window.orderBy(value)))
    at = (F.col("n") - 1) * q
    ranked = upto.crossJoin(F.broadcast(by.agg(F.sum("times").alias("n"))))
    low, high = (F.min(F.when(F.col("upto") > k, F.col(value))) for k in (F.floor(at), F.ceil(at)))
    return ranked.groupBy("n").agg(low.alias("low"), high.alias("high")).select((F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("limit"))


def quantiles(df: DataFrame, keys: list[str], **wanted: tuple[str, float]) -> DataFrame:
    """(keys, names): exact interpolated quantiles per key, name=(column, q), by ranks in sorted, spillable windows."""
    out = None
    for name, (value, q) in wanted.items():
        by = Window.partitionBy(*keys)
        rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(by.orderBy(value)) - 1).alias("_r"), ((F.count("*").over(by) - 1) * q).alias("_at"))
        near = rows.filter((F.col("_r") == F.floor("_at")) | (F.col("_r") == F.ceil("_at"))).groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_at").alias("_at"))
        one = near.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(name))
        out = one if out is None else out.join(one, keys)
    return out


def overall_quantile(df: DataFrame, value: str, q: float, rows: int = 1_000_000) -> float | None:
    """The exact interpolated quantile of a whole column; null values are passed over.

    The two ranks next to it are looked up. For each, approximate quantiles close a bracket around the rank; how many values lie below,
    at and between its ends tells whether the rank is at an end (however many values tie there) or inside,
    until ``rows`` values at most are left, which are then sorted.
    """
    v = F.col(value).cast("double")
    inside = df.filter(v.isNotNull()).select(v.alias("v"))
    n = inside.count()
    if not n:
        return None
    at = (n - 1) * q
    a = _ranked(inside, math.floor(at), n, rows)
    b = a if math.ceil(at) == math.floor(at) else _ranked(inside, math.ceil(at), n, rows)
    return a + (b - a) * (at - math.floor(at))


def _ranked(values: DataFrame, rank: int, n: int, rows: int) -> float:
    """The value of a rank (from 0) among ``n`` values."""
    inside, below, left = values, 0, n
    while left > rows:
        share = [min(1.0, max(0.0, (rank - below + d) / left)) for d in (-left / 1000, left / 1000)]
        low, high = inside.agg(F.percentile_approx("v", share, 10_000).alias("b")).first()["b"]
        x = F.col("v")
        before, first, between, last = inside.agg(F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if((x == high) & (x > low))).first()
        place = rank - below
        if before <= place < before + first:
            return low
        if before + first + between <= place < before + first + between + last:
            return high
        if place < before:
            inside, left = inside.filter(x < low), before
        elif place < before + first + between:
            inside, below, left = inside.filter((x > low) & (x < high)), below + before + first, between
        else:
            gone = before + first + between + last
            inside, below, left = inside.filter(x > high), below + gone, left - gone
    return inside.orderBy("v").offset(rank - below).limit(1).first()["v"]


def nearest_set(pixels: DataFrame, set_: DataFrame) -> DataFrame:
    """(px, py, d2): squared distance of each pixel to the nearest set one; without any there is no row."""
    number = (F.shiftleft(F.col("px").cast("bigint"), 32) + F.col("py")).alias("_pixel")
    found = nearest.nearest(pixels.select(number, "px", "py").distinct(), set_.select(number, "px", "py").distinct().withColumnRenamed("_pixel", "_set"), ["px", "py"], "_pixel", "_set")
    px = F.shiftright(F.col("_pixel") + (1 << 31), 32)
    return found.select(px.cast("int").alias("px"), (F.col("_pixel") - F.shiftleft(px, 32)).cast("int").alias("py"), F.col("distance").alias("d2"))


def downsample(df: DataFrame, factor: int, preserve_counts: bool = True, others: tuple[str, ...] = ()) -> DataFrame:
    """Pixels merged by ``factor`` in both directions: sums, or means over the full block."""
    total = F.sum("value")
    value = total if preserve_counts else total / (factor * factor)
    return df.groupBy(F.floor(F.col("px") / factor).cast("int").alias("px"), F.floor(F.col("py") / factor).cast("int").alias("py"), *others).agg(value.alias("value"))


def upsample(df: DataFrame, factor: int, preserve_counts: bool = True) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = df.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    value = F.col("value") / (factor * factor) if preserve_counts else F.col("value").cast("double")
    return out.withColumn("px", F.col("px") * factor + F.col("i")).withColumn("py", F.col("py") * factor + F.col("j")).withColumn("value", value).drop("i", "j")


def rebin(df: DataFrame, axis: str, groups: list[tuple[int, int]]) -> DataFrame:
    """Bins of an axis added up to coarser ones, by a map literal of (bin, coarse bin); other bins go."""
    mapping = F.create_map(*[F.lit(x) for pair in groups for x in pair])
    return df.withColumn(axis, F.try_element_at(mapping, F.col(axis))).filter(F.col(axis).isNotNull()).groupBy(*[c for c in df.columns if c != "value"]).agg(F.sum("value").alias("value"))


def lookup(df: DataFrame, image: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the map value at their bin, null where the map has none."""
    return df.join(image, keys, "left")


def interpolate(df: DataFrame, x: Column, y: Column, image: DataFrame) -> DataFrame:
    """Rows with the bilinear value at pixel coordinates: four corners, each weighted by the opposite area."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    spread = df.withColumn("_x", x).withColumn("_y", y).withColumn("_c", corners)
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    wx, wy = F.when(F.col("_c.i") == 1, fx).otherwise(1 - fx), F.when(F.col("_c.j") == 1, fy).otherwise(1 - fy)
    spread = spread.withColumn("px", (F.floor("_x") + F.col("_c.i")).cast("int")).withColumn("py", (F.floor("_y") + F.col("_c.j")).cast("int")).withColumn("_w", wx * wy)
    met = spread.join(image.select("px", "py", "value"), ["px", "py"], "left")
    return met.groupBy(*df.columns).agg(F.sum(F.col("_w") * F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("value"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    """An operation on two maps, bin by bin; a missing bin is zero."""
    x, y = a.select(*keys, F.col("value").alias("x")), b.select(*keys, F.col("value").alias("y"))
    zero = F.lit(0)
    return x.join(y, keys, "full_outer").select(*keys, f(F.coalesce("x", zero), F.coalesce("y", zero)).alias("value"))


def dot(a: DataFrame, b: DataFrame, shared: list[str], keep: list[str]) -> DataFrame:
    """Sum of products over shared bins."""
    return a.join(b.withColumnRenamed("value", "other"), shared).groupBy(*keep).agg(F.sum(F.col("value") * F.col("other")).alias("value"))


def convolve(df: DataFrame, kernel: list[tuple[int, int, float]], keys: tuple[str, ...] = (), bounds: tuple[int, int] | None = None) -> DataFrame:
    """Scatter each non-zero pixel over the kernel (dx, dy, weight) and sum; ``bounds`` (width, height) cuts to the map."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel]))
    out = df.filter("value <> 0").withColumn("_k", offsets)
    out = out.groupBy(*keys, (F.col("px") + F.col("_k.dx")).alias("px"), (F.col("py") + F.col("_k.dy")).alias("py")).agg(F.sum(F.col("value") * F.col("_k.w")).alias("value"))
    return out if bounds is None else out.filter(F.col("px").between(0, bounds[0] - 1) & F.col("py").between(0, bounds[1] - 1))


def convolve_sums(df: DataFrame, kernel: list[tuple[int, int, float]], sums: dict[str, Column], bounds: tuple[int, int]) -> DataFrame:
    """(px, py, sums): several columns scattered over one kernel at once, zeros included."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in kernel]))
    out = df.select("px", "py", *[c.alias(n) for n, c in sums.items()], offsets.alias("_k"))
    out = out.groupBy((F.col("px") + F.col("_k.dx")).alias("px"), (F.col("py") + F.col("_k.dy")).alias("py")).agg(*[F.sum(F.col(n) * F.col("_k.w")).alias(n) for n in sums])
    return out.filter(F.col("px").between(0, bounds[0] - 1) & F.col("py").between(0, bounds[1] - 1))


def convolve_tiles(df: DataFrame, kernel: np.ndarray, tile: int = 256) -> DataFrame:
    """Convolution with a large kernel of odd size: square tiles with a halo, each by one Fourier transform.

    A pixel goes to every tile that its kernel reaches, so a task holds one tile and its halo, whatever the
    size of the map. Use it where scattering would multiply the pixels by more than about a thousand.
    """
    half = kernel.shape[0] // 2
    size = tile + 2 * half
    shape = (size + kernel.shape[0] - 1, size + kernel.shape[1] - 1)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        dense = np.zeros((size, size))
        np.add.at(dense, (rows.px.to_numpy() - tx * tile + half, rows.py.to_numpy() - ty * tile + half), rows.value.to_numpy())
        full = np.fft.irfft2(np.fft.rfft2(dense, shape) * np.fft.rfft2(kernel, shape), shape)[2 * half : 2 * half + tile, 2 * half : 2 * half + tile]
        x, y = np.nonzero(np.abs(full) > 1e-9 * max(1.0, float(np.abs(dense).max())))
        return pd.DataFrame({"px": x + tx * tile, "py": y + ty * tile, "value": full[x, y]})

    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile)))
    spread = df.filter("value <> 0").select("px", "py", F.col("value").cast("double").alias("value"), reach("px").alias("tx")).withColumn("ty", reach("py"))
    return spread.groupBy("tx", "ty").applyInPandas(run, "px bigint, py bigint, value double")


def disk(radius: float) -> list[tuple[int, int, int]]:
    n = int(radius)
    return [(i, j, 1) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def ring(inner: float, width: float) -> list[tuple[int, int, int]]:
    n = int(inner + width)
    return [(i, j, 1) for i in range(-n, n + 1) for j in range(-n, n + 1) if inner * inner <= i * i + j * j <= (inner + width) ** 2]


def _mirrored(axis: str, d: Column, size: int) -> Column:
    """The targets that a pixel serves at a distance: itself moved, and the mirror images of those beyond a border."""
    return F.filter(F.array(F.col(axis) + d, -1 - F.col(axis) + d, 2 * size - 1 - F.col(axis) + d), lambda t: (t >= 0) & (t < size))


def _smooth_axes(df: DataFrame, weights: list[tuple[int, float]], width: int, height: int) -> DataFrame:
    """Two passes of one dimension each with a symmetric kernel that sums to one, the map mirrored at its borders."""
    out = df.select("px", "py", F.col("value").cast("double").alias("value"))
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights])
    for axis, size, other in (("px", width, "py"), ("py", height, "px")):
        targets = F.flatten(F.transform(kernel, lambda k: F.transform(_mirrored(axis, k["d"], size), lambda t: F.struct(t.alias("t"), k["w"].alias("w")))))  # noqa: B023
        out = out.select(other, F.explode(targets).alias("k"), "value").groupBy(other, F.col("k.t").alias(axis)).agg(F.sum(F.col("value") * F.col("k.w")).alias("value"))
    return out.select("px", "py", "value")


def smooth_box(df: DataFrame, half: int, width: int, height: int) -> DataFrame:
    """Mean over a square."""
    return _smooth_axes(df, [(d, 1 / (2 * half + 1)) for d in range(-half, half + 1)], width, height)


def smooth_gauss(df: DataFrame, sigma: float, width: int, height: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian of ``sigma`` pixels, cut at ``truncate`` sigmas."""
    half = int(truncate * sigma)
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    return _smooth_axes(df, [(d - half, w / sum(raw)) for d, w in enumerate(raw)], width, height)


def smooth_disk(df: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Mean over a disk; a pixel serves the products of its targets in both directions."""
    kernel = disk(radius)
    spread = df.filter("value <> 0").withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in kernel])))
    spread = spread.withColumn("tx", F.explode(_mirrored("px", F.col("k.i"), width))).withColumn("ty", F.explode(_mirrored("py", F.col("k.j"), height)))
    return spread.groupBy(F.col("tx").alias("px"), F.col("ty").alias("py")).agg((F.sum("value") / len(kernel)).alias("value"))


def integral(cube: DataFrame, keys: list[str], e_width: float, low: float, high: float) -> DataFrame:
    """(keys, value): the spectrum (e, value) of each key between two energies, a bin counting by the share of it inside."""
    inside = F.greatest(F.least((F.col("e") + 1) * e_width, F.lit(high)) - F.greatest(F.col("e") * e_width, F.lit(low)), F.lit(0.0))
    return cube.groupBy(*keys).agg(F.sum(F.col("value") * inside / e_width).alias("value"))


def _within(mask: DataFrame, radius: float) -> DataFrame:
    """(px, py) within the radius of a set pixel: the least squared distance along rows, then across them, each pixel visited 2 radius + 1 times twice."""
    n = int(radius)
    steps = F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("d")
    along = mask.select("px", "py", steps).groupBy((F.col("px") + F.col("d")).alias("px"), "py").agg(F.min(F.col("d") * F.col("d")).alias("d2"))
    across = along.select("px", "py", "d2", steps).filter(F.col("d2") + F.col("d") * F.col("d") <= radius * radius)
    return across.select("px", (F.col("py") + F.col("d")).alias("py")).distinct()


def dilate(mask: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Pixels with a set pixel within the radius."""
    near = _within(mask, radius)
    return near.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).select("px", "py", F.lit(1).alias("value"))


def erode(spark: SparkSession, mask: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Pixels whose whole disk is set; outside the map nothing is."""
    n = int(radius)
    bare = grid(spark, width, height).join(mask.select("px", "py"), ["px", "py"], "left_anti")
    inner = mask.filter(F.col("px").between(n, width - 1 - n) & F.col("py").between(n, height - 1 - n)).select("px", "py")
    return inner.join(_within(bare, radius), ["px", "py"], "left_anti").select("px", "py", F.lit(1).alias("value"))


def peaks(df: DataFrame, threshold: float, min_distance: int) -> DataFrame:
    """Pixels above the threshold that no pixel of their box exceeds, highest first: maxima along rows, then across them."""
    steps = F.explode(F.sequence(F.lit(-min_distance), F.lit(min_distance))).alias("_d")
    along = df.select("px", "py", "value", steps).groupBy((F.col("px") + F.col("_d")).alias("px"), "py").agg(F.max("value").alias("top"))
    around = along.select("px", "py", "top", steps).groupBy("px", (F.col("py") + F.col("_d")).alias("py")).agg(F.max("top").alias("top"))
    return df.join(around, ["px", "py"]).filter((F.col("value") > threshold) & (F.col("value") >= F.col("top"))).drop("top").orderBy(F.desc("value"), "px", "py")


def cumulative(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Running sums with what lies before each row (0 first) and the total."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("upto", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("before", F.col("upto") - F.col(value)).withColumn("total", F.sum(value).over(Window.partitionBy(*keys)))
