"""Series of fluxes: variability, rebinning folds, pairs of times. Rows (series, t, flux, err); NaN fluxes are not measured."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.operators import scan
from photonlake.sources.store import Rounds


def _valid(df: DataFrame) -> DataFrame:
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.withColumn("flux", ok("flux")).withColumn("err", ok("err"))


def fractional_variance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Excess of the sample variance over the mean squared error, relative to the mean flux, with its error."""
    g = _valid(df).groupBy(*keys).agg(F.avg("flux").alias("m"), F.var_samp("flux").alias("v"), F.avg(F.col("err") * F.col("err")).alias("s"), F.count("flux").alias("n"))
    f = F.sqrt(F.abs(F.col("v") - F.col("s"))) / F.col("m")
    a = F.sqrt(2 / F.col("n")) * F.col("s") / (F.col("m") * F.col("m"))
    b = F.sqrt(F.col("s") / F.col("n")) * 2 * f / F.col("m")
    return g.select(*keys, f.alias("fvar"), (F.sqrt(a * a + b * b) / (2 * f)).alias("fvar_err"))


def point_to_point(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As above, from the differences of neighbours; differences touching a missing flux drop out."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = _valid(df).withColumn("diff", F.col("flux") - F.lag("flux").over(w))
    g = d.groupBy(*keys).agg(F.avg("flux").alias("m"), F.coalesce(F.sum(F.col("diff") * F.col("diff")), F.lit(0.0)).alias("q"), F.avg(F.col("err") * F.col("err")).alias("s"), F.count("flux").alias("n"))
    f = F.sqrt(F.abs(F.col("q") / (F.col("n") - 1) - F.col("s"))) / F.col("m")
    a = F.sqrt(2 / F.col("n")) * F.col("s") / (F.col("m") * F.col("m"))
    b = F.sqrt(F.col("s") / F.col("n")) * 2 * f / F.col("m")
    return g.select(*keys, f.alias("fpp"), (F.sqrt(a * a + b * b) / (2 * f)).alias("fpp_err"))


def constancy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chi-square of a constant flux at the mean, by (y - m)^2 / m."""
    m = F.avg("flux").over(Window.partitionBy(*keys))
    d = _valid(df).withColumn("m", m)
    return d.groupBy(*keys).agg(F.sum((F.col("flux") - F.col("m")) * (F.col("flux") - F.col("m")) / F.col("m")).alias("chi2"), (F.count("flux") - 1).alias("df"))


def doubling_time(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Shortest doubling and halving time between neighbours, each with its error and the middle of its interval."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = lambda c: F.lag(c).over(w)
    d = _valid(df).select(*keys, F.col(order).alias("t2"), "flux", "err", prev(order).alias("t1"), prev("flux").alias("f1"), prev("err").alias("e1"))
    dt = (F.col("t2") - F.col("t1")).cast("double")
    ratio = F.when((F.col("flux") > 0) & (F.col("f1") > 0) & (F.col("flux") != F.col("f1")), F.col("flux") / F.col("f1"))
    time = dt / F.log2(ratio)
    rel = F.sqrt(F.pow(F.col("err") / F.col("flux"), 2) + F.pow(F.col("e1") / F.col("f1"), 2))
    err = F.abs(dt * F.log(F.lit(2.0)) / F.pow(F.log(ratio), 2) * rel)
    d = d.withColumn("time", time).withColumn("time_err", err).withColumn("mid", (F.col("t1") + F.col("t2")) / 2)
    pick = lambda positive: F.min(F.when(F.col("time") > 0 if positive else F.col("time") < 0, F.struct(F.abs("time").alias("time"), "mid", "time_err")))
    g = d.groupBy(*keys).agg(pick(True).alias("up"), pick(False).alias("down"))
    out = [F.col(f"{a}.{c}").alias(f"{n}_{m}") for a, n in (("up", "doubling"), ("down", "halving")) for c, m in (("time", "time"), ("time_err", "err"), ("mid", "coord"))]
    return g.select(*keys, *out)


def _bucket_pairs(x: DataFrame, y: DataFrame, keys: list[str], width: float) -> DataFrame:
    """All pairs of rows (keys..., t1, ...) and (keys..., t2, ...): they meet by series and pair of time buckets, so a long series is many groups."""
    x, y = x.withColumn("_x", F.floor(F.col("t1") / width)), y.withColumn("_y", F.floor(F.col("t2") / width))
    own = lambda df, c: df.select(*keys, c).distinct()
    return x.join(own(y, "_y"), keys).join(y.join(own(x, "_x"), keys), [*keys, "_x", "_y"]).drop("_x", "_y")


def pairs(df: DataFrame, keys: list[str], order: str, longest: int | None = None, width: int = 256) -> DataFrame:
    """Later-than pairs of a series, all or up to a lag: rows then meet by series and time bucket of that length, own and next."""
    if longest is None:
        base = _valid(df).filter("flux is not null")
        one = lambda s: base.select(*keys, F.col(order).alias(f"t{s}"), F.col("flux").alias(f"f{s}"), F.col("err").alias(f"e{s}"))
        return _bucket_pairs(one(1), one(2), keys, width).filter("t2 > t1")
    base = _valid(df).filter("flux is not null").withColumn("_b", F.floor(F.col(order) / longest))
    first = base.select(*keys, "_b", F.col(order).alias("t1"), F.col("flux").alias("f1"), F.col("err").alias("e1"))
    second = base.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") - 1))).select(*keys, "_b", F.col(order).alias("t2"), F.col("flux").alias("f2"), F.col("err").alias("e2"))
    met = first.join(second, [*keys, "_b"])
    return met.filter((F.col("t2") > F.col("t1")) & (F.col("t2") - F.col("t1") <= longest)).drop("_b")


#: Rows of a series, on either side, that one group of pairs holds at most.
GROUP_ROWS = 2048


def _stretches(df: DataFrame, keys: list[str], rows: int, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """The rows of each series with the number of their stretch of ``rows`` rows in order of t, and (keys, stretch, first, last).

    Ranks are running counts over slices of the whole table, so that a long series is not sorted in one task.
    """
    ranked = scan.running(scan.sliced(df, keys, ["t"], rounds), keys, ["t"], sums={"_rank": F.lit(1)})
    cut = rounds.table(ranked.select(*df.columns, F.floor((F.col("_rank") - 1) / rows).cast("int").alias("_own")))
    return cut, cut.groupBy(*keys, F.col("_own").alias("_other")).agg(F.min("t").alias("_of"), F.max("t").alias("_ol"))


def _summed(parts: list[list[np.ndarray]], sums: int) -> list[np.ndarray]:
    """Parts (lags, sums..., n) as one part with each lag once; lags that lie far apart are sorted instead of counted off."""
    lags, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
    low, high = lags.min(), lags.max()
    if high - low < 8 * len(lags) + 1024:
        at, found = lags - low, None
        width = int(high - low) + 1
    else:
        found, at = np.unique(lags, return_inverse=True)
        width = len(found)
    n = np.bincount(at, values[-1] if len(values) > sums else None, width)
    kept = np.flatnonzero(n)
    return [kept + low if found is None else found, *(np.bincount(at, v, width)[kept] for v in values[:sums]), n[kept].astype(np.int64)]


def pair_sums(x: DataFrame, y: DataFrame, keys: list[str], lag: Callable, terms: Callable, sums: list[str], later: bool = False, rows: int = 512, longest: float | None = None, group: int = GROUP_ROWS) -> DataFrame:
    """(keys, lag, sums, n): sums over all pairs of rows (keys, t, ...) of ``x`` and ``y``, by a binned difference of times.

    A series of at most ``group`` rows a side is one group, whose sums are complete when they leave it. A longer one is cut by rank
    in time into stretches of that many rows, and each pair of stretches is a group (with ``later`` only pairs that hold a later
    ``y``, with ``longest`` only those that hold one within that lag), whose sums are added up. A group works through pairs of
    blocks of ``rows`` rows, of which only one exists as a matrix at a time. ``lag`` turns the matrix t(y) - t(x) into integers and a mask, ``terms``
    the blocks' columns into matrices to sum.
    """
    rounds = Rounds(x.sparkSession, "pairs")
    same = y is x
    x = rounds.table(x.filter("t is not null"))
    y = x if same else rounds.table(y.filter("t is not null"))
    own = [c for c in x.columns if c not in keys]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    counts = count(x, "_nx").withColumn("_ny", F.col("_nx")) if same else count(x, "_nx").join(count(y, "_ny"), keys)
    counts = rounds.table(counts)
    fits = (F.col("_nx") <= group) & (F.col("_ny") <= group)
    sided = lambda df, side: df.withColumn("_side", F.lit(side))
    of = lambda which: lambda df: df.join(counts.filter(which).select(*keys), keys, "left_semi")
    short, long = of(fits), of(~fits)
    whole = sided(short(x), 2) if same else sided(short(x), 0).unionByName(sided(short(y), 1))
    kept = [T.StructField(f.name, f.dataType) for f in x.schema.fields if f.name in keys]
    schema = T.StructType([*kept, T.StructField("lag", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums], T.StructField("n", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        held = {c: table.column(c).cast(pa.float64()).to_numpy() for c in own}
        a, b = ({c: v[side != no] for c, v in held.items()} for no in (1, 0))
        a, b = ({c: v[order] for c, v in m.items()} for m in (a, b) for order in (np.argsort(m["t"], kind="stable"),))
        blocks = [[{c: v[k : k + rows] for c, v in m.items()} for k in range(0, len(m["t"]), rows)] for m in (a, b)]
        parts, waiting = [], 0
        for one in blocks[0]:
            for two in blocks[1]:
                if later and two["t"][-1] <= one["t"][0] or longest is not None and two["t"][0] - one["t"][-1] > longest:
                    continue
                u, v = {c: m[:, None] for c, m in one.items()}, {c: m[None, :] for c, m in two.items()}
                bins, use = lag(v["t"] - u["t"])
                every = bool(use.all())
                pick = (lambda m: m.ravel()) if every else (lambda m: m[use])  # noqa: B023
                bins = pick(bins)
                if not len(bins):
                    continue
                parts.append(_summed([[bins, *(pick(m) for m in terms(u, v))]], len(sums)))
                waiting += len(parts[-1][0])
                if waiting > 1 << 20:
                    parts = [_summed(parts, len(sums))]
                    waiting = len(parts[0][0]) // 2
        out = _summed(parts, len(sums)) if parts else [np.zeros(0, np.int64), *(np.zeros(0) for _ in sums), np.zeros(0, np.int64)]
        key = [pa.repeat(table.column(f.name)[0], len(out[0])) for f in kept]
        return pa.Table.from_arrays([*key, *(pa.array(c) for c in out)], names=schema.names)

    done = whole.groupBy(*keys).applyInArrow(run, schema)
    if counts.filter(~fits).isEmpty():
        return done
    cx = _stretches(long(x), keys, group, rounds)
    cy = cx if same else _stretches(long(y), keys, group, rounds)
    sides = []
    for side, (one, _), (_, spans) in ((0, cx, cy), (1, cy, cx)):
        bounds = one.groupBy(*keys, "_own").agg(F.min("t").alias("_f"), F.max("t").alias("_l")).join(spans, keys)
        ahead = (F.col("_ol") - F.col("_f"), F.col("_of") - F.col("_l")) if side == 0 else (F.col("_l") - F.col("_of"), F.col("_f") - F.col("_ol"))
        if later:
            bounds = bounds.filter(ahead[0] > 0)
        if longest is not None:
            bounds = bounds.filter(ahead[1] <= longest)
        i, j = ("_own", "_other") if side == 0 else ("_other", "_own")
        met = one.join(bounds.select(*keys, "_own", "_other"), [*keys, "_own"])
        sides.append(sided(met.select(*keys, F.col(i).alias("_i"), F.col(j).alias("_j"), *own), side))
    parts = sides[0].unionByName(sides[1]).groupBy(*keys, "_i", "_j").applyInArrow(run, schema)
    return done.union(parts.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in sums], F.sum("n").alias("n")))


def structure_function(df: DataFrame, keys: list[str], order: str, rows: int = 512, longest: float | None = None) -> DataFrame:
    """Weighted mean squared difference of all later-than pairs (up to a lag, if any is named), by lag rounded to a whole number."""
    block = rows
    rows = _valid(df).filter("flux is not null").select(*keys, F.col(order).alias("t"), "flux", (F.col("flux") / F.col("err")).alias("w"))

    def terms(a, b):
        w = a["w"] * b["w"]
        return [(b["flux"] - a["flux"]) ** 2 * w, w]

    use = lambda d: (d > 0) if longest is None else (d > 0) & (d <= longest)
    sums = pair_sums(rows, rows, keys, lambda d: (np.rint(d).astype(np.int64), use(d)), terms, ["d", "w"], later=True, rows=block, longest=longest)
    return sums.select(*keys, "lag", (F.col("d") / F.col("w")).alias("sf"), "n")


def discrete_correlation(a: DataFrame, b: DataFrame, keys: list[str], tau: float, rows: int = 512) -> DataFrame:
    """Mean product of two normalised series by binned lag t1 - t2, with its error; rows (keys..., t, flux, err)."""

    def normal(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        z = (F.col("flux") - F.avg("flux").over(w)) / F.sqrt(F.pow(F.stddev_pop("flux").over(w), 2) - F.pow(F.avg("err").over(w), 2))
        return _valid(df).filter("flux is not null").select(*keys, "t", z.alias("z")).filter("z is not null and not isnan(z)")

    terms = lambda x, y: [x["z"] * y["z"], (x["z"] * y["z"]) ** 2]
    g = pair_sums(normal(a), normal(b), keys, lambda d: (np.floor(-d / tau).astype(np.int64), np.ones(d.shape, bool)), terms, ["p", "q"], rows=rows)
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("p") / F.col("n"), 2), F.lit(0.0))
    return g.select(*keys, F.col("lag").cast("int").alias("bin"), (F.col("p") / F.col("n")).alias("dcf"), F.when(F.col("n") > 1, F.sqrt(var * F.col("n")) / (F.col("n") - 1)).alias("err"), "n")


def integrate_log_log(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, integral) of positive values on a grid, a power law between neighbours (its logarithm where the index is -1)."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.withColumn("_x", F.lead(x).over(w)).withColumn("_y", F.lead(y).over(w)).filter("_x is not null")
    ratio = F.col("_x") / F.col(x)
    b = F.log(F.col("_y") / F.col(y)) / F.log(ratio)
    part = F.when(F.abs(b + 1) < 1e-10, F.col(x) * F.col(y) * F.log(ratio)).otherwise(F.col(x) * F.col(y) / (b + 1) * (F.pow(ratio, b + 1) - 1))
    return d.groupBy(*keys).agg(F.sum(part).alias("integral"))


def merge_until(df: DataFrame, keys: list[str], order: str, sums: list[str], enough: callable) -> DataFrame:
    """Merge adjacent bins greedily: a group closes when ``enough`` of its running sums holds; a last, unfinished one stays.

    One fold over the sorted bins of each series; the bins of a series are an axis and fit a row.
    """
    item = F.struct(F.col(order).alias("at"), *[F.col(c).cast("double").alias(c) for c in sums])
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("bins"))
    group = "struct<first: bigint, last: bigint, " + ", ".join(f"{c}: double" for c in sums) + ">"
    start = F.struct(F.expr(f"cast(array() as array<{group}>)").alias("done"), F.expr(f"cast(null as {group})").alias("open"))

    def step(s: Column, x: Column) -> Column:
        o = s["open"]
        new = F.struct(F.coalesce(o["first"], x["at"].cast("bigint")).alias("first"), x["at"].cast("bigint").alias("last"), *[(F.coalesce(o[c], F.lit(0.0)) + x[c]).alias(c) for c in sums])
        full = enough(new)
        return F.struct(F.when(full, F.concat(s["done"], F.array(new))).otherwise(s["done"]).alias("done"), F.when(~full, new).alias("open"))

    out = F.aggregate("bins", start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return rows.select(*keys, F.posexplode(out).alias("group", "g")).select(*keys, "group", "g.*")
