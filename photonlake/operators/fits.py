"""Norm fits of very many groups, or of groups of very many bins, in lockstep.

The norm of a group maximises the Poisson likelihood of background + norm * signal over its bins. The derivative is a sum
over bins that grows with the norm and bends downwards, so Newton steps from its left never overshoot. Each round is one
aggregation that sums, for every group at once, the derivative at the next points; bins stay rows, whatever
their number, and partial sums precede the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.sources.store import Rounds

#: Points at which the first two rounds sum the derivative; groups of which the norms are sent to all tasks; Newton steps at most.
POINTS, FEW, STEPS = 32, 100_000, 40
_TINY = 1e-300


def _slope(x: Column) -> Column:
    return F.sum(F.col("m") * F.col("s") * (1 - F.col("n") / F.greatest(x * F.col("s") + F.col("b"), F.lit(_TINY))))


def fit_norms(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, norm, norm_err, ts) of each group of bins (counts, background, signal): one flux point, one map pixel.

    Bins without signal count for nothing. Bins alike are one row with a multiplicity. Without counts the norm is the lowest that
    leaves no prediction negative, without an error; a group without signal has nulls. Keys must not be null.
    """
    rounds = Rounds(df.sparkSession, "norms")
    as_double = [F.col(c).cast("double").alias(n) for c, n in (("counts", "n"), ("background", "b"), ("signal", "s"))]
    bins = rounds.table(df.select(*keys, *as_double).groupBy(*keys, "n", "b", "s").agg(F.count("*").cast("double").alias("m")))
    used = F.col("s") > 0
    groups = bins.groupBy(*keys).agg(
        F.count_if(used).alias("used"),
        (-F.min(F.when(used, F.col("b") / F.col("s")))).alias("lowest"),
        (F.max(F.when(used, F.col("n") / F.col("s"))) + 1.0).alias("highest"),
        F.sum(F.when(used, F.col("m") * F.col("n"))).alias("all"),
        F.sum(F.when(used, F.col("m") * F.col("s"))).alias("signals"),
    )
    groups = rounds.table(groups)
    few = groups.count() <= FEW
    bins = bins.filter(used)
    meet = lambda state: bins.join(F.broadcast(state) if few else state, keys)
    # From the lowest norm on, the derivative is looked at in ever finer steps, then between the two points where its sign turns.
    start = F.col("lowest") + 1e-9 * (1 + F.abs("lowest"))
    state = groups.filter("used > 0 and `all` > 0").select(*keys, start.alias("left"), F.col("highest").alias("right"))
    span = F.col("right") - F.col("left")
    for steps in ([2.0 ** (k - POINTS) for k in range(POINTS)], [k / POINTS for k in range(1, POINTS)]):
        at = [F.lit(0.0), *[F.lit(x) for x in steps]]
        sums = meet(state).groupBy(*keys, "left", "right").agg(F.array(*[_slope(F.col("left") + span * x) for x in at]).alias("slopes"))
        turn = F.size(F.filter("slopes", lambda y: y < 0))  # the derivative only grows
        points = F.array(*at, F.lit(1.0))
        left = F.when(turn == 0, F.col("left")).otherwise(F.col("left") + span * F.get(points, turn - 1))
        right = F.when(turn == 0, F.col("left")).otherwise(F.col("left") + span * F.get(points, turn))
        state = rounds.table(sums.select(*keys, left.alias("left"), right.alias("right")))
    done = state.filter("right <= left").select(*keys, F.col("left").alias("norm"))
    open_ = state.filter("right > left").select(*keys, F.col("left").alias("norm"))
    for _ in range(STEPS):
        mu = F.greatest(F.col("norm") * F.col("s") + F.col("b"), F.lit(_TINY))
        sums = meet(open_).groupBy(*keys, "norm").agg(_slope(F.col("norm")).alias("f"), F.sum(F.col("m") * F.col("n") * F.col("s") * F.col("s") / (mu * mu)).alias("g"))
        step = -F.col("f") / F.col("g")
        moved = rounds.table(sums.select(*keys, (F.col("norm") + F.coalesce(step, F.lit(0.0))).alias("norm"), F.coalesce(F.abs(step) <= 1e-13 * (1e-3 + F.abs("norm")), F.lit(True)).alias("still")))
        done = done.unionByName(moved.filter("still").drop("still"))
        open_ = moved.filter("not still").drop("still")
        if open_.isEmpty():
            break
    norms = rounds.table(done.unionByName(open_))
    mu, null = F.greatest(F.col("norm") * F.col("s") + F.col("b"), F.lit(_TINY)), F.greatest(F.col("b"), F.lit(1e-25))
    part = lambda y: y - F.when(F.col("n") > 0, F.col("n") * F.log(y)).otherwise(0.0)
    stats = meet(norms).groupBy(*keys, "norm").agg((1 / F.sqrt(F.sum(F.col("m") * F.col("n") * F.col("s") * F.col("s") / (mu * mu)))).alias("norm_err"), F.sum(F.col("m") * 2 * (part(null) - part(mu))).alias("ts"))
    none, empty = F.col("used") == 0, F.col("all") == 0
    return groups.join(stats, keys, "left").select(
        *keys,
        F.when(none, None).when(empty, F.col("lowest")).otherwise(F.col("norm")).alias("norm"),
        F.when(none | empty, None).otherwise(F.col("norm_err")).alias("norm_err"),
        F.when(none, None).when(empty, 2 * F.col("lowest") * F.col("signals")).otherwise(F.col("ts")).alias("ts"),
    )


def fit_map(pixels: DataFrame, kernel: np.ndarray, tile: int = 64) -> DataFrame:
    """(px, py, norm, norm_err, ts) of a source at each pixel that sees any signal: ``fit_norms`` for kernels too wide to scatter.

    ``pixels`` (px, py, counts, background, exposure); the source's signal in a pixel is kernel times exposure there. Tiles
    carry a halo of half the kernel and solve all their pixels together, so a task holds one tile, whatever the size of the map.
    """
    half = kernel.shape[0] // 2
    size = tile + 2 * half

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        at = rows.px.to_numpy() - tx * tile + half, rows.py.to_numpy() - ty * tile + half
        maps = np.zeros((3, size, size))
        for m, c in zip(maps, ("counts", "background", "exposure"), strict=True):
            m[at] = rows[c]
        parts = []
        for x in range(tile):
            n, b, e = (np.lib.stride_tricks.sliding_window_view(m[x : x + 2 * half + 1], kernel.shape)[0] for m in maps)
            s = e * kernel
            found = _solve(n.reshape(tile, -1), b.reshape(tile, -1), s.reshape(tile, -1))
            parts.append(pd.DataFrame({"px": tx * tile + x, "py": ty * tile + np.arange(tile), "norm": found[0], "norm_err": found[1], "ts": found[2], "seen": (s > 0).any(axis=(1, 2))}))
        out = pd.concat(parts)
        return out[out.seen].drop(columns="seen")

    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile)))
    doubles = [F.col(c).cast("double").alias(c) for c in ("counts", "background", "exposure")]
    spread = pixels.select("px", "py", *doubles, reach("px").alias("tx")).withColumn("ty", reach("py"))
    return spread.groupBy("tx", "ty").applyInPandas(run, "px bigint, py bigint, norm double, norm_err double, ts double")


def _solve(n: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fits of all rows of (counts, background, signal) at once, by halving and Newton steps."""
    use = s > 0
    n, b, s = np.where(use, n, 0), np.where(use, b, 1), np.where(use, s, 0)
    with np.errstate(all="ignore"):
        ratio = np.where(use, b / np.where(use, s, 1), np.inf)
        lowest, highest = -ratio.min(axis=1), np.where(use, n / np.where(use, s, 1), -np.inf).max(axis=1) + 1
        low, high = lowest + 1e-9 * (1 + np.abs(lowest)), highest
        slope = lambda x: (s * (1 - n / np.maximum(x[:, None] * s + b, _TINY))).sum(axis=1)
        for _ in range(40):
            middle = (low + high) / 2
            below = slope(middle) < 0
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        norm = low
        for _ in range(4):
            mu = np.maximum(norm[:, None] * s + b, _TINY)
            g = (n * s * s / (mu * mu)).sum(axis=1)
            norm = norm - np.where((g > 0) & (slope(norm) < 0), slope(norm) / np.where(g > 0, g, 1), 0)
        mu, null = np.maximum(norm[:, None] * s + b, _TINY), np.maximum(b, 1e-25)
        part = lambda y: y - np.where(n > 0, n * np.log(y), 0)
        ts = np.where(use, 2 * (part(null) - part(mu)), 0).sum(axis=1)
        error = 1 / np.sqrt((n * s * s / (mu * mu)).sum(axis=1))
        total, lowest_ts = n.sum(axis=1), 2 * lowest * s.sum(axis=1)
    none, empty = ~use.any(axis=1), total == 0
    pick = lambda some, blank: np.where(none, np.nan, np.where(empty, blank, some))
    return pick(norm, lowest), pick(error, np.nan), pick(ts, lowest_ts)
