"""Binned axes: small driver-side descriptions that turn coordinates into bins as Column expressions."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCALES = {"lin": (lambda x: x, lambda x: x), "log": (math.log, math.exp), "sqrt": (math.sqrt, lambda x: x * x)}


def _log(x: Column) -> Column:
    """The logarithm with its limits, where Spark's own has null: minus infinity at zero, NaN below."""
    return F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def _scale(x: Column, interp: str) -> Column:
    return {"lin": lambda: x, "log": lambda: _log(x), "sqrt": lambda: F.sqrt(x)}[interp]()


def _unscale(x: Column, interp: str) -> Column:
    return {"lin": lambda: x, "log": lambda: F.exp(x), "sqrt": lambda: x * x}[interp]()


@dataclass(frozen=True)
class Axis:
    """Ordered bin edges with an interpolation rule."""

    name: str
    edges: tuple[float, ...]
    interp: str = "lin"

    @staticmethod
    def from_bounds(name: str, low: float, high: float, bins: int, interp: str = "lin", per_decade: bool = False) -> Axis:
        """``bins`` bins between the bounds, or that many per decade (rounded up) on a log axis."""
        to, back = _SCALES[interp]
        if per_decade:
            bins = math.ceil(bins * (math.log10(high) - math.log10(low)) - 1e-9)
        a, b = to(low), to(high)
        inner = [back(a + (b - a) * i / bins) for i in range(1, bins)]
        return Axis(name, (low, *inner, high), interp)

    @property
    def bins(self) -> int:
        return len(self.edges) - 1

    @property
    def uniform(self) -> bool:
        to = _SCALES[self.interp][0]
        steps = [to(b) - to(a) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        return max(steps) - min(steps) <= 1e-9 * max(map(abs, steps))

    def centers(self) -> list[float]:
        to, back = _SCALES[self.interp]
        return [back((to(a) + to(b)) / 2) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, lo, hi, center), one row per bin."""
        rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.centers(), strict=False))]
        return spark.createDataFrame(rows, "idx int, lo double, hi double, center double")

    def index(self, x: Column, clip: bool = False) -> Column:
        """Bin by half-open edges: -1 below the first edge, above the last or where not finite; the number of bins exactly on the last."""
        below = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e <= x)) - 1
        inside = F.when(x.isNull() | F.isnan(x) | (x > self.edges[-1]), -1).otherwise(below)
        return F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), F.when(x > self.edges[-1], self.bins - 1).otherwise(inside))) if clip else inside

    def pixel(self, x: Column) -> Column:
        """Continuous coordinate: integers are bin centers in the axis's scale; interpolated between centers where bins differ."""
        to = _SCALES[self.interp][0]
        y = _scale(x, self.interp)
        if self.uniform:
            low, high = to(self.edges[0]), to(self.edges[-1])
            return (y - low) / ((high - low) / self.bins) - 0.5
        nodes = [to(c) for c in self.centers()]
        out = None
        for i in range(len(nodes) - 1):
            part = i + (y - nodes[i]) / (nodes[i + 1] - nodes[i])
            out = F.when(y < nodes[i + 1], part) if out is None else out.when(y < nodes[i + 1], part)
        last = len(nodes) - 2
        return out.otherwise(last + (y - nodes[last]) / (nodes[last + 1] - nodes[last]))

    def coordinate(self, pixel: Column) -> Column:
        """Inverse of ``pixel`` on an axis of equal bins."""
        to = _SCALES[self.interp][0]
        low, high = to(self.edges[0]), to(self.edges[-1])
        return _unscale(low + (pixel + 0.5) * ((high - low) / self.bins), self.interp)

    def fill_index(self, x: Column) -> Column:
        """Bin that an event falls into when a map is filled; null outside."""
        p = self.pixel(x) + 0.5
        return F.when((p >= 0) & (p < self.bins), F.floor(p).cast("int"))

    def nearest_edge(self, x: Column) -> Column:
        """The edge closest to a coordinate; the middle of two edges, as their mean is rounded, belongs to the upper one. Without a coordinate the last."""
        out = F
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            out = out.when(x < (a + b) / 2, a)
        return out.otherwise(self.edges[-1])

    def groups(self, low: float, high: float) -> list[tuple[str, int, int]]:
        """(kind, first bin, last bin): what lies below, within and above the edges nearest to two bounds."""
        a = min(range(len(self.edges)), key=lambda i: abs(self.edges[i] - low))
        b = min(range(len(self.edges)), key=lambda i: abs(self.edges[i] - high))
        out = [("underflow", 0, a - 1), ("normal", a, b - 1), ("overflow", b, self.bins - 1)]
        return [g for g in out if g[1] <= g[2]]

    def coarser(self, edges: list[float]) -> list[tuple[int, int]]:
        """(bin, coarse bin) of every bin whose center lies in the coarse edges."""
        return [(i, bisect.bisect_right(edges, c) - 1) for i, c in enumerate(self.centers()) if edges[0] <= c < edges[-1]]


def wrap(x: Column, low: float, period: float) -> Column:
    """Coordinate of a periodic axis, brought into one period."""
    return low + F.pmod(x - low, F.lit(period))
