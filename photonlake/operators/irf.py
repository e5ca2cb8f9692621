"""Instrument responses as tables: nodes of energy and offset for every response, found by bisection and interpolated.

Nodes come as rows (key, kind, energy, offset, value), an axis product for each kind, and are folded into one row per response
with a struct of arrays per kind. Runs name their response; whatever needs its values joins on that name, so
that no response is part of a plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the smallest positive single-precision number, below which a logarithmic scale holds zeros.
TINY = 1.1754943508222875e-38


def folded(nodes: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """(key, a struct per kind of energy, offset, value): the nodes of each response, values row by row in energy.

    A kind that is no axis product raises when the result is computed; a kind without nodes is null.
    """
    rows = nodes.filter(F.col("kind").isin(kinds)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("kind", "energy", "offset", "value"))).alias("_n"))
    out = [F.col(key)]
    for kind in kinds:
        mine = F.filter("_n", lambda n: n["kind"] == F.lit(kind))  # noqa: B023
        axes = F.array_sort(F.array_distinct(F.transform(mine, lambda n: n["energy"]))), F.array_sort(F.array_distinct(F.transform(mine, lambda n: n["offset"])))
        table = F.struct(axes[0].alias("energy"), axes[1].alias("offset"), F.transform(mine, lambda n: n["value"]).alias("value"))
        whole = F.size(axes[0]) * F.size(axes[1]) == F.size(mine)
        out.append(F.when(F.size(mine) == 0, None).when(whole, table).otherwise(F.raise_error(F.lit(f"the nodes of {kind} are no axis product")).cast("struct<energy: array<double>, offset: array<double>, value: array<double>>")).alias(kind))
    return rows.select(*out)


def bracket(nodes: Column, x: Column) -> Column:
    """The place of the last of the sorted ``nodes`` that is not above ``x``, at least the first and at most the last but one, by bisection."""
    last = F.size(nodes) - 1
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(last, F.lit(1)))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (F.get(nodes, middle) <= x) & (middle > s["low"])
        left = (F.get(nodes, middle) > x) & (middle < s["high"])
        return F.struct(F.when(right, middle).otherwise(s["low"]).alias("low"), F.when(left, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), last.alias("high")), halve, lambda s: s["low"])


def value(table: Column, energy: Column, offset: Column, log: bool = False, outside: float | None = 0.0) -> Column:
    """A response between its nodes: linear in the logarithm of energy and in offset, of the values or (``log``) of their logarithms.

    Beyond the nodes it is ``outside``, or with None goes on from the last two. An axis of one node is constant.
    """
    es, os = table["energy"], table["offset"]

    def between(nodes: Column, i: Column, x: Column, scale) -> Column:
        low, high = F.get(nodes, i), F.get(nodes, i + 1)
        return F.when(high.isNull(), 0.0).otherwise((scale(x) - scale(low)) / (scale(high) - scale(low)))

    def inner(s: Column) -> Column:
        a, b = between(es, s["i"], energy, F.log), between(os, s["j"], offset, lambda c: c)
        wide = F.size(os)

        def corner(di: int, dj: int) -> Column:
            v = F.get(table["value"], F.least(s["i"] + di, F.size(es) - 1) * wide + F.least(s["j"] + dj, wide - 1))
            return F.log(F.greatest(v, F.lit(TINY))) if log else v

        low = (1 - b) * corner(0, 0) + b * corner(0, 1)
        high = (1 - b) * corner(1, 0) + b * corner(1, 1)
        out = (1 - a) * low + a * high
        return F.when(F.exp(out) > TINY * (1 + 1e-9), F.exp(out)).otherwise(0.0) if log else out

    spot = F.struct(bracket(es, energy).alias("i"), bracket(os, offset).alias("j"))
    found = F.element_at(F.transform(F.array(spot), inner), 1)
    if outside is None:
        return found
    inside = (energy >= F.get(es, F.lit(0))) & (energy <= F.element_at(es, -1)) & (offset >= F.get(os, F.lit(0))) & (offset <= F.element_at(os, -1))
    return F.when(inside, found).otherwise(outside)


def loglog_integral(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The integral of a power law through two points; zero if either value is."""
    slope = F.log(y1 / y0) / F.log(x1 / x0) + 1
    steep = F.abs(slope) > 1e-10
    whole = F.when(steep, x0 * y0 / F.when(steep, slope) * (F.pow(x1 / x0, slope) - 1)).otherwise(x0 * y0 * F.log(x1 / x0))
    return F.when((y0 > 0) & (y1 > 0), whole).otherwise(0.0)


def with_responses(runs: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Runs with the arrays of their response; runs without one go. Many runs may share a response: the join is on its name, which adaptive execution splits."""
    return runs.join(tables, key)


def at_energies(table: Column, energies: list[float], offset: Column, log: bool = False) -> Column:
    """An array of the response's values at several energies."""
    return F.transform(F.array(*map(F.lit, energies)), lambda e: value(table, e, offset, log))


def per_bin(table: Column, edges: list[float], offset: Column, log: bool = True) -> Column:
    """An array of the response's integral over each energy bin between ``edges``, by power laws through the values at the edges."""
    x = F.array(*map(F.lit, edges))

    def bins(y: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 2)), lambda i: loglog_integral(F.get(x, i), F.get(y, i), F.get(x, i + 1), F.get(y, i + 1)))

    return F.element_at(F.transform(F.array(at_energies(table, edges, offset, log)), bins), 1)


def exposure(met: DataFrame, keys: list[str], centers: list[float], area: str = "aeff") -> DataFrame:
    """(keys, e, exposure, livetime) from pairs of pixels and runs (keys, separation, livetime, area table).

    ``exposure`` sums area times live time over the runs, ``livetime`` the live time that would give it on the axis.
    """
    both = F.arrays_zip(at_energies(F.col(area), centers, F.col("separation")).alias("a"), at_energies(F.col(area), centers, F.lit(0.0)).alias("axis"))
    spread = met.select(*keys, "livetime", F.posexplode(both).alias("e", "p"))
    share = F.when(F.col("p.axis") > 0, F.col("p.a") / F.col("p.axis")).otherwise(0.0)
    return spread.groupBy(*keys, "e").agg(F.sum(F.col("p.a") * F.col("livetime")).alias("exposure"), F.sum(share * F.col("livetime")).alias("livetime"))


def background(met: DataFrame, keys: list[str], edges: list[float], rate: str = "bkg") -> DataFrame:
    """(keys, e, rate): counts per solid angle in each energy bin, summed over runs (keys, separation, ontime, rate table)."""
    spread = met.select(*keys, "ontime", F.posexplode(per_bin(F.col(rate), edges, F.col("separation"))).alias("e", "r"))
    return spread.groupBy(*keys, "e").agg(F.sum(F.col("r") * F.col("ontime")).alias("rate"))


# --- The same in SQL, for responses whose axes have ``n`` energies (en) and ``m`` offsets (off) in lists.


def placed_sql(rows: str, energy: str, offset: str, n: int = 8, m: int = 8) -> str:
    at = lambda nodes, x, k: f"least(greatest(len(list_filter({nodes}, lambda x: x <= {x})), 1), {k - 1})"
    return f"(select *, {at('en', energy, n)} as ii, {at('off', offset, m)} as jj from {rows})"


def value_sql(v: str, energy: str, offset: str, log: bool = False, n: int = 8, m: int = 8) -> str:
    a, b = f"(ln({energy} / en[ii]) / ln(en[ii + 1] / en[ii]))", f"(({offset} - off[jj]) / (off[jj + 1] - off[jj]))"
    c = lambda di, dj: (f"ln(greatest({v}[(ii - 1 + {di}) * {m} + jj + {dj}], {TINY}::double))" if log else f"{v}[(ii - 1 + {di}) * {m} + jj + {dj}]")
    out = f"((1 - {a}) * ((1 - {b}) * {c(0, 0)} + {b} * {c(0, 1)}) + {a} * ((1 - {b}) * {c(1, 0)} + {b} * {c(1, 1)}))"
    return f"(case when {energy} between en[1] and en[{n}] and {offset} between off[1] and off[{m}] then {f'exp({out})' if log else out} else 0 end)"


def integral_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    slope = f"(ln({y1} / {y0}) / ln({x1} / {x0}) + 1)"
    return f"(case when {y0} > 0 and {y1} > 0 then {x0} * {y0} / {slope} * (power({x1} / {x0}, {slope}) - 1) else 0 end)"


def decades(low: float, per_decade: int, n: int) -> list[float]:
    """Edges of ``n`` bins from ``low`` on."""
    return [low * math.pow(10, i / per_decade) for i in range(n + 1)]
