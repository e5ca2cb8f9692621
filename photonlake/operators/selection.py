"""Selections of events, observations and catalog rows. Intervals are half open unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions import sky


def select_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """low <= column < high."""
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


def select_time(df: DataFrame, column: str, low, high, inverted: bool = False) -> DataFrame:
    inside = (F.col(column) >= low) & (F.col(column) < high)
    return df.filter(~inside if inverted else inside)


def select_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is one of a set; NaN in the set matches NaN."""
    values = list(values)
    plain = [v for v in values if v == v]
    match = F.col(column).isin(plain) if plain else F.lit(False)
    return df.filter(match | F.isnan(column)) if len(plain) < len(values) else df.filter(match)


def select_box(df: DataFrame, column: str, low, high, inverted: bool = False) -> DataFrame:
    """Observation parameter box: half open, but equality where both bounds are the same."""
    inside = F.col(column) == low if low == high else (F.col(column) >= low) & (F.col(column) < high)
    return df.filter(~inside if inverted else inside)


def select_span(df: DataFrame, low, high, partial_overlap: bool = False, inverted: bool = False, start: str = "t0", stop: str = "t1") -> DataFrame:
    """Runs inside a time box, or overlapping it; both ends count."""
    if partial_overlap:
        inside = (F.col(stop) >= low) & (F.col(start) <= high)
    else:
        inside = (F.col(start) >= low) & (F.col(stop) <= high)
    return df.filter(~inside if inverted else inside)


def select_cone(df: DataFrame, lon: str, lat: str, lon0: float, lat0: float, radius: float, border: float = 0.0, inverted: bool = False) -> DataFrame:
    """Rows strictly inside a circle on the sphere, widened by a border."""
    inside = sky.separation(lon, lat, lon0, lat0) < radius + border
    return df.filter(~inside if inverted else inside)


def select_region(df: DataFrame, regions: Iterable[Column]) -> DataFrame:
    """Rows in the union of planar regions; each row once."""
    return df.filter(reduce(Column.__or__, regions))


def select_mask(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose bin has a positive value."""
    return df.join(mask.filter("value > 0").select(*keys), keys, "left_semi")


def select_ids(df: DataFrame, ids: DataFrame, key: str = "obs_id") -> DataFrame:
    """Rows of the wanted ids; an id that no row has is an error when the action runs."""
    missing = ids.join(df.select(key).distinct(), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no such {key}: {[r[0] for r in missing]}")
    return df.join(ids.select(key), key, "left_semi")


def select_rows(df: DataFrame, order: str, positions: Iterable[int]) -> DataFrame:
    """Rows at positions (from 0) in an order given by an id without gaps."""
    return df.filter(F.col(order).isin(list(positions)))


def phase_windows(windows: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Phase intervals brought into 0 to 1, split where they cross 1 or 0."""
    out = []
    for low, high in windows:
        if low < 0:
            out += [(low + 1, 1.0), (0.0, high)]
        elif high > 1:
            out += [(low, 1.0), (0.0, high - 1)]
        elif low > high:
            out += [(low, 1.0), (0.0, high)]
        else:
            out.append((low, high))
    return out


def select_phase(df: DataFrame, column: str, windows: Iterable[tuple[float, float]]) -> DataFrame:
    return df.filter(reduce(Column.__or__, [(F.col(column) >= a) & (F.col(column) < b) for a, b in phase_windows(windows)]))


def live_fraction(windows: Iterable[tuple[float, float]]) -> float:
    return sum(b - a for a, b in phase_windows(windows))


def aliases(catalog: DataFrame, separator: str = ",") -> DataFrame:
    """(source_id, alias): names and trimmed aliases, one row each."""
    names = F.concat(F.array("name"), F.transform(F.split("aliases", separator), lambda x: F.trim(x)))
    return catalog.select("source_id", F.explode(names).alias("alias"))


def with_pointing(events: DataFrame, obs: DataFrame, *columns: str) -> DataFrame:
    """Events with columns of their observation."""
    return events.join(obs.select("obs_id", *columns), "obs_id")


def in_radius_table(events: DataFrame, table: DataFrame, energy: str, offset: str) -> DataFrame:
    """Events within a radius that depends on the bin of their energy; the bound itself counts.

    ``table`` (lo, hi, rad_max) has one row per energy bin, so it is broadcast; its size is that of an axis.
    """
    met = events.join(F.broadcast(table), (F.col(energy) >= F.col("lo")) & (F.col(energy) < F.col("hi")))
    return met.filter(F.col(offset) <= F.col("rad_max")).drop("lo", "hi")
