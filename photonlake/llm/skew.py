"""Joins whose keys may be very uneven, or that keep few of many wide rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark's bitmap functions have them.
BITS = 1 << 15


def with_groups(rows: DataFrame, groups: DataFrame, key: str, members: str, total: int, spread: list[str]) -> DataFrame:
    """``rows`` with a struct ``group`` of the columns of their group, null where they have none.

    ``groups`` is a written table with a row per key and the number of its rows in ``members``. Groups of more than a
    ten-thousandth of all ``total`` rows are at most 10,000. They are broadcast, and their rows (and those without a
    key) are shuffled by the columns ``spread``, so that no task gets all rows of one of them.
    """
    own = F.struct(*[F.col(c) for c in groups.columns if c != key])
    often = groups.filter(F.col(members) * 10_000 > total).select(F.col(key).alias("_often_key"), own.alias("_often"))
    other = groups.filter(F.col(members) * 10_000 <= total).select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("_zero"), own.alias("_other"))
    told = rows.join(F.broadcast(often), F.col(key) == F.col("_often_key"), "left")
    alone = F.col("_often").isNotNull() | F.col(key).isNull()
    told = told.withColumn("_salt", F.when(alone, F.xxhash64(*spread).bitwiseOR(F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
    met = told.join(other, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("_often", "_other").alias("group"))


def among(rows: DataFrame, ids: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """``rows`` whose ``key`` (a long) is in ``ids``, a written table of that one column without repeats.

    A filter of 32 bits an id, at most ``most`` bitmaps of 4 KB, is broadcast first. What it lets through (with it full, all)
    is joined, so that wide rows that are not wanted are not shuffled.
    """
    parts = 1 << math.ceil(math.log2(min(most, max(1, math.ceil(ids.count() * 32 / BITS)))))
    spot = F.pmod(F.xxhash64(key), F.lit(parts * BITS))
    part, bit = F.shiftright(spot, 15), spot.bitwiseAND(F.lit(BITS - 1).cast("bigint"))
    maps = ids.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    told = rows.withColumn("_part", part).withColumn("_bit", bit).join(F.broadcast(maps), "_part")
    byte = F.expr("cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as bigint)")
    told = told.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    # Not a semi join: Spark moves those below the join before, so that all rows are shuffled.
    return told.select(*rows.columns).join(ids, key).select(*rows.columns)
