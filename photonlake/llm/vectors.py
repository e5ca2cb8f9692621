"""Vector columns: valid rows, blocks of rows as matrices, and merging of per-block winners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of rows that take part.

    Rows whose id or vector is null, empty or holds a null or non-finite component are left out, and so are
    vectors whose length is not the most frequent one: they have no product with the others. Rows that repeat a
    vec_id count once, with the smallest of their vectors. Vectors are shuffled only for ids that do repeat.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).filter("vec_id is not null").filter(finite & (F.size(vector) > 0))
    usual = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.filter(F.size("vector") == (usual[0]["dim"] if usual else 0))
    repeated = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(repeated, "vec_id", "left_anti").union(once)


def blocks(df: DataFrame, block_rows: int, *keys: str) -> DataFrame:
    """Rows (keys..., block, ids, vectors) of about ``block_rows`` vectors each, however many rows a key has."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    placed = df.join(sizes, list(keys)) if keys else df.crossJoin(F.broadcast(sizes))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
    members = F.sort_array(F.collect_list(F.struct("vec_id", "vector")))
    return placed.groupBy(*keys, "block").agg(members.alias("m")).select(*keys, "block", F.col("m.vec_id").alias("ids"), F.flatten("m.vector").alias("vectors"))


def matrix(flat: pa.Scalar | np.ndarray, n: int) -> np.ndarray:
    values = flat.values.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Scalar) else flat
    return values.reshape(n, -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
