"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on long lists; every row is indexed. A vector goes
to the list of its nearest centroid and, if it lies near a boundary, to those of further centroids as well.
Centroids are found by a best-first walk on a graph of their neighbours, held in memory by each task. A query
visits the lists at most ``reach`` times as far as the nearest ones that together hold more than ``floor`` rows; its
walk widens until it has found a centroid further than that, and ends as a comparison with all of them. List members
are scored by their exact cosine. Long lists are split into blocks, so that no task gets a whole list.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import vectors as V
from photonlake.llm.storage import Scratch, bounded_batches


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8, penalty: float = 0.05) -> np.ndarray:
    """Spherical k-means whose assignment prefers lists that are shorter than average."""
    rng = np.random.default_rng(7)
    at = rng.permutation(len(sample))[:n]
    centroids, load = sample[at].copy(), np.zeros(len(at))
    for _ in range(rounds):
        own = np.concatenate([(part @ centroids.T - penalty * np.minimum(load, 4)).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        count = np.bincount(own, minlength=len(centroids))
        load = count * (len(centroids) / len(sample)) - 1
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centroids)
    return centroids


@dataclass
class CentroidGraph:
    """Centroids, their nearest neighbours both ways, and entry points far from each other."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, degree: int = 24, entries: int = 16) -> CentroidGraph:
        n = len(centroids)
        degree = min(degree, max(1, n - 1))
        near = np.empty((n, degree), np.int64)
        for lo in range(0, n, 1024):
            sims = centroids[lo : lo + 1024] @ centroids.T
            sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -9
            near[lo : lo + 1024] = np.argsort(-sims, axis=1)[:, :degree] if n > 1 else 0
        back: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i, : degree // 2].tolist():
                back[j].append(i)
        extra = np.array([(b + [i] * degree)[:degree] for i, b in enumerate(back)], np.int64)
        chosen = [0]
        nearest = centroids @ centroids[0]
        while len(chosen) < min(entries, n):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, centroids @ centroids[chosen[-1]])
        return CentroidGraph(centroids, np.hstack([near, extra]), np.array(chosen))

    def walk(self, queries: np.ndarray, width: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, similarity) of the ``width`` best that a best-first walk finds, best first; -1 pads."""
        n, q = len(self.centroids), len(queries)
        width = min(width, n)
        seen = np.zeros((q, n), bool)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -9.0, queries.dtype)
        open_ = np.zeros((q, width), bool)
        fresh = np.repeat(self.entries[None, :], q, axis=0)
        row = np.arange(q)[:, None]
        while True:
            fresh = np.sort(fresh, axis=1)
            again = np.zeros(fresh.shape, bool)
            again[:, 1:] = fresh[:, 1:] == fresh[:, :-1]
            again |= (fresh < 0) | seen[row, fresh]
            seen[row, np.where(fresh < 0, fresh.max(), fresh)] |= fresh >= 0
            got = np.where(again, -9.0, np.einsum("qd,qnd->qn", queries, self.centroids[fresh])).astype(queries.dtype)
            all_ids, all_sims = np.hstack([ids, fresh]), np.hstack([sims, got])
            all_open = np.hstack([open_, ~again])
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids, sims, open_ = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_sims, all_open))
            ids[sims < -2] = -1
            open_ &= sims > -2
            if not open_.any():
                return ids, sims
            first = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            use = np.take_along_axis(open_, first, axis=1)
            from_ = np.where(use, np.take_along_axis(ids, first, axis=1), -1)
            np.put_along_axis(open_, first, False, axis=1)
            fresh = np.where((from_ >= 0)[:, :, None], self.neighbours[from_], -1).reshape(q, -1)


def lists_within(graph: CentroidGraph, queries: np.ndarray, width: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the ``most`` nearest lists whose centroid is at most ``ratio`` times as far as the nearest one found."""
    ids, sims = graph.walk(queries, width)
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    keep = (ids >= 0) & (far <= ratio * far[:, :1] + 1e-6)
    keep[:, most:] = False
    at = np.nonzero(keep)
    return at[0], ids[at]


def lists_in_reach(graph: CentroidGraph, queries: np.ndarray, ratio: float, sizes: np.ndarray, needed: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs in the order of rows: the lists at most ``ratio`` times as far as the nearest that hold ``needed`` rows together.

    ``sizes`` counts each row in one list only. If all lists hold fewer, all are taken.
    """
    n, left, rows, lists = len(graph.centroids), np.arange(len(queries)), [], []
    while len(left):
        if 4 * width >= n:
            sims = queries[left] @ graph.centroids.T
            ids = np.argsort(-sims, axis=1, kind="stable")
            sims, width = np.take_along_axis(sims, ids, axis=1), n
        else:
            ids, sims = graph.walk(queries[left], width)
        far = np.sqrt(np.maximum(0, 2 - 2 * sims))
        enough = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1) >= needed
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), ids.shape[1] - 1)[:, None]
        limit = ratio * np.take_along_axis(far, last, axis=1) + 1e-6
        done = (enough.any(axis=1) & (far[:, -1] > limit[:, 0])) | (width >= n)
        keep = ((far <= limit) | (np.arange(ids.shape[1]) <= last)) & (ids >= 0) & done[:, None]
        at = np.nonzero(keep)
        rows.append(left[at[0]])
        lists.append(ids[at])
        left, width = left[~done], 4 * width
    row, list_ = np.concatenate(rows), np.concatenate(lists)
    order = np.argsort(row, kind="stable")
    return row[order], list_[order]


class PostingSearch:
    """The ``k`` nearest by cosine found for every vec_id divisible by ``every``, among all other rows.

    ``sample`` bounds the rows that centroids are fitted on and ``most_lists`` the centroids (so what each
    task holds of them: beyond 2.7e8 rows lists grow instead); lists otherwise number ``lists`` or the square root
    of the rows. The lists that
    ``reach`` is counted from hold ``floor`` rows at least besides the query, and no fewer than ``k``. Zero vectors and rows that
    ``vectors.valid`` leaves out take no part; no valid row gives an empty result.
    """

    def __init__(self, spark: SparkSession, k: int = 5, every: int = 50, reach: float = 1.35, boundary: float = 1.06, replicas: int = 4, sample: int = 32768, most_lists: int = 16384, block: int = 2048, query_block: int = 256, lists: int | None = None, floor: int = 32):
        self.spark, self.k, self.every, self.reach, self.boundary, self.replicas = spark, k, every, reach, boundary, replicas
        self.sample, self.most_lists, self.block, self.query_block, self.lists, self.floor = sample, most_lists, block, query_block, lists, floor
        self.scratch = Scratch(spark, "posting-search")

    def run(self, df: DataFrame) -> DataFrame:
        bounded_batches(self.spark, 1000)
        nonzero = F.exists("vector", lambda x: x != 0)
        rows = self.scratch.table(V.valid(df).filter(nonzero), "rows")
        n = rows.count()
        if not n:
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        chosen = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample)
        got = rows.join(F.broadcast(chosen), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").toArrow().column("vector").combine_chunks()
        sample = got.flatten().to_numpy().reshape(len(got), -1)
        n_lists = min(self.most_lists, self.lists or max(1, math.ceil(math.sqrt(n))))
        graph = self.spark.sparkContext.broadcast(CentroidGraph.build(fit_centroids(unit(sample).astype(np.float32), n_lists)))
        boundary, replicas, reach = self.boundary, self.replicas, self.reach
        placed = self._lists(rows, lambda x: lists_within(graph.value, x, 4 * replicas, boundary, replicas))
        placed = self.scratch.table(placed, "postings")
        sizes, needed = np.zeros(len(graph.value.centroids), np.int64), max(self.k, self.floor) + 1
        for r in placed.filter("first").groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]
        postings = V.blocks(placed.drop("first"), self.block, "list")
        asked = self._lists(rows.filter(F.col("vec_id") % self.every == 0), lambda x: lists_in_reach(graph.value, x, reach, sizes, needed)).drop("first")
        asked = V.blocks(self.scratch.table(asked, "asked"), self.query_block, "list").select("list", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        found = self._score(asked.join(postings, "list").select("q_ids", "q_vectors", "ids", "vectors"))
        return V.best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), self.k)

    @staticmethod
    def _lists(rows: DataFrame, choose: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = unit(V.matrix(batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.num_rows)).astype(np.float32)
                for lo in range(0, len(x), 256):
                    row, list_ = choose(x[lo : lo + 256])
                    first = np.diff(row, prepend=-1) != 0
                    yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), pa.array(first), *(c.take(pa.array(lo + row)) for c in batch.columns)], names=["list", "first", "vec_id", "vector"])

        return rows.select("vec_id", "vector").mapInArrow(run, "list int, first boolean, vec_id bigint, vector array<double>")

    def _score(self, pairs: DataFrame) -> DataFrame:
        k = self.k

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    q_ids, x_ids = (batch.column(c)[r].values.to_numpy() for c in (0, 2))
                    q, x = V.matrix(batch.column(1)[r], len(q_ids)), V.matrix(batch.column(3)[r], len(x_ids))
                    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
                    rough = (q @ x.T) / q_norm[:, None] / x_norm
                    rough[q_ids[:, None] == x_ids] = -9
                    edge = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
                    i, j = np.nonzero((rough >= edge[:, None] - 1e-9) & (rough > -2))
                    exact = (q[i] * x[j]).sum(axis=1) / (q_norm[i] * x_norm[j])
                    order = np.lexsort((x_ids[j], -exact, i))
                    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                    top = order[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[top]]), pa.array(x_ids[j[top]]), pa.array(exact[top])], names=["query_id", "vec_id", "score"])

        return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
