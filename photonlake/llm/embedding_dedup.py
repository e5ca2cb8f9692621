"""Near-duplicate vectors of equal label, found by range searches on a flat graph.

1. Equal vectors of a label are one class. Every class goes to the nearest few of its label's clusters, whose centroids are
   fitted on a bounded sample; a cluster of too many classes is cut into parts by a hash, and every two of its parts meet.
2. Each part builds a graph: candidates of a class are its nearest ones there and a few drawn at random, thinned by the
   robust rule (a candidate goes if a nearer one kept is ``alpha`` times as near to it), with edges back, and joined so
   that every node can be reached from the medoid. The adjacency lists of a class from all its parts are united.
3. In each part every class walks the united graph from the medoid, greedily, and then on through everything within reach of the
   threshold. Pairs found are confirmed by exact cosines and counted in the first cluster that both belong to. A task returns
   a row per class: its number of links and one class that it is connected to.
4. A sample of classes is compared with all rows; if the links found fall short, the search is repeated with more clusters a
   class and wider walks, and at last with all parts of a label against each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.ann import CentroidGraph, fit_centroids, unit
from photonlake.llm.components import components
from photonlake.llm.storage import Scratch, bounded_batches

_SHARD = ["label", "dim", "cluster"]


def stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def pruned(sims: np.ndarray, candidates: np.ndarray, between: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """The robust rule for many nodes at once: (n, degree) of kept candidates in order of nearness, -1 pads.

    ``sims`` are the candidates' cosines with their node, sorted downwards, ``between`` those among the candidates.
    """
    n, c = candidates.shape
    far, apart = np.sqrt(np.maximum(0, 2 - 2 * sims)), np.sqrt(np.maximum(0, 2 - 2 * between))
    alive, kept = candidates >= 0, np.zeros((n, c), bool)
    for k in range(c):
        use = alive[:, k] & (kept.sum(axis=1) < degree)
        kept[:, k] = use
        alive &= ~(use[:, None] & (alpha * apart[:, k] <= far))
    order = np.argsort(~kept, axis=1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(kept, order, axis=1), np.take_along_axis(candidates, order, axis=1), -1)


def build_graph(x: np.ndarray, degree: int, alpha: float = 1.2, drawn: int = 16) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors; every row can be reached from the medoid."""
    n = len(x)
    rng = np.random.default_rng(11)
    near = min(n - 1, 2 * degree)
    kept = np.full((n, degree), -1, np.int64)
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -9
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.zeros((len(rows), 0), np.int64)
        more = rng.integers(0, n, (len(rows), drawn))
        found = np.hstack([top, np.where(more == rows[:, None], -1, more)])
        own = np.where(found >= 0, np.take_along_axis(sims, np.maximum(found, 0), axis=1), -9)
        order = np.argsort(-own, axis=1, kind="stable")
        found, own = np.take_along_axis(found, order, axis=1), np.take_along_axis(own, order, axis=1)
        v = x[np.maximum(found, 0)]
        kept[rows] = pruned(own, found, np.einsum("nid,njd->nij", v, v), alpha, degree)
    a, b = np.repeat(np.arange(n), degree)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
    edges = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    lists = np.split(edges[:, 1], np.searchsorted(edges[:, 0], np.arange(1, n))) if n else []
    for at, to in _bridges(x, lists):
        lists[at] = np.append(lists[at], to)
        lists[to] = np.append(lists[to], at)
    return lists


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _bridges(x: np.ndarray, lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """An edge from a reached node to the nearest one that the medoid does not reach, for each such part of the graph."""
    out: list[tuple[int, int]] = []
    reached = np.zeros(len(x), bool)
    todo = [medoid(x)] if len(x) else []
    while True:
        while todo:
            node = todo.pop()
            if not reached[node]:
                reached[node] = True
                todo += [i for i in lists[node].tolist() if not reached[i]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return out
        known = np.flatnonzero(reached)
        sims = x[known] @ x[lost[0]]
        out.append((int(known[sims.argmax()]), int(lost[0])))
        todo = [int(lost[0])]


def range_search(queries: np.ndarray, x: np.ndarray, near: np.ndarray, start: int, reach: float, width: int, step: int = 8) -> np.ndarray:
    """Which rows of ``x`` each query finds within ``reach`` (a cosine), by a greedy walk that goes on through all rows in reach.

    A walk opens the ``step`` nearest rows not opened among its ``width`` nearest, and every row in reach.
    """
    q, n = len(queries), len(x)
    sims = np.full((q, n), -9.0, np.float32)
    opened = np.zeros((q, n), bool)
    sims[:, start] = queries @ x[start]
    while True:
        shut = np.where(opened, np.float32(-9), sims)
        edge = np.partition(sims, n - width, axis=1)[:, n - width] if width < n else np.full(q, -8.0, np.float32)
        best = np.partition(shut, n - step, axis=1)[:, n - step] if step < n else np.full(q, -8.0, np.float32)
        open_ = (shut > -8) & ((shut >= reach) | ((shut >= edge[:, None]) & (shut >= best[:, None])))
        row, node = np.nonzero(open_)
        if not len(row):
            return sims >= reach
        opened[row, node] = True
        fresh = np.zeros((q, n), bool)
        for lo in range(0, len(row), 1 << 15):
            to = near[node[lo : lo + (1 << 15)]]
            use = to >= 0
            fresh[np.repeat(row[lo : lo + (1 << 15)], use.sum(axis=1)), to[use]] = True
        fresh &= sims < -8
        i, j = np.nonzero(fresh)
        for lo in range(0, len(i), 1 << 16):
            sims[i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]] = np.einsum("nd,nd->n", queries[i[lo : lo + (1 << 16)]], x[j[lo : lo + (1 << 16)]])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class GraphNearDuplicates:
    """Vectors of equal label with a cosine of ``threshold`` or more.

    ``run`` returns a row per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable),
    kept. Rows whose id, label or vector is null, whose vector is empty, zero or holds a null or non-finite component, link with
    nothing; vectors of different lengths have no cosine. Every row counts as a vector; rows that repeat a vec_id
    belong to one component. ``sample`` bounds the rows that centroids are fitted on, ``most_shards`` the centroids; a cluster of four times ``shard_rows`` is cut. The share
    of a sample's links that was found is kept in ``recall``.
    """

    def __init__(self, spark: SparkSession, threshold: float = 0.93, shard_rows: int = 512, replicas: int = 3, degree: int = 16, width: int = 32, sample: int = 65536, most_shards: int = 16384, audit: int = 512, target: float = 0.97):
        self.spark, self.threshold, self.shard_rows, self.replicas, self.degree, self.width = spark, threshold, shard_rows, replicas, degree, width
        self.sample, self.most_shards, self.audit, self.target = sample, most_shards, audit, target
        self.recall: float | None = None
        self.scratch = Scratch(spark, "graph-near-dup")
        bounded_batches(spark)

    def run(self, df: DataFrame) -> DataFrame:
        vector = F.transform(F.col("embedding"), lambda x: x + F.lit(0).cast("float"))  # one zero
        usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", vector.alias("vector"))
        rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
        grouped = rows.filter("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        classes = self.scratch.table(grouped.withColumn("dim", F.size("vector")).withColumn("cid", F.monotonically_increasing_id()), "classes")
        total = classes.count()
        found = None
        for attempt, (replicas, width) in enumerate(((self.replicas, self.width), (2 * self.replicas, 2 * self.width), (1, 4 * self.width))):
            found = self.scratch.table(self._found(classes, total, replicas, width, attempt == 2, attempt), f"found-{attempt}")
            self.recall = self._recall(classes, found)
            if self.recall >= self.target:
                break
        placed = rows.filter("usable").join(classes.select("label", "vector", "cid"), ["label", "vector"]).select("vec_id", "cid")
        placed = self.scratch.table(placed, "placed")
        several = placed.distinct().groupBy("vec_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.collect_set("cid").alias("all")).filter("a <> b")
        links = found.filter("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b")).union(several.select("a", F.explode("all").alias("b")))
        joined = components(links, self.scratch, "all")
        own = classes.select("cid", "rep", "copies").join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid").join(joined, F.col("cid") == F.col("node"), "left")
        own = self.scratch.table(own.select("cid", "rep", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "own")
        least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
        told = self.scratch.table(placed.join(own.join(least, "component").select("cid", "n_links", "component_id"), "cid").select("vec_id", "n_links", "component_id"), "told")
        others = rows.filter("not usable").select("vec_id")
        ids = told.join(others.distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("known"))
        rest = others.join(ids, "vec_id", "left").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("known", "vec_id").alias("component_id"))
        return told.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

    def _centroids(self, classes: DataFrame, total: int, rows: int, replicas: int) -> dict[tuple[object, int], CentroidGraph]:
        """Centroids of the labels of more than ``rows`` classes, of which there are at most ``most_shards``: as many as give clusters of ``rows`` with all replicas."""
        big = {(r["label"], r["dim"]): r["count"] for r in classes.groupBy("label", "dim").count().filter(F.col("count") > rows).collect()}
        if not big:
            return {}
        share = min(1.0, self.sample / total)
        drawn = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("label", "dim", "vector", "cid").limit(2 * self.sample).toArrow()
        out = {}
        groups = list(zip(drawn.column("label").to_pylist(), drawn.column("dim").to_pylist(), strict=True))
        order = np.argsort(drawn.column("cid").to_numpy(), kind="stable")
        for key, n in big.items():
            at = [i for i in order.tolist() if groups[i] == key]
            if len(at) > 1:
                x = unit(stack(drawn.column("vector").take(pa.array(at)))).astype(np.float32)
                out[key] = CentroidGraph.build(fit_centroids(x, min(len(at), math.ceil(n * replicas / rows))))
        return out

    def _found(self, classes: DataFrame, total: int, replicas: int, width: int, whole: bool, attempt: int) -> DataFrame:
        """(cid, n, root): a row per class and task: links counted there, and the first class it is connected to."""
        rows = max(self.shard_rows, math.ceil(total * replicas / self.most_shards))
        graphs = self.spark.sparkContext.broadcast({} if whole else self._centroids(classes, total, rows, replicas))
        kind = dict(classes.dtypes)

        def place(batches):
            for batch in batches:
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                lists: list[list[int]] = [[0]] * len(keys)
                for key in set(keys) & graphs.value.keys():
                    at = np.array([i for i, k in enumerate(keys) if k == key])
                    graph = graphs.value[key]
                    for lo in range(0, len(at), 256):
                        x = unit(stack(batch.column(4).take(pa.array(at[lo : lo + 256])))).astype(np.float32)
                        if len(graph.centroids) <= 1024:
                            ids = np.argsort(-(x @ graph.centroids.T), axis=1, kind="stable")[:, :replicas]
                        else:
                            ids = graph.walk(x, 4 * replicas)[0][:, :replicas]
                        for i, own in zip(at[lo : lo + 256].tolist(), ids.tolist(), strict=True):
                            lists[i] = sorted(c for c in own if c >= 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["label", "dim", "cid", "copies", "vector", "clusters"])

        base = f"label {kind['label']}, dim int, cid bigint, copies bigint, vector {kind['vector']}"
        placed = classes.select("label", "dim", "cid", "copies", "vector").mapInArrow(place, f"{base}, clusters array<int>")
        members = placed.withColumn("cluster", F.explode("clusters"))
        if whole:
            parts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / (2 * self.shard_rows)).cast("int").alias("parts"))
            members = members.join(parts, ["label", "dim"])
        else:
            members = self.scratch.table(members, f"members-{attempt}")
            # Only clusters of labels with centroids hold more than ``rows`` classes: fewer than twice ``most_shards`` rows.
            large = members.groupBy(*_SHARD).count().filter(F.col("count") > 4 * self.shard_rows).select(*_SHARD, F.ceil(F.col("count") / (2 * self.shard_rows)).cast("int").alias("parts"))
            members = members.join(F.broadcast(large), _SHARD, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        members = members.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        members = self.scratch.table(members, f"parts-{attempt}")
        degree = self.degree

        def build(table):
            ids = table.column("cid").to_numpy()
            lists = build_graph(unit(stack(table.column("vector"))).astype(np.float32), degree)
            return pa.table({"cid": ids, "near": pa.array([ids[i] for i in lists], pa.list_(pa.int64()))})

        lists = members.select(*_SHARD, "part", "cid", "vector").groupBy(*_SHARD, "part").applyInArrow(build, "cid bigint, near array<bigint>")
        united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        meeting = members.join(united, "cid").select(*_SHARD, "part", "cid", "copies", "vector", "clusters", "near", other)
        meeting = meeting.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        threshold = self.threshold

        def search(key, table):
            return _search_part(table, key[2].as_py(), threshold, width)

        return meeting.groupBy(*_SHARD, "low", "high").applyInArrow(search, "cid bigint, n bigint, root bigint")

    def _recall(self, classes: DataFrame, found: DataFrame) -> float:
        """The share of the links of ``audit`` classes that was found, against all classes in blocks."""
        drawn = classes.orderBy(F.xxhash64("cid", F.lit(17)), "cid").limit(self.audit).select("label", "dim", "cid", "vector").toArrow()
        if not drawn.num_rows:
            return 1.0
        ids = drawn.column("cid").to_pylist()
        by: dict[tuple[object, int], list[int]] = {}
        for i, key in enumerate(zip(drawn.column("label").to_pylist(), drawn.column("dim").to_pylist(), strict=True)):
            by.setdefault(key, []).append(i)
        asked = {key: (np.array([ids[i] for i in at]), unit(stack(drawn.column("vector").take(pa.array(at))))) for key, at in by.items()}
        held, threshold = self.spark.sparkContext.broadcast(asked), self.threshold

        def compare(batches):
            for batch in batches:
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for key in set(keys) & held.value.keys():
                    at = np.array([i for i, k in enumerate(keys) if k == key])
                    own, q = held.value[key]
                    x = unit(stack(batch.column(4).take(pa.array(at))))
                    met = (q @ x.T >= threshold) & (own[:, None] != batch.column(2).to_numpy()[at])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(met @ batch.column(3).to_numpy()[at])], names=["cid", "n"])

        true = classes.select("label", "dim", "cid", "copies", "vector").mapInArrow(compare, "cid bigint, n bigint").groupBy("cid").agg(F.sum("n").alias("true"))
        got = found.join(F.broadcast(true.select("cid")), "cid", "left_semi").groupBy("cid").agg(F.sum("n").alias("got"))
        wanted, had = true.join(got, "cid", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("got", F.lit(0))))).first()
        return had / wanted if wanted else 1.0


def _search_part(table: pa.Table, cluster: int, threshold: float, width: int) -> pa.Table:
    """Links inside a part of a cluster, or between two of its parts: (cid, n, root)."""
    part, ids = table.column("part").to_numpy(), table.column("cid").to_numpy()
    exact = stack(table.column("vector"))
    rough = unit(exact).astype(np.float32)
    near = table.column("near").combine_chunks()
    size, flat = np.diff(near.offsets.to_numpy()), near.flatten().to_numpy()
    sides = [np.flatnonzero(part == p) for p in np.unique(part)]
    pairs = [(sides[0], sides[0])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]
    found = np.zeros((len(ids), len(ids)), bool)
    row_of = np.repeat(np.arange(len(ids)), size)
    for asking, nodes in pairs:
        order = nodes[np.argsort(ids[nodes])]
        spot = np.minimum(np.searchsorted(ids[order], flat), len(order) - 1)
        use = (ids[order][spot] == flat) & np.isin(row_of, nodes)
        inside = np.full(len(ids), -1)
        inside[order] = np.arange(len(order))
        a, b = inside[row_of[use]], spot[use]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        lists = np.full((len(order), max(1, np.bincount(a, minlength=1).max())), -1, np.int64)
        lists[a, np.arange(len(a)) - np.searchsorted(a, a)] = b
        x = rough[order]
        start = medoid(x)
        for lo in range(0, len(asking), 128):
            rows = asking[lo : lo + 128]
            i, j = np.nonzero(range_search(rough[rows], x, lists, start, threshold - 1e-4, width))
            for at in range(0, len(i), 1 << 14):
                p, q = rows[i[at : at + (1 << 14)]], order[j[at : at + (1 << 14)]]
                linked = (cosines(exact[p], exact[q]) >= threshold) & (p != q)
                found[p[linked], q[linked]] = True
    found |= found.T
    clusters = table.column("clusters").to_pylist()
    wide = max(map(len, clusters))
    own = np.array([c + [-1 - i] * (wide - len(c)) for i, c in enumerate(clusters)])
    i, j = np.nonzero(found)
    first = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 15):
        x, y = own[i[lo : lo + (1 << 15)]], own[j[lo : lo + (1 << 15)]]
        both = np.where((x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0), x, np.iinfo(np.int64).max).min(axis=1)
        first[lo : lo + (1 << 15)] = both == cluster
    copies = table.column("copies").to_numpy()
    n = np.bincount(i[first], weights=copies[j[first]], minlength=len(ids)).astype(np.int64) if len(i) else np.zeros(len(ids), np.int64)
    root = ids.copy()
    while len(i):
        lower = root.copy()
        np.minimum.at(lower, i, root[j])
        if (lower == root).all():
            break
        root = lower
    return pa.table({"cid": ids, "n": n, "root": root})


SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select x, y from link union select r.x, l.y from reach r join link l on l.x = r.y
)
select e.vec_id, coalesce(n, 0)::bigint as n_links, least(e.vec_id, coalesce(least, e.vec_id)) as component_id, least(e.vec_id, coalesce(least, e.vec_id)) = e.vec_id as kept
from embeddings e left join (select x, count(*) as n from link group by x) c on c.x = e.vec_id left join (select x, min(y) as least from reach group by x) r on r.x = e.vec_id
"""
