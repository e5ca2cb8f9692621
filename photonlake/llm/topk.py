"""Exact top-k inner products of integer vectors by pivot-table elimination.

An extra component sqrt(M - |x|^2), with M the largest squared norm, makes all candidates equally long, so
that the largest inner product is the smallest Euclidean distance. Distances of all candidates to many
pivots are computed once (the pivot table). For a query, the largest |d(q, p) - d(x, p)| over the pivots is
a lower bound of d(q, x), hence an upper bound of the score; candidates are scored in the order of their
bounds until no bound can reach the k-th score.

Blocks of candidates hold rows of one nearest pivot and lie on shelves of equally many blocks in the order of the
pivots, so that a shelf spans narrow ranges of distances and none is long, however many rows are alike. The
scores of a bounded sample of rows give every query a first threshold; a block of queries goes to a shelf only if
the shelf's ranges allow a score that reaches it, and meets there block by block in an equi-join by shelf and lot
of query blocks.

Scores are exact integers: products are formed in doubles where all partial sums stay below 2^53, else in 64-bit
integers where they stay below 2^63, else in integers of any length. Blocks hold components in the smallest of three
types that fits all of them; a block of queries is written once and joined to the shelves it goes to.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import vectors as V
from photonlake.llm.storage import Scratch, bounded_batches

_LARGEST = 2**63 - 1
_KINDS = {"<i2": "smallint", "<i4": "int", "<f8": "double"}


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held in doubles (rows of x, one column or several of q), as longs; beyond a long's range its nearest end."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    if most < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    large = [np.array([int(c) for c in v.ravel().tolist()], object).reshape(v.shape) for v in (x, q)]
    return np.clip(large[0] @ large[1], -_LARGEST - 1, _LARGEST).astype(np.int64)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


def ceilings(distance_low: np.ndarray, distance_high: np.ndarray, from_query: np.ndarray, square: np.ndarray) -> np.ndarray:
    """(queries,): the most that any candidate within these ranges of distances to the pivots can score."""
    apart = np.maximum(np.maximum(distance_low - from_query, from_query - distance_high), 0.0).max(axis=1)
    return _reach(square, apart)


def _reach(square: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Highest score at a distance of at least ``apart``, with room for the rounding of distances to singles."""
    return (square - apart**2) / 2 + 1 + 1e-6 * square


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, to_pivot: np.ndarray, pivots: np.ndarray, longest: float, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, ids, scores): the best of each query in one block, ordered by query and rank; ``floor`` holds scores that k candidates are known to reach."""
    from_query, square = query_distances(q, pivots, longest)
    # Negated, so that lengths beyond doubles (ceilings that are no numbers) rule nothing out.
    asking = np.flatnonzero(~(ceilings(to_pivot.min(axis=0), to_pivot.max(axis=0), from_query, square) < floor))
    near = from_query[asking].astype(to_pivot.dtype)
    apart = np.zeros((len(asking), len(x)), to_pivot.dtype)
    for p in range(to_pivot.shape[1]):
        gap = np.subtract(near[:, p, None], to_pivot[:, p])
        np.maximum(apart, np.abs(gap, out=gap), out=apart)
    within = np.sqrt(np.maximum(0.0, 2 * (_reach(square, np.zeros(len(q))) - floor)))[asking]
    open_ = ~(apart > within[:, None])
    rows, asking_rows = np.flatnonzero(open_.any(axis=0)), open_.any(axis=1)
    asking, open_ = asking[asking_rows], open_[asking_rows][:, rows]
    got = products(q[asking], x[rows].T)
    at, row = np.nonzero(open_ & (got >= floor[asking, None]) & (x_ids[rows] != q_ids[asking, None]))
    scores, ids, at = got[at, row], x_ids[rows[row]], asking[at]
    order = np.lexsort((ids, ~scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], scores[keep]


def query_distances(q: np.ndarray, pivots: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries to the pivots, and the sum of each one's squared length and the candidates'."""
    return _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots), (q * q).sum(axis=1) + longest


class PivotSearch:
    """Exact top-k by integer inner product, for every vec_id divisible by ``every`` against all other rows.

    Components x become floor(scale * x). ``sample`` bounds the rows that pivots and first thresholds come from;
    every row is in the pivot table and every row is a candidate. Fewer than k candidates give fewer rows; no
    valid row gives none. Rows that ``vectors.valid`` leaves out take no part. A score beyond the range of a long
    is given as that range's nearest end; such scores tie.
    """

    def __init__(self, spark: SparkSession, k: int = 10, every: int = 100, scale: int = 1024, pivots: int = 32, sample: int = 4096, block: int = 2048, query_block: int = 256, lot: int = 64):
        self.spark, self.k, self.every, self.scale = spark, k, every, scale
        self.pivots, self.sample, self.block, self.query_block, self.lot = pivots, sample, block, query_block, lot
        self.scratch = Scratch(spark, "pivot-search")
        bounded_batches(spark, 64)

    def run(self, df: DataFrame) -> DataFrame:
        # floor() of Spark gives longs; a component beyond them is whole already.
        scaled = lambda x: x * self.scale
        whole = F.transform("vector", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
        rows = self.scratch.table(V.valid(df).select("vec_id", whole.alias("vector")), "rows")
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        longest, n, largest = rows.agg(F.max(norm), F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
        if not n:
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        chosen = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample)
        got = rows.join(F.broadcast(chosen), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id"), "vec_id").toArrow()
        ids = got.column("vec_id").to_numpy()
        sample = got.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        pivots = choose_pivots(_lift(sample, longest), self.pivots)
        kind = next(t for t in _KINDS if t == "<f8" or largest <= np.iinfo(t).max)
        far_kind = "<f4" if longest < 1e70 else "<f8"
        shared = self.spark.sparkContext.broadcast((pivots, longest, sample, ids, kind, far_kind))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shelves = max(1, min(-(-n // self.block), parts))
        placed = self.scratch.table(self._placed(rows, shared, kind), "placed")
        before = np.zeros(len(pivots) + 1, np.int64)
        for near, rows_near in placed.groupBy("near").count().collect():
            before[near + 1] = -(-rows_near // self.block)
        before = np.cumsum(before)
        place = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in before.tolist()]), F.col("near") + 1) + F.col("block")
        shelf = F.floor(place * shelves / int(before[-1])).cast("int")
        blocks = V.blocks(placed, self.block, "near").select(shelf.alias("shelf"), "ids", "vectors")
        table = self.scratch.table(self._pivot_table(blocks, shared), "pivot-table")
        ranges = table.groupBy("shelf").agg(F.array(*[F.min(F.col("low")[p]) for p in range(len(pivots))]), F.array(*[F.max(F.col("high")[p]) for p in range(len(pivots))])).collect()
        queries = self.scratch.table(self._queries(V.blocks(rows.filter(F.col("vec_id") % self.every == 0), self.query_block), shared), "queries")
        self.scratch.drop("rows", "placed")
        spread = queries.repartitionById(max(1, min(queries.count(), parts)), F.col("q_block"))
        asked = self.scratch.table(self._sent(spread, shared, [(r[0], np.array(r[1]), np.array(r[2])) for r in ranges]), "asked")
        pairs = self._met(asked.join(queries, "q_block"), table.select("shelf", "ids", "vectors", "to_pivot"), min(parts, 4 * shelves))
        return V.best(self._search(pairs, shared), self.k)

    def _met(self, asked: DataFrame, table: DataFrame, parts: int = 1) -> DataFrame:
        """Blocks of queries with the blocks of the shelves they go to.

        A shelf that many blocks of queries go to is dealt into lots of about ``lot`` of them, each with a copy of the
        shelf's blocks, so that a task's share of pairs does not grow with the number of queries.
        """
        lots = asked.groupBy("shelf").agg(F.ceil(F.count("*") / self.lot).cast("int").alias("lots"))
        dealt = asked.join(F.broadcast(lots), "shelf").withColumn("lot", F.pmod(F.xxhash64("q_block"), F.col("lots")).cast("int"))
        copies = table.join(F.broadcast(lots), "shelf").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        # With a number, so that tasks of long searches over few bytes are not made one.
        dealt, copies = (t.drop("lots").repartition(parts, "shelf", "lot") for t in (dealt, copies))
        return dealt.join(copies, ["shelf", "lot"])

    @staticmethod
    def _placed(rows: DataFrame, shared, kind: str) -> DataFrame:
        """Rows with their nearest pivot; components in the type ``kind``."""

        def run(batches):
            pivots, longest = shared.value[:2]
            for batch in batches:
                x = V.matrix(batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.num_rows)
                near = _distances(_lift(x, longest), pivots).argmin(axis=1).astype(np.int32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(kind))), pa.array(near)], names=["vec_id", "vector", "near"])

        return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id bigint, vector array<{_KINDS[kind]}>, near int")

    @staticmethod
    def _pivot_table(candidates: DataFrame, shared) -> DataFrame:
        def run(batches):
            pivots, longest, _, _, kind, far_kind = shared.value
            for batch in batches:
                own = [V.matrix(v, len(i)) for i, v in zip(batch.column(1), batch.column(2), strict=True)]
                far = [_distances(_lift(x.astype(float), longest), pivots) for x in own]
                added = [pa.array([x.astype(t).tobytes() for x in xs], pa.binary()) for xs, t in ((own, kind), (far, far_kind))]
                added += [pa.array([of(x, axis=0) for x in far], pa.list_(pa.float64())) for of in (np.min, np.max)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], names=["shelf", "ids", "vectors", "to_pivot", "low", "high"])

        return candidates.mapInArrow(run, "shelf int, ids array<bigint>, vectors binary, to_pivot binary, low array<double>, high array<double>")

    @staticmethod
    def _queries(asked: DataFrame, shared) -> DataFrame:
        def run(batches):
            kind = shared.value[4]
            for batch in batches:
                vectors = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["q_block", "q_ids", "q_vectors"])

        return asked.mapInArrow(run, "q_block int, q_ids array<bigint>, q_vectors binary")

    def _sent(self, queries: DataFrame, shared, ranges: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
        """(shelf, q_block, floor): blocks of queries by number with their first thresholds, for each shelf that one of them may find something on."""
        k = self.k

        def run(batches):
            pivots, longest, sample, ids, kind, _ = shared.value
            for batch in batches:
                for r in range(batch.num_rows):
                    q_ids = batch.column(1)[r].values.to_numpy()
                    q = np.frombuffer(batch.column(2)[r].as_py(), kind).reshape(len(q_ids), -1).astype(float)
                    floor = np.full(len(q), -_LARGEST - 1, np.int64)
                    others = ids != q_ids[:, None]
                    if len(ids) > k:
                        got = np.where(others, products(q, sample.T), -_LARGEST - 1)
                        floor = np.partition(got, -k, axis=1)[:, -k]
                    from_query, square = query_distances(q, pivots, longest)
                    to = [shelf for shelf, low, high in ranges if not (ceilings(low, high, from_query, square) < floor).all()]
                    ends = np.arange(len(to) + 1, dtype=np.int32) * len(q)
                    floors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.tile(floor, len(to))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(to, np.int32)), pa.array([batch.column(0)[r].as_py()] * len(to), pa.int32()), floors], names=["shelf", "q_block", "floor"])

        return queries.select("q_block", "q_ids", "q_vectors").mapInArrow(run, "shelf int, q_block int, floor array<bigint>")

    def _search(self, pairs: DataFrame, shared) -> DataFrame:
        k = self.k

        def run(batches):
            pivots, longest, _, _, kind, far_kind = shared.value
            # The k best scores seen so far of each query, by block of queries.
            tops: OrderedDict[int, np.ndarray] = OrderedDict()
            for batch in batches:
                cols = {name: batch.column(name) for name in batch.schema.names}
                for r in range(batch.num_rows):
                    q_ids, x_ids, start = (cols[c][r].values.to_numpy() for c in ("q_ids", "ids", "floor"))
                    q, x = (np.frombuffer(cols[c][r].as_py(), kind).reshape(n, -1).astype(float) for c, n in (("q_vectors", len(q_ids)), ("vectors", len(x_ids))))
                    to_pivot = np.frombuffer(cols["to_pivot"][r].as_py(), far_kind).reshape(len(x_ids), -1)
                    which = cols["q_block"][r].as_py()
                    top = tops.pop(which, None)
                    if top is None:
                        top = np.full((len(q), k), -_LARGEST - 1, np.int64)
                    at, ids, scores = search_block(q, q_ids, x, x_ids, to_pivot, pivots, longest, k, np.maximum(start, top[:, 0]))
                    if len(at):
                        added = np.full((len(q), k), -_LARGEST - 1, np.int64)
                        added[at, np.arange(len(at)) - np.searchsorted(at, at)] = scores
                        top = np.sort(np.hstack([top, added]), axis=1)[:, k:]
                    tops[which] = top
                    if len(tops) > 256:  # thresholds only save work; the oldest may go
                        tops.popitem(last=False)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

        return pairs.select("q_block", "q_ids", "q_vectors", "floor", "ids", "vectors", "to_pivot").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::hugeint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
