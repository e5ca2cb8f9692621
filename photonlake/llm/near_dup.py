"""MinHash near-deduplication with bottom-k sketches from one hash function.

1. Every text becomes its set of word shingles; equal sets collapse to one class, whose id is the smallest
   doc_id. The sketch of a set is its ``k`` smallest hash values.
2. Inverted lists of retained values generate overlaps. Two sets at the threshold share at least ``least``
   of their retained values (six standard deviations below the mean of a binomial of k draws; for sets that
   a sketch holds whole, the exact overlap), so a sketch needs to enter only its size - ``least`` + 1 rarest
   values: passages that very many documents share are met only by documents made of little else.
3. A list is not expanded into its pairs. In each of a few rounds it compares all members with one pivot
   (the set whose values most others hold); members that the pivot joins are one component and need no
   further comparison. What remains are pairs of different components in one list. Of these the triangle
   inequality of the Jaccard distance rules out a member linked to a pivot against one further than twice
   the limit from it. Long lists that are left are compared in blocks of members whose links alone leave a
   task.
4. Pairs pass a union-sketch estimate before the exact Jaccard of whole sets, recomputed from the texts of
   those documents alone, decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.components import components
from photonlake.llm.shingles import full_sets, sketches
from photonlake.llm.skew import among, with_groups
from photonlake.llm.storage import Scratch, bounded_batches


#: Strips that the blocks of a long list are dealt to.
STRIPS = 16


def least_shared(k: int, share: float) -> int:
    """Retained values that two sets of that Jaccard similarity share, but for six pairs in 10**9 (the tail of 27 of 64 at 0.75)."""
    return max(1, math.floor(k * share - 6 * math.sqrt(k * share * (1 - share))))


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class NearDuplicates:
    """Link documents whose shingle sets have 100 * intersection >= percent * union.

    ``run`` returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept. Rows without words link with nothing; rows with a null doc_id take no part and are kept; rows
    that repeat a doc_id belong together by that id, and so does what their texts are linked with. ``exact`` holds whole sets
    in place of sketches, so that no pair at the threshold is missed; it posts a quarter of all shingles.
    """

    def __init__(self, spark: SparkSession, percent: int = 75, k: int = 64, rounds: int = 2, long_list: int = 24, exact: bool = False):
        k = (1 << 31) - 1 if exact else k
        self.spark, self.percent, self.k, self.rounds, self.long_list = spark, percent, k, rounds, long_list
        self.least = least_shared(k, percent / 100)
        self.far = least_shared(k, max(0.0, 2 * percent / 100 - 1))
        self.scratch = Scratch(spark, "near-dup")
        bounded_batches(spark)

    def run(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sketched = self.scratch.table(sketches(docs, self.k), "sketches")
        classes = self._classes(sketched)
        mine = self.scratch.table(sketched.select("doc_id", "n_shingles", "f1", "f2"), "sets")
        heads = self._heads(sketched, classes)
        self.scratch.drop("sketches")
        postings = self.scratch.table(self._postings(heads), "postings")
        known, open_ = self._stars(heads, docs, postings)
        rest = self._rest(heads, docs, open_, known)
        own = mine.filter("doc_id is not null and n_shingles > 0").join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"])
        links = known.filter("linked").select("a", "b").union(rest.filter("linked").select("a", "b"))
        repeated = self.scratch.table(mine.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated")
        again = not repeated.isEmpty()
        if again:
            # All classes of a repeated id are linked through the smallest of them.
            of_id = self.scratch.table(own.join(repeated, "doc_id", "left_semi").select("doc_id", "rep").distinct(), "repeated-classes")
            first = of_id.groupBy("doc_id").agg(F.min("rep").alias("a"))
            links = links.union(of_id.join(first, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b"))
        found = components(links, self.scratch, "all")
        placed = own.join(found, own.rep == found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        alone = mine.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        if again:
            known_ids = placed.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
            alone = alone.join(known_ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"))
        return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def _classes(self, sketched: DataFrame) -> DataFrame:
        grouped = sketched.filter("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        return self.scratch.table(grouped, "classes")

    def _heads(self, sketched: DataFrame, classes: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, sketch) of the document that stands for each class; of its copies no sketch is needed."""
        own = ["doc_id", "n_shingles", "f1", "f2"]
        heads = sketched.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "f1", "f2"), own)
        return self.scratch.table(heads.select("doc_id", "n_shingles", "sketch"), "heads")

    def _postings(self, heads: DataFrame) -> DataFrame:
        """(value, id, n, central) of the rarest shared values of each class, as far as the prefix reaches.

        ``central``: mean number of classes that hold its values, largest for the text that others vary.
        """
        values = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
        shared = values.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
        own = Window.partitionBy("id", "n")
        total = heads.agg(F.sum(F.size("sketch"))).first()[0] or 0
        ranked = self._with_lists(values, self.scratch.table(shared, "shared"), "holders", total).withColumn("rank", F.row_number().over(own.orderBy("holders", "value")))
        ranked = ranked.withColumn("common", F.count("*").over(own)).withColumn("central", F.sum("holders").over(own) / F.col("held"))
        whole = F.col("n") * 100 <= self.k * self.percent
        overlap = F.when(whole, F.ceil(F.col("n") * self.percent / 100)).otherwise(F.lit(self.least))
        prefix = F.col("held") - overlap + 1 - (F.col("held") - F.col("common"))
        kept = ranked.filter(F.col("rank") <= prefix)
        return kept.select("value", "id", "n", "central")

    @staticmethod
    def _with_lists(rows: DataFrame, lists: DataFrame, members: str, total: int) -> DataFrame:
        """``rows`` (value, id, ...) that have a list, with its columns."""
        met = with_groups(rows, lists, "value", members, total, ["id", "value"]).filter("group is not null")
        return met.select(*rows.columns, "group.*")

    def _stars(self, heads: DataFrame, docs: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rounds in which every list that still spans components compares all its members with its next pivot.

        Returns all verified pairs, and the lists that are left: (value, id, n, component, state of each round).
        """
        known, open_, states, total = None, postings.withColumn("component", F.col("id")), [], postings.count()
        for round_ in range(self.rounds):
            lists = open_.groupBy("value").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "n", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
            lists = self.scratch.table(lists.filter("low <> high").select("value", "size", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.component").alias("pc")), f"lists-{round_}")
            met = self.scratch.table(self._with_lists(open_, lists, "size", total).drop("size").filter("id <> pivot").withColumn("a", F.least("id", "pivot")).withColumn("b", F.greatest("id", "pivot")), f"met-{round_}")
            pairs = met.filter(F.col("component") != F.col("pc")).filter(_sizes_fit("n", "pn", self.percent)).select("a", "b").distinct()
            if known is not None:
                pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
            now = self._verified(heads, docs, pairs, f"star-{round_}")
            known = now if known is None else self.scratch.table(known.union(now), f"known-{round_}")
            placed = components(known.filter("linked"), self.scratch, f"star-{round_}")
            apart = ~_sizes_fit("n", "pn", 2 * self.percent - 100)
            state = F.when(F.col("linked"), 2).when(F.coalesce("distant", F.lit(False)) | apart, 0).otherwise(1)
            joined = met.join(known, ["a", "b"], "left").join(placed, met.id == placed.node, "left")
            label = f"state_{round_}"
            open_ = joined.select("value", "id", "n", "central", F.coalesce(placed.component, met.id).alias("component"), *states, state.alias(label))
            states.append(label)
            open_ = self.scratch.table(open_, f"open-{round_}")
            self.scratch.drop(f"met-{round_}", *([f"open-{round_ - 1}"] if round_ else []))
        return known, open_

    def _rest(self, heads: DataFrame, docs: DataFrame, open_: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of different components that still share a list and that no pivot rules out: (a, b, linked)."""
        lists = open_.groupBy("value").agg(F.count("*").alias("members"), F.min("n").alias("n_least"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        lists = self.scratch.table(lists.select("value", "members", "n_least"), "rest-sizes")
        met = self.scratch.table(self._with_lists(open_, lists, "members", open_.count()), "rest-lists")
        x, y = (met.filter(F.col("members") <= self.long_list).select("value", *[F.col(c).alias(f"{c}_{s}") for c in met.columns if c != "value"]) for s in "xy")
        pairs = x.join(y, "value").filter("id_x < id_y and component_x <> component_y").filter(_sizes_fit("n_x", "n_y", self.percent))
        for r in range(self.rounds):
            pairs = pairs.filter(f"abs(state_{r}_x - state_{r}_y) < 2")
        pairs = pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        short = self._verified(heads, docs, pairs, "rest").select("a", "b", "linked")
        return short.union(self._long_lists(docs, met.filter(F.col("members") > self.long_list)))

    def _long_lists(self, docs: DataFrame, met: DataFrame) -> DataFrame:
        """Exact links inside long lists, by blocks of members: only links leave a pair of blocks.

        Each member carries the values of its whole set that another member of a long list holds as well. Their
        number bounds every intersection, which leaves out the texts that vary a common one too much.
        """
        ids = self.scratch.table(met.select(F.col("id").alias("doc_id")).distinct(), "rest-ids")
        values = self.scratch.table(full_sets(among(docs, ids, "doc_id")).select("doc_id", F.explode("shingles").alias("v")).distinct(), "rest-values")
        shared = values.groupBy("v").agg(F.count("*").alias("holders")).filter("holders > 1").select("v")
        sets = values.join(shared, "v").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("v").alias("values"))
        most = F.size("values")
        kept = met.join(sets, "id").filter(100 * most >= self.percent * (F.col("n") + F.greatest("n_least", F.floor(F.col("n") * self.percent / 100)) - most))
        many = F.ceil(F.col("members") / 256).cast("int")
        block = F.pmod(F.xxhash64("id"), many).cast("int").alias("block")
        blocks = kept.select("value", block, many.alias("blocks"), F.struct("id", "n", "component", "values").alias("m")).groupBy("value", "block", "blocks").agg(F.collect_list("m").alias("m"))
        blocks = self.scratch.table(blocks, "rest-blocks")
        # Blocks fall into strips, and a pair of strips is a group of its own, so that a list is spread over many tasks.
        strip = F.pmod("block", F.lit(STRIPS)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(STRIPS)) - 1))
        x = blocks.select("value", strip.alias("one"), others.alias("two"), F.col("block").alias("block_x"), F.col("m").alias("m_x"))
        y = blocks.select("value", others.alias("one"), strip.alias("two"), F.col("block").alias("block_y"), F.col("m").alias("m_y"))
        percent = self.percent

        def run(batches):
            for batch in batches:
                for mx, my in zip(batch.column(0), batch.column(1), strict=True):
                    a, b = _links_between(mx.values, my.values, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), bool))], names=["a", "b", "linked"])

        met_blocks = x.join(y, ["value", "one", "two"]).filter("block_x <= block_y").select("m_x", "m_y")
        return self.scratch.table(met_blocks.mapInArrow(run, "a bigint, b bigint, linked boolean").distinct(), "rest-long")

    def _verified(self, heads: DataFrame, docs: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
        """(a, b, linked, distant) of each pair: union-sketch estimate, then exact Jaccard on whole sets."""
        pairs = self.scratch.table(pairs, f"{label}-pairs")
        held = among(heads, self._ids(pairs, f"{label}-met"), "doc_id")
        a = held.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
        b = held.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        judged = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(union).alias("seen"), F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))).alias("both"))
        judged = judged.groupBy("a", "b").agg(F.max("seen").alias("seen"), F.max("both").alias("both"))
        judged = self.scratch.table(judged, f"{label}-judged")
        likely = F.when(F.col("seen") < self.k, 100 * F.col("both") >= self.percent * F.col("seen")).otherwise(F.col("both") >= self.least)
        distant = F.when(F.col("seen") < self.k, 100 * F.col("both") < (2 * self.percent - 100) * F.col("seen")).otherwise(F.col("both") < self.far)
        likely_pairs = judged.filter(likely).select("a", "b")
        sets = self.scratch.table(full_sets(among(docs, self._ids(likely_pairs, f"{label}-likely"), "doc_id")), f"{label}-sets")
        left, right = (sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        exact = likely_pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("set_a") + F.size("set_b")).alias("t"))
        exact = exact.groupBy("a", "b").agg(F.max((100 * F.col("i") >= self.percent * (F.col("t") - F.col("i"))).cast("int")).alias("linked"))
        out = judged.select("a", "b", distant.alias("distant")).join(exact, ["a", "b"], "left").select("a", "b", (F.coalesce("linked", F.lit(0)) == 1).alias("linked"), "distant")
        out = self.scratch.table(out, f"{label}-verified")
        self.scratch.drop(*[f"{label}-{name}" for name in ("pairs", "met", "judged", "likely", "sets")])
        return out

    def _ids(self, pairs: DataFrame, name: str) -> DataFrame:
        """(doc_id) that stand in pairs (a, b)."""
        return self.scratch.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), name)


def _links_between(x: pa.StructArray, y: pa.StructArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (smaller id, larger id) of different components between two blocks of (id, n, component, values)."""
    ids, n, own = ([m.field(k).to_numpy() for m in (x, y)] for k in ("id", "n", "component"))
    flat = [m.field("values").flatten().to_numpy() for m in (x, y)]
    rows = [np.repeat(np.arange(len(m)), np.diff(m.field("values").offsets.to_numpy())) for m in (x, y)]
    common = np.intersect1d(flat[0], flat[1])
    both = np.zeros((len(x), len(y)), np.float32)
    place = [np.searchsorted(common, f) for f in flat]
    held = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        parts = []
        for k, m in enumerate((x, y)):
            use = held[k] & (place[k] >= lo) & (place[k] < lo + width)
            part = np.zeros((len(m), width), np.float32)
            part[rows[k][use], place[k][use] - lo] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    i = both.astype(np.int64)
    linked = (100 * i >= percent * (n[0][:, None] + n[1] - i)) & (own[0][:, None] != own[1])
    at, to = np.nonzero(linked)
    return np.minimum(ids[0][at], ids[1][to]), np.maximum(ids[0][at], ids[1][to])
