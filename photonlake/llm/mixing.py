"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Each source's target is its weight's share of all words, at most ``most`` times its own words; what is
   cut off goes to the others by weight until none is above.
2. A source's rows fall into blocks by a hash, more of them in larger tables; the mix takes all blocks as often as the target allows and of
   the rest a prefix of a fixed permutation of the blocks, the last one in part. These draws are the
   source's exact quota of blocks.
3. The quotas of all sources are split between two halves of the output shards, and again down to single
   shards: each split draws a multivariate hypergeometric vector, one conditional hypergeometric count per
   source, by the inverse of its distribution function at a hashed uniform. Shards therefore know how many
   blocks of each source they get before any row moves.
4. A shard gets consecutive draws of each source's permutation, so shards are disjoint, and orders its rows
   by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.columns import let
from photonlake.llm.storage import Scratch

#: The weights of the sources in order, repeating; and a word.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a block on the average in tables that need more than 4096 blocks a source.
BLOCK_ROWS = 2048


def _log_factorial(m: Column) -> Column:
    """log(m!) by Stirling's series at m + 8."""
    z = m + 8.0
    product = (m + 1.0) * (m + 2.0) * (m + 3.0) * (m + 4.0) * (m + 5.0) * (m + 6.0) * (m + 7.0)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (z * 12.0) - 1 / (z * z * z * 360.0) + 1 / (z * z * z * z * z * 1260.0) - F.log(product)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total`` without replacement, where the distribution function reaches ``u``.

    The sum runs over twelve standard deviations around the mean, outside of which lies less than 1e-30.
    """
    lf = lambda x: _log_factorial(x.cast("double"))

    def ranged(g: Column) -> Column:
        mean = g["drawn"] * g["marked"] / F.greatest(g["total"], F.lit(1))
        spread = F.sqrt(F.greatest(mean * (1 - g["marked"] / F.greatest(g["total"], F.lit(1))), F.lit(0.0))) * 12 + 12
        low = F.greatest(F.lit(0), g["drawn"] - g["others"], F.floor(mean - spread)).cast("bigint")
        high = F.least(g["marked"], g["drawn"], F.ceil(mean + spread)).cast("bigint")
        return let(F.struct(low.alias("low"), high.alias("high")), lambda r: counted(g, r["low"], r["high"]))

    def counted(g: Column, low: Column, high: Column) -> Column:
        total, marked, drawn, others = (g[k] for k in ("total", "marked", "drawn", "others"))
        first = F.exp(lf(marked) - lf(low) - lf(marked - low) + lf(others) - lf(drawn - low) - lf(others - drawn + low) - lf(total) + lf(drawn) + lf(total - drawn))

        def step(s: Column, x: Column) -> Column:
            ratio = (marked - x) * (drawn - x) / ((x + 1) * F.greatest(others - drawn + x + 1, F.lit(1)))
            return F.when(s["c"] < g["u"], F.struct((s["c"] + s["p"]).alias("c"), (s["p"] * ratio).alias("p"), x.alias("k"))).otherwise(s)

        return F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("c"), first.alias("p"), low.alias("k")), step, lambda s: s["k"])

    return let(F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), (total - marked).alias("others"), u.alias("u")), ranged)


def split_quotas(quotas: DataFrame, levels: int, seed: int, scratch: Scratch | None = None) -> DataFrame:
    """(skey, shard, blocks): exact quotas (skey, q) dealt to ``2 ** levels`` shards of equal numbers of blocks.

    A row holds the quotas of one node of the tree, one number a source.
    """
    one = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", "q"))).alias("quotas")).select(F.lit(1).cast("bigint").alias("node"), "quotas")
    for level in range(levels):
        one = scratch.table(one, f"tree-{level}") if scratch else one
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda s, x: s + x["q"])
        begin = let(total, lambda t: F.struct(t.alias("total"), F.floor(t / 2).cast("bigint").alias("room"), F.expr("cast(array() as array<bigint>)").alias("out")))

        def draw(s: Column, x: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("node"), x["skey"]).cast("binary")), 1, 13), 16, 10).cast("bigint")
            k = hypergeometric(s["total"], x["q"], s["room"], (bits + 0.5) / float(1 << 52))
            return let(k, lambda v: F.struct((s["total"] - x["q"]).alias("total"), (s["room"] - v).alias("room"), F.concat(s["out"], F.array(v)).alias("out")))

        left = one.withColumn("left", F.aggregate("quotas", begin, draw, lambda s: s["out"]))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("quotas", "left", lambda x, v: F.struct(x["skey"].alias("skey"), v.alias("q"))).alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda x, v: F.struct(x["skey"].alias("skey"), (x["q"] - v).alias("q"))).alias("quotas")),
        )
        one = left.select(F.explode(halves).alias("h")).select("h.node", "h.quotas")
    leaves = one.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.explode("quotas").alias("x"))
    return leaves.select("x.skey", "shard", F.col("x.q").alias("blocks"))


class Mixture:
    """Plan and draw a mix of ``docs`` (doc_id, text, source, any other columns).

    Null sources are one source and come last; null and empty texts have size 0 and are never needed, but
    stay in the plan; without any word all targets are 0. Rows that repeat a doc_id are rows of their own.
    No row is taken more than ``most`` times. An empty table gives an empty mix. What is held per source (its
    target, its quota at a node) is one row or one number, so sources should number less than some millions.
    """

    def __init__(self, spark: SparkSession, levels: int = 4, most: int = 3, seed: int = 11):
        self.spark, self.levels, self.most, self.seed = spark, levels, most, seed
        self.scratch = Scratch(spark, "mixture")

    def plan(self, docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
        """A row per row of ``docs``: doc_id, size, source_size, target, ``shards`` (one entry per draw), and the columns ``keep``."""
        skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
        whole = F.coalesce(F.col(text), F.lit(""))
        mark = F.md5(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(whole.cast("binary"))).cast("binary"))
        digits = max(3, math.ceil(math.log(max(1, docs.count() / BLOCK_ROWS), 16)))
        sizes = docs.select("doc_id", skey.alias("skey"), F.regexp_count(whole, F.lit(WORD)).cast("bigint").alias("size"), F.substring(mark, 1, digits).alias("block"), mark.alias("mark"), *keep)
        sizes = sizes if keep else self.scratch.table(sizes, "sizes")
        blocks = self.scratch.table(self._blocks(sizes), "blocks")
        shards = self._shard_bounds(blocks)
        placed = blocks.join(shards, "skey", "left")
        order = Window.partitionBy("skey", "block").orderBy("mark", "doc_id", "size")
        inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        rows = sizes.join(placed, ["skey", "block"]).withColumn("ahead", F.col("before") + inside)
        in_part = (F.col("part") == 2) | ((F.col("part") == 1) & (F.col("ahead") + F.col("size") / 2 <= F.col("rest")))
        draws = F.transform(F.sequence(F.lit(1), F.col("passes") + 1), lambda e: (e - 1) * F.col("n_blocks") + F.col("place"))
        draws = F.when(in_part, draws).otherwise(F.slice(draws, 1, F.col("passes")))
        shard = F.transform(draws, lambda d: F.size(F.filter("bounds", lambda b: b <= d)))
        return rows.select("doc_id", "size", "source_size", "target", shard.alias("shards"), "mark", *keep)

    def targets(self, sizes: DataFrame) -> DataFrame:
        """(skey, source_size, target) of every source."""
        sources = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
        by_name = Window.orderBy(F.col("skey") == "n", "skey")
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
        sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * self.most)
        filled = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
        ahead = filled.rowsBetween(Window.unboundedPreceding, -1)
        everything = Window.partitionBy(F.lit(1))
        level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
        sources = sources.withColumn("level", level)
        first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "skey", "level"))).over(everything)
        sources, final = sources.withColumn("final", first["level"]), F.col("final")
        return sources.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.lit(0.0))).alias("target"))

    def _blocks(self, sizes: DataFrame) -> DataFrame:
        """(skey, block, ...): place in the source's permutation, words before it, and how the last, partial pass meets it."""
        blocks = sizes.groupBy("skey", "block").agg(F.sum("size").alias("words"))
        sources = self.targets(blocks.withColumnRenamed("words", "size"))
        passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(self.most))).otherwise(0).cast("int")
        sources = sources.withColumn("passes", passes).withColumn("rest", F.when(F.col("passes") < self.most, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
        permuted = Window.partitionBy("skey").orderBy(F.md5(F.concat(F.lit(f"{self.seed}:"), "skey", F.lit(":"), "block").cast("binary")), "block")
        blocks = blocks.join(sources, "skey").withColumn("place", F.row_number().over(permuted) - 1)
        blocks = blocks.withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        blocks = blocks.withColumn("n_blocks", F.count("*").over(Window.partitionBy("skey")))
        part = F.when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
        return blocks.withColumn("part", part)

    def _shard_bounds(self, blocks: DataFrame) -> DataFrame:
        """(skey, bounds): the draw number at which each shard of a source's sequence ends."""
        quotas = blocks.groupBy("skey").agg((F.max("passes") * F.max("n_blocks") + F.sum((F.col("part") > 0).cast("bigint"))).alias("q"))
        dealt = split_quotas(quotas, self.levels, self.seed, self.scratch)
        upto = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        ends = dealt.withColumn("end", F.sum("blocks").over(upto))
        return ends.groupBy("skey").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("shard", "end"))), 1, (1 << self.levels) - 1), lambda x: x["end"]).alias("bounds"))

    def draw(self, docs: DataFrame) -> DataFrame:
        """The mix: the columns of ``docs``, a row per draw, with ``mix_shard`` and ``mix_order`` (sorting by both gives each shard its order)."""
        names = docs.columns
        packed = docs.select("doc_id", "source", F.struct(*names).alias("_row"))
        drawn = self.plan(packed, "_row", text="_row.text").select("_row", "mark", F.posexplode("shards").alias("_draw", "mix_shard"))
        return drawn.select("_row.*", "mix_shard", F.xxhash64(F.lit(self.seed), "mark", "_draw").alias("mix_order"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row; ``shards`` lists the shard of each time it is taken."""
    plan = Mixture(spark).plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


SQL = r"""
with recursive d as (
  select doc_id, case when source is null then 'n' else 's' || source end as skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('11:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as mark from documents
), s as (
  select skey, sum(size)::bigint as source_size from d group by skey
), w as (
  select *, [5, 2, 1][1 + ((row_number() over (order by skey = 'n', skey) - 1) % 3)::int] as weight, 3 * source_size as cap from s
), l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0))::double as level from w
), n as (
  select *, row_number() over (order by cap / weight, skey) as pos from l
), f as (
  select *, min(case when level * weight <= cap then pos end) over () as first_pos from n
), t as (
  select skey, source_size, least(cap::double, coalesce(max(case when pos = first_pos then level end) over () * weight, 0)) as target from f
), p as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::int else 0 end as passes from t
), r as (
  select *, case when passes < 3 then target - passes * source_size else 0.0 end as rest from p
), b as (
  select skey, substr(mark, 1, 3) as block, sum(size)::bigint as words from d group by all
), c as (
  select b.*, r.source_size, r.target, r.passes, r.rest,
    row_number() over (partition by b.skey order by md5('11:' || b.skey || ':' || block), block) - 1 as place,
    count(*) over (partition by b.skey) as n_blocks,
    sum(words) over (partition by b.skey order by md5('11:' || b.skey || ':' || block), block) - words as before from b join r using (skey)
), quotas as (
  select skey, (max(passes) * max(n_blocks) + sum(case when before + words <= rest or before < rest then 1 else 0 end))::bigint as q from c group by skey
), tree as (
  select 0 as level, 1::bigint as node, 0 as i, list(skey order by skey) as names, list(q order by skey) as q, []::bigint[] as lefts,
    sum(q)::bigint as total, (sum(q) // 2)::bigint as room from quotas having count(*) > 0
  union all
  select case when i < len(names) then level else level + 1 end, case when i < len(names) then node else node * 2 + side end,
    case when i < len(names) then i + 1 else 0 end, names,
    case when i < len(names) then q when side = 0 then lefts else list_transform(list_zip(q, lefts), lambda z: z[1] - z[2]) end,
    case when i < len(names) then list_append(lefts, k) else []::bigint[] end,
    case when i < len(names) then total - m when side = 0 then list_sum(lefts) else list_sum(q) - list_sum(lefts) end::bigint,
    case when i < len(names) then room - k when side = 0 then list_sum(lefts) // 2 else (list_sum(q) - list_sum(lefts)) // 2 end::bigint
  from (
    select *, low - 1 + len(list_filter(range(1, high - low + 2), lambda j: coalesce(list_sum(list_slice(odds, 1, j - 1)), 0) < u)) as k from (
      select *, list_transform(range(low, high + 1), lambda x: exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(total - m + 1)
        - lgamma(room - x + 1) - lgamma(total - m - room + x + 1) - lgamma(total + 1) + lgamma(room + 1) + lgamma(total - room + 1))) as odds from (
        select *, greatest(0, room - total + m, floor(mean - spread))::bigint as low, least(m, room, ceil(mean + spread))::bigint as high from (
          select *, sqrt(greatest(mean * (1 - m / greatest(total, 1)), 0)) * 12 + 12 as spread from (
            select *, q[i + 1] as m, room * q[i + 1] / greatest(total, 1) as mean,
              (('0x' || substr(md5('11:' || node || ':' || names[i + 1]), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u from tree
          )
        )
      )
    )
  ) cross join (values (0), (1)) h(side)
  where level < 4 and (i = len(names) or side = 0)
), dealt as (
  select unnest(names) as skey, unnest(q) as blocks, node from tree where level = 4 and i = 0
), bounds as (
  select skey, list("end" order by node) as bounds from (select skey, node, sum(blocks) over (partition by skey order by node) as "end" from dealt) where node < 31 group by skey
), e as (
  select d.doc_id, d.size, c.*, c.before + sum(d.size) over (partition by d.skey, c.block order by d.mark, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as ahead
  from d join c on d.skey = c.skey and substr(d.mark, 1, 3) = c.block
), g as (
  select e.*, bounds, passes + case when before + words <= rest or (before < rest and ahead + size / 2.0 <= rest) then 1 else 0 end as times from e join bounds using (skey)
)
select doc_id, size, source_size, target, (size * times)::bigint as taken,
  array_to_string(list_transform(range(0, times::bigint), lambda x: len(list_filter(bounds, lambda y: y <= x * n_blocks + place))), ',') as shards from g
"""
