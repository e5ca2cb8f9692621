"""The trie of all prefixes of conversations, from range-partitioned sorted paths.

1. A conversation's path is the chain of 128-bit keys of its turns, whose byte order puts every prefix before what
   extends it. Splitters, taken from a bounded sample of (path, conv_id), cut that order into shards; rows of equal paths
   are told apart by conv_id, so that copies of one conversation fall into several shards.
2. Only a prefix of a splitter can have members in more than one shard. The trie of these prefixes, the skeleton, is
   broadcast. A shard walks its sorted paths once with a stack of open nodes, finishes every other node, and gives for
   skeleton nodes the partial sums of what it saw.
3. Partial sums are added up by node, and then up the skeleton by each node's list of ancestors.

A task holds the open nodes of one path and their direct children, never a whole shard.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.storage import Scratch

#: Bytes of a turn's key in a path.
KEY = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_STEP = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, parent_part int, part int, chars bigint, first_id bigint, ends string"
_COLUMNS = [c.split()[0] for c in _STEP.split(", ")]
_TYPES = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (c.split() for c in _STEP.split(", "))])
_NODE = _COLUMNS[:8]


def turn_key(role: Column, text: Column) -> Column:
    """The hexadecimal key of a turn: half of a SHA-256 of role and text, told apart by the role's length."""
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (key, chars) of each conversation in order.

    Turns are ordered by ``turn`` (null first); equal ones by role, then by their key, so that repeated rows are repeated
    turns. Null role or text is empty. Rows without a conv_id take no part.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = F.struct(F.col("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.char_length(text).alias("chars"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), one.alias("one"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): each conversation with its first h turns taken from the first conversation of its ``group`` of ids.

    h is the unsigned CRC-32 of the decimal id modulo ``most``; where the first conversation is absent, nothing stands in
    for those turns. At most ``group`` conversations meet one first conversation.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    met = own.withColumn("base", base).join(heads, "base", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@dataclass
class Skeleton:
    """Splitters and the trie of their prefixes: node 0 is the root."""

    splitters: list[tuple[bytes, int]]
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=lambda: [-1])

    @staticmethod
    def of(sample: list[tuple[bytes, int]], shards: int) -> Skeleton:
        """Splitters at equal distances in the sorted sample, for at most so many shards."""
        ordered = sorted(set(sample))
        at = sorted({k * len(ordered) // shards for k in range(1, shards)}) if ordered else []
        out = Skeleton([ordered[i] for i in at])
        for path, _ in out.splitters:
            node = 0
            for lo in range(0, len(path), KEY):
                key = (node, path[lo : lo + KEY])
                if key not in out.child:
                    out.child[key] = len(out.parents)
                    out.parents.append(node)
                node = out.child[key]
        return out

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv_id))

    def rows(self) -> list[tuple[int, int, int | None, list[int]]]:
        """(part, depth, parent part, itself and its ancestors) of every node."""
        above: list[list[int]] = []
        for node, parent in enumerate(self.parents):
            above.append([node, *above[parent]] if parent >= 0 else [node])
        return [(node, len(a) - 1, a[1] if len(a) > 1 else None, a) for node, a in enumerate(above)]


class _Open:
    """A node on the stack: sums over the members and finished children seen so far."""

    __slots__ = ("chars", "children", "digest", "ends", "kids", "least", "leaves", "n", "part", "saved")

    def __init__(self, part: int, chars: int):
        self.part, self.chars = part, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.kids: list[list] = []
        self.ends: list[int] = []
        self.digest = None

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class _Walk:
    """One pass over the sorted paths of a shard."""

    #: Ids in one piece of a skeleton node's list of ends.
    PIECE = 65536

    def __init__(self, skeleton: Skeleton):
        self.child, self.rows = skeleton.child, []
        self.stack, self.path = [_Open(0, 0)], b""

    def take(self, path: bytes, conv_id: int, chars: list[int]) -> None:
        depth, most = 0, min(len(path), len(self.path)) // KEY
        while depth < most and path[depth * KEY : (depth + 1) * KEY] == self.path[depth * KEY : (depth + 1) * KEY]:
            depth += 1
        self.close(depth)
        for d in range(depth, len(path) // KEY):
            above = self.stack[-1].part
            part = self.child.get((above, path[d * KEY : (d + 1) * KEY]), -1) if above >= 0 else -1
            self.stack.append(_Open(part, chars[d]))
        self.path, end = path, self.stack[-1]
        end.add(1, conv_id)
        if end.part >= 0:
            end.ends.append(conv_id)
            if len(end.ends) == self.PIECE:
                self.piece(end)
        elif end.digest is None:
            end.digest = hashlib.sha256(str(conv_id).encode())
        else:
            end.digest.update(b",%d" % conv_id)

    def piece(self, node: _Open) -> None:
        self.rows.append([None] * 9 + [node.part, None, node.ends[0], ",".join(map(str, node.ends))])
        node.ends = []

    def close(self, depth: int) -> None:
        """Finish the open nodes below a depth; -1 finishes all."""
        while len(self.stack) > depth + 1:
            node, d = self.stack.pop(), len(self.stack)
            above = self.stack[-1] if self.stack else None
            if above is not None:
                above.add(node.n, node.least)
            if node.part >= 0:
                if node.ends:
                    self.piece(node)
                self.rows.append([node.least, d, None, node.n, node.children, node.leaves, node.saved, None, None, node.part, node.chars, None, None])
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.chars
            row = [node.least, d, None, node.n, node.children, leaves, saved, node.digest.hexdigest() if node.digest else _EMPTY, None, None, None, None, None]
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            for kid in node.kids:
                kid[2] = node.least
            self.rows += node.kids
            if above.part >= 0:
                row[8] = above.part
                self.rows.append(row)
            else:
                above.kids.append(row)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
            self.rows = []


class PrefixTrie:
    """Nodes of the trie of (conv_id, turns), turns being an array of (key, chars).

    ``run`` returns a row per distinct sequence of first turns, the root included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. conv_id must be unique and not null; a
    conversation without turns is a member of the root alone; without conversations there is no node. A path is one
    value: a conversation may have about 10**8 turns. ``sample`` rows a shard choose the splitters, of which
    the first ``deepest`` turns count; the skeleton has at most ``shards`` times ``deepest`` nodes.
    """

    def __init__(self, spark: SparkSession, shards: int | None = None, sample: int = 32, deepest: int = 64):
        self.spark, self.sample, self.deepest = spark, sample, deepest
        self.shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "prefix-trie")

    def run(self, turns: DataFrame) -> DataFrame:
        path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path")
        paths = self.scratch.table(turns.select("conv_id", path, F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
        heads = paths.select("conv_id", F.substring("path", 1, KEY * self.deepest).alias("path")).orderBy(F.xxhash64("conv_id"), "conv_id").limit(self.sample * self.shards)
        skeleton = Skeleton.of([(bytes(r["path"]), r["conv_id"]) for r in heads.collect()], self.shards)
        walked = self.scratch.table(self._walked(paths, skeleton), "walked")
        self.scratch.drop("paths")
        bones = self.scratch.table(self._bones(walked, skeleton), "skeleton")
        tops = bones.select(F.col("part").alias("parent_part"), F.col("conv_id").alias("top"))
        done = walked.filter("part is null").join(F.broadcast(tops), "parent_part", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top"))
        return done.select(_NODE).unionByName(bones.select(_NODE))

    def _walked(self, paths: DataFrame, skeleton: Skeleton) -> DataFrame:
        held = self.spark.sparkContext.broadcast(skeleton)

        def place(batches):
            for batch in batches:
                ids, chains = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                shard = pa.array([held.value.shard(p, c) for p, c in zip(chains, ids, strict=True)], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=["conv_id", "path", "chars", "shard"])

        def walk(batches):
            shard, state = None, None
            for batch in batches:
                for conv_id, path, chars, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != shard:
                        if state:
                            state.close(-1)
                            yield from state.drain()
                        shard, state = own, _Walk(held.value)
                    state.take(path, conv_id, chars)
                    if len(state.rows) > 8192:
                        yield from state.drain()
            if state:
                state.close(-1)
                yield from state.drain()

        placed = paths.mapInArrow(place, "conv_id bigint, path binary, chars array<int>, shard int")
        dealt = placed.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
        return dealt.mapInArrow(walk, _STEP)

    def _bones(self, walked: DataFrame, skeleton: Skeleton) -> DataFrame:
        """Finished skeleton nodes, from partial sums by node and then over all below them."""
        parts = walked.filter("part is not null")
        sums = parts.filter("first_id is null").groupBy("part").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("done"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"))
        known = self.spark.createDataFrame(skeleton.rows(), "part int, depth bigint, parent int, above array<int>")
        inner = known.filter("parent is not null").groupBy(F.col("parent").alias("part")).agg(F.count("*").alias("inner"))
        own = sums.join(known, "part").join(inner, "part", "left").withColumn("n_children", F.col("done") + F.coalesce("inner", F.lit(0)))
        own = own.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
        below = own.select(F.explode("above").alias("part"), "leaves", "saved").groupBy("part").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

        def digest(batches):
            part, state = None, None
            for batch in batches:
                for now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if now != part:
                        if state:
                            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.hexdigest()])], names=["part", "sha"])
                        part, state = now, hashlib.sha256(text.encode())
                    else:
                        state.update(b"," + text.encode())
            if state:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.hexdigest()])], names=["part", "sha"])

        ends = parts.filter("first_id is not null").select("part", "first_id", "ends").repartition("part").sortWithinPartitions("part", "first_id").select("part", "ends").mapInArrow(digest, "part int, sha string")
        upper = own.select(F.col("part").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = own.join(below, "part").join(ends, "part", "left").join(upper, "parent", "left")
        return out.select("part", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(spark: SparkSession, conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    trie = PrefixTrie(spark, shards)
    own = trie.scratch.table(conversation_turns(conversations), "own")
    return trie.run(rebuilt(own))


#: One step of the CRC-32 over a byte, for SQL without such a function.
_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substring(conv_id::varchar, i, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"

SQL = f"""
with own as (
  select conv_id, list((coalesce(role, ''), coalesce(text, '')) order by turn nulls first, coalesce(role, '')) as turns
  from conversations where conv_id is not null group by conv_id
), h as (
  select conv_id, turns, (xor({_CRC}, 4294967295) % 6)::int as h from own
), re as (
  select h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
  from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100
), member as (
  select conv_id, turns[1:d] as path, d, d = len(turns) as ends, coalesce(length(turns[d][2]), 0) as chars
  from re, lateral (select unnest(range(len(turns) + 1)) as d)
), node as (
  select path, d, min(conv_id) as conv_id, count(*) as n, max(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from member group by path, d
), up as (
  select c.path, p.conv_id as parent_conv_id from node c join node p on p.path = c.path[1:c.d - 1] and p.d = c.d - 1 where c.d > 0
), kids as (
  select path[1:d - 1] as path, count(*) as n_children from node where d > 0 group by 1
), one as (
  select node.*, up.parent_conv_id, coalesce(kids.n_children, 0) as n_children, (n - 1) * chars as own from node left join up using (path) left join kids using (path)
), below as (
  select path[1:k] as path, count(*) filter (where n_children = 0) as n_leaves, sum(own) as saved_tokens
  from one, lateral (select unnest(range(d + 1)) as k) group by 1
)
select one.conv_id::bigint as conv_id, d::bigint as depth, parent_conv_id::bigint as parent_conv_id, n::bigint as n_convs, n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256 from one join below using (path)
"""
