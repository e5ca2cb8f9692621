"""Token-ID files coded by a static range asymmetric numeral system.

File format, all of it Parquet that Spark commits (any store, any executor may be lost):

* ``table``: one row per id that occurs, with its frequency in a shared scale of ``1 << SCALE`` slots;
* ``blocks``: one row per independent block: place (``part``, ``block``), the documents in it with their
  token counts, ``lanes`` interleaved states, and ``words``, the 32-bit words that the lanes read. Token i
  of a block belongs to lane i mod lanes. ``states`` holds the lanes' states at each checkpoint and
  ``at`` the word each checkpoint reads next, so that the stretches between checkpoints decode apart.
  ``coded_crc32`` covers words and states, ``ids_crc32`` the ids, ``table_crc32`` names the table.

Documents never straddle blocks, blocks are in ascending doc_id order within a part and parts are ranges of
doc_id. Each lane steps in one numpy operation with all the others of its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.pieces import PieceIds
from photonlake.llm.storage import Scratch, bounded_batches

SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BLOCK_TOKENS = 1 << 18
LANES = 1024
#: Steps of all lanes between two checkpoints.
CHECKPOINT = 128

_BLOCKS = "part int, block int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, table_crc32 bigint, lanes int, at array<bigint>, states binary, words binary, coded_crc32 bigint, ids_crc32 bigint"


class Table:
    """Frequencies of ids, scaled so that they sum to ``1 << SCALE`` and none that occurs is 0."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        self.before = np.cumsum(self.frequency) - self.frequency
        self.crc32 = zlib.crc32(frequency.astype("<u4").tobytes())

    @staticmethod
    def scaled(counts: np.ndarray) -> Table:
        """Largest-remainder rounding; what rounding up rare ids adds, the most frequent ones give."""
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return Table(np.zeros(len(counts), np.int64))
        share = counts * (size / total)
        out = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
        spare = size - int(out.sum())
        order = np.argsort(-(share - out), kind="stable")
        order = order[counts[order] > 0]
        if spare > 0:
            times = np.bincount(np.arange(spare) % len(order), minlength=len(order))
            out[order] += times
        while spare < 0:
            give = np.flatnonzero(out > 1)
            give = give[np.argsort(-out[give], kind="stable")][: -spare]
            most = np.maximum(1, out[give] // 64)
            most = np.where(np.cumsum(most) <= -spare, most, np.maximum(0, -spare - (np.cumsum(most) - most)))
            out[give] -= np.minimum(most, out[give] - 1)
            spare = size - int(out.sum())
        return Table(out)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> dict:
    """Lanes, checkpoints, states and words of one block."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    frequency, before = table.frequency[ids], table.before[ids]
    limit = frequency << np.uint64(63 - SCALE)
    x = np.full(lanes, LOW, np.uint64)
    steps = -(-n // lanes)
    parts, written, at, states = [], 0, [], []
    for t in range(steps - 1, -1, -1):
        lo, hi = t * lanes, min(n, (t + 1) * lanes)
        y = x[: hi - lo]
        out = y >= limit[lo:hi]
        words = y[out].astype(np.uint32)
        parts.append(words)
        written += len(words)
        y = np.where(out, y >> WORD, y)
        q, r = np.divmod(y, frequency[lo:hi])
        x[: hi - lo] = (q << np.uint64(SCALE)) + r + before[lo:hi]
        if t % CHECKPOINT == 0:
            at.append(written)
            states.append(x.copy())
    words = np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)
    coded, kept = words.astype("<u4").tobytes(), b"".join(s.astype("<u8").tobytes() for s in states[::-1])
    return {"lanes": lanes, "at": [written - a for a in at[::-1]], "states": kept, "words": coded, "coded_crc32": zlib.crc32(kept, zlib.crc32(coded))}


def decode_stretch(block: dict, k: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids from checkpoint ``k`` to the next, from nothing but that checkpoint's states and words."""
    lanes, n = block["lanes"], block["n_tokens"]
    words = np.frombuffer(block["words"], "<u4")
    x = np.frombuffer(block["states"], "<u8")[k * lanes : (k + 1) * lanes].astype(np.uint64)
    at = block["at"][k]
    first, last = k * CHECKPOINT * lanes, min(n, (k + 1) * CHECKPOINT * lanes)
    out = np.empty(last - first, np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for lo in range(first, last, lanes):
        hi = min(last, lo + lanes)
        y = x[: hi - lo]
        slot = y & low
        ids = slots[slot.astype(np.int64)]
        y = table.frequency[ids] * (y >> np.uint64(SCALE)) + slot - table.before[ids]
        short = np.flatnonzero(y < LOW)
        y[short] = y[short] << WORD | words[at : at + len(short)]
        at += len(short)
        x[: hi - lo] = y
        out[lo - first : hi - first] = ids
    return out


def decode_block(block: dict, table: Table, slots: np.ndarray) -> np.ndarray:
    """All ids of a block, its checksums verified."""
    if zlib.crc32(block["states"], zlib.crc32(block["words"])) != block["coded_crc32"]:
        raise ValueError(f"block {block['part']}/{block['block']}: coded bytes are damaged")
    if block["table_crc32"] != table.crc32:
        raise ValueError(f"block {block['part']}/{block['block']}: coded with another table")
    parts = [decode_stretch(block, k, table, slots) for k in range(len(block["at"]))]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["ids_crc32"]:
        raise ValueError(f"block {block['part']}/{block['block']}: ids differ from what was coded")
    return ids


class TokenFiles:
    """Write token ids of documents as coded blocks in ascending doc_id order, and read them back.

    ``tokenize(column)`` yields the ids of each text of an Arrow column. A null text counts as empty; each
    document gets ``end_id`` after its ids. Null doc_ids come first; rows that repeat a doc_id follow each
    other in the order of their texts. An empty table gives files without blocks.
    """

    def __init__(self, spark: SparkSession, tokenize: Callable[[], Callable[[pa.Array], Iterator[np.ndarray]]], vocabulary: int, end_id: int = 0):
        self.spark, self.tokenize, self.vocabulary, self.end_id = spark, tokenize, vocabulary, end_id
        self.scratch = Scratch(spark, "token-files")
        bounded_batches(spark)

    def write(self, docs: DataFrame) -> str:
        """Code all documents; returns the folder of the files."""
        raw = self.scratch.table(self._raw(docs), "raw")
        table = self._table(raw)
        present = np.flatnonzero(table.frequency)
        rows = self.spark.createDataFrame([(int(i), int(table.frequency[i])) for i in present], "id int, frequency bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(self.scratch.path("table"))
        shared = self.spark.sparkContext.broadcast(table)
        kind = self._raw_type()

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row.pop("ids"), kind)
                    row |= encode_block(ids, shared.value) | {"table_crc32": shared.value.crc32, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    yield pa.RecordBatch.from_pylist([row], schema=batch_schema)

        batch_schema = _arrow_blocks()
        raw.mapInArrow(run, _BLOCKS).write.mode("overwrite").option("compression", "none").parquet(self.scratch.path("blocks"))
        self.scratch.drop("raw")
        return self.scratch.root

    def _raw_type(self) -> str:
        return "<u2" if self.vocabulary <= 1 << 16 else "<u4"

    def _raw(self, docs: DataFrame) -> DataFrame:
        """Blocks of ids that are not coded yet."""
        tokenize, end, kind = self.tokenize, self.end_id, self._raw_type()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def run(batches):
            part, block = TaskContext.get().partitionId(), 0
            names, counts, parts_, total = [], [], [], 0
            last = np.array([end], kind)
            of = tokenize()

            def cut():
                return pa.RecordBatch.from_pylist([{"part": part, "block": block, "doc_ids": names, "doc_tokens": counts, "n_tokens": total, "ids": b"".join(parts_)}], schema=schema)

            for batch in batches:
                for name, ids in zip(batch.column(0).to_pylist(), of(batch.column(1)), strict=True):
                    names.append(name)
                    counts.append(len(ids) + 1)
                    parts_ += [ids.astype(kind).tobytes(), last.tobytes()]
                    total += len(ids) + 1
                    if total >= BLOCK_TOKENS:
                        yield cut()
                        names, counts, parts_, total, block = [], [], [], 0, block + 1
            if names:
                yield cut()

        return dealt.mapInArrow(run, "part int, block int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, ids binary")

    def _table(self, raw: DataFrame) -> Table:
        """Counts over all ids of all documents; what reaches the driver is one row per id of the vocabulary."""
        kind, size = self._raw_type(), self.vocabulary

        def run(batches):
            counts = np.zeros(size, np.int64)
            for batch in batches:
                for ids in batch.column(0):
                    counts += np.bincount(np.frombuffer(ids.as_py(), kind), minlength=size)
            present = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(counts[present])], names=["id", "n"])

        counts = np.zeros(size, np.int64)
        for id_, n in raw.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
            counts[id_] = n
        return Table.scaled(counts)

    def _shared_table(self, folder: str):
        frequency = np.zeros(self.vocabulary, np.int64)
        for id_, n in self.spark.read.parquet(f"{folder}/table").collect():
            frequency[id_] = n
        return self.spark.sparkContext.broadcast(Table(frequency))

    def stretches(self, folder: str) -> DataFrame:
        """(part, block, stretch, first, ids): the ids between two checkpoints, each decoded from its own states and words.

        Stretches of one block go to different tasks, so that a very long document is decoded in parallel as well.
        ``first`` is the place of the first id in its block; ids are little-endian unsigned 32-bit integers.
        """
        shared = self._shared_table(folder)
        rows = self.spark.read.parquet(f"{folder}/blocks").select("part", "block", "lanes", "n_tokens", "table_crc32", "at", "states", "words", F.posexplode("at").alias("stretch", "begin"))
        end = F.coalesce(F.get("at", F.col("stretch") + 1), (F.octet_length("words") / 4).cast("bigint"))
        cut = lambda c, lo, n: F.substring(F.col(c), (lo + 1).cast("int"), n.cast("int")).alias(c)
        first = F.col("stretch") * CHECKPOINT * F.col("lanes")
        size = F.least(F.col("n_tokens") - first, F.lit(CHECKPOINT) * F.col("lanes"))
        rows = rows.select("part", "block", "stretch", first.cast("bigint").alias("first"), size.cast("bigint").alias("n"), "lanes", "table_crc32", cut("states", F.col("stretch") * F.col("lanes") * 8, F.col("lanes") * 8), cut("words", F.col("begin") * 4, (end - F.col("begin")) * 4))

        def run(batches):
            slots = shared.value.slots()
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if r["table_crc32"] != shared.value.crc32:
                        raise ValueError(f"block {r['part']}/{r['block']}: coded with another table")
                    one = {"lanes": r["lanes"], "n_tokens": r["n"], "words": r["words"], "states": r["states"], "at": [0]}
                    out.append(decode_stretch(one, 0, shared.value, slots).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["part", "block", "stretch", "first", "ids"])

        return rows.repartition("part", "block", "stretch").mapInArrow(run, "part int, block int, stretch int, first bigint, ids binary")

    def read(self, folder: str) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
        blocks = self.spark.read.parquet(f"{folder}/blocks")
        shared = self._shared_table(folder)

        def run(batches):
            slots = shared.value.slots()
            for batch in batches:
                for row in batch.to_pylist():
                    ids = decode_block(row, shared.value, slots).astype("<u4")
                    ends = np.cumsum(row["doc_tokens"])
                    starts = ends - np.array(row["doc_tokens"])
                    crcs = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(crcs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(starts), pa.array(row["doc_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                        names=["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"],
                    )

        found = blocks.mapInArrow(run, "doc_id bigint, part int, block int, inside bigint, n_tokens bigint, ids_crc32 bigint")
        sizes = blocks.select("part", "block", "n_tokens")
        in_part = sizes.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens"))
        parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
        firsts = in_part.join(parts.select("part", "ahead"), "part").select("part", "block", (F.col("ahead") + F.col("before")).alias("first"))
        return found.join(firsts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _arrow_blocks() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _BLOCKS.split(", "))])


def library_tokenizer(path: str, special: bool = True) -> Callable[[], Callable[[pa.Array], Iterator[np.ndarray]]]:
    """Ids by the tokenizers library without a template's tokens; each distinct piece is encoded once a worker.

    With ``special``, the library's own setting, the strings of special tokens in a text become these tokens; without, they are ordinary text.
    """

    def make():
        return lambda column: _library(path, special).ids(column)

    return make


class LibraryIds:
    """Ids of whole texts: texts that hold a token added to the vocabulary go to the library, others through pieces."""

    def __init__(self, path: str, special: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.pieces = PieceIds(lambda pieces: [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)])

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            yield from self.pieces.ids(column)
            return
        for text, by_library in zip(column, whole, strict=True):
            if by_library:
                yield np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield from self.pieces.ids(pa.array([text.as_py()], pa.string()))


@cache
def _library(path: str, special: bool) -> LibraryIds:
    return LibraryIds(path, special)
