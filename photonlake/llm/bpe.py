"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pieces are bucketed by length into padded matrices. Each round every row merges its leftmost pair
of minimum rank: pair ranks come from a hashed table of all pairs of the vocabulary, the merged token takes
the left place and the row is compacted by one column; rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.llm import bytescan as B
from photonlake.llm.pieces import SLICE_BYTES, HashTable, PieceIds
from photonlake.llm.storage import bounded_batches

_NONE = np.int32(2**31 - 1)
#: Longer pieces merge by a heap, whose cost does not grow with the square of the length; the ids are the same.
LONGEST_ROW = 512
#: Ids in a matrix at most; long pieces have fewer rows.
MATRIX_CELLS = 1 << 18
#: Upper lengths of the buckets.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, LONGEST_ROW)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


class ByteBPE:
    """Encoder for tokens and ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: Rank of each pair, by left << 32 | right.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        at = np.fromiter(self.pairs, np.uint64, len(self.pairs))
        self.table = HashTable(int(max(2, len(at))).bit_length() + 1)
        self.table.add(B.mix(at) | np.uint64(1), np.fromiter(self.pairs.values(), np.int32, len(at)))
        self.cache = PieceIds(self.encode_pieces, most=1 << 18, most_bytes=16 << 20)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return B.mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) | np.uint64(1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pads (-1) and unknown pairs have none."""
        found = self.table.find(self._key(left, right))
        return np.where((found < 0) | (left < 0) | (right < 0), _NONE, found).astype(np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.searchsorted(BUCKETS, lengths)
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif bucket[i] == len(BUCKETS):
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(int(bucket[i]), []).append(i)
        for b, members in buckets.items():
            most = MATRIX_CELLS // BUCKETS[b]
            for lo in range(0, len(members), most):
                self._merge_rows([pieces[i] for i in members[lo : lo + most]], BUCKETS[b], members[lo : lo + most], out)
        return out

    def _merge_rows(self, pieces: list[bytes], width: int, where: list[int], out: list) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.first[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rows = np.array(where)
        while len(ids):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rank)), at]
                done = best == _NONE
            else:
                done = np.ones(len(ids), bool)
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, : size[i]].copy()  # a view would keep the round's whole matrix
            if done.all():
                return
            if done.any():
                ids, rank, rows, size, at, best = (x[~done] for x in (ids, rank, rows, size, at, best))
            n, line = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
            ids[n, at] = best
            ids = np.take_along_axis(ids, line + (line > at[:, None]), axis=1)
            line = line[:-1]
            rank = np.take_along_axis(rank, line + (line >= at[:, None]), axis=1)
            size = size - 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.pairs.get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := self.pairs.get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]


@cache
def encoder(path: str) -> ByteBPE:
    return ByteBPE(read_ranks(path))


@cache
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids``: the little-endian unsigned 32-bit ids of each whole text (null: none).

    ``vocabulary`` is a path that every executor can open, as an installed package's file is. Empty and null texts
    have no ids, a very long text is a slice of its own, equal rows stay apart, an empty table gives one. Other
    columns pass through, whatever their names, but for one called ``ids``, which the result replaces.
    """
    docs = docs.drop("ids")
    at = docs.columns.index(text)
    return _mapped(docs, ["ids binary"], lambda batch: [[x.astype("<u4").tobytes() for x in encoder(vocabulary).cache.ids(batch.column(at))]], at)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the bytes that ``ids`` stand for (null ids: none)."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")
    return _mapped(encoded, ["decoded binary"], lambda batch: [[decoder(vocabulary).decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at)]], at)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` as of ``encode`` and ``decoded`` as of ``decode``, by one worker a task."""
    docs = docs.drop("ids", "decoded")
    at = docs.columns.index(text)

    def both(batch):
        ids = list(encoder(vocabulary).cache.ids(batch.column(at)))
        return [[x.astype("<u4").tobytes() for x in ids], [decoder(vocabulary).decode(x) for x in ids]]

    return _mapped(docs, ["ids binary", "decoded binary"], both, at, dropped=True)


def _mapped(rows: DataFrame, added: list[str], of, at: int, dropped: bool = False) -> DataFrame:
    """``rows`` (without the column at ``at`` if ``dropped``) and the columns that ``of`` makes of a slice of a batch.

    Slices go by the bytes of that column, so that results of long texts do not pile up to a whole batch.
    """
    kept = [i for i in range(len(rows.columns)) if not dropped or i != at]
    new = T.StructType.fromDDL(", ".join(added))
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), *new.fields])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, j - i) for i, j, _, _ in B.slices(batch.column(at), SLICE_BYTES)):
                columns = [pa.array(x, pa.binary()) for x in of(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns], names=[*(part.schema.names[i] for i in kept), *new.names])

    return rows.mapInArrow(run, schema)


def token_digests(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, by an encode and a decode of its whole text."""
    bounded_batches(spark)
    both = encode_decode(docs.select("doc_id", "text"), vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
