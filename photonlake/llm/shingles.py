"""Sets of word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from photonlake.llm import bytescan as B

_ODD = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1342543DE82EF95], np.uint64)
#: Words in a shingle.
WIDTH = len(_ODD)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text of fewer words is one shingle, an empty one none."""
    for first, end, data, offsets in B.slices(column, B.SHORT_SLICE_BYTES):
        hashes, bounds = B.word_hashes(data, offsets)
        n = len(hashes)
        rolled = np.zeros(max(0, n - WIDTH + 1), np.uint64)
        for k in range(WIDTH if len(rolled) else 0):
            rolled += hashes[k : k + len(rolled)] * _ODD[k]
        rolled = B.mix(rolled)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= WIDTH:
                yield np.unique(rolled[lo : hi - WIDTH + 1])
            elif hi > lo:
                whole = (hashes[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield B.mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch): set size, a 128-bit fingerprint of the set and its ``size`` smallest hashes.

    Hashes are ordered as signed longs, the order that Spark's own array functions use.
    """

    def run(batches):
        for batch in batches:
            ids, sets = batch.column(0), list(sets_of(batch.column(1)))
            sets = [np.sort(s.view(np.int64)) for s in sets]
            mixed = [B.mix(s.view(np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([m.sum(dtype=np.uint64) for m in mixed], np.uint64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(m * np.uint64(0xC2B2AE3D27D4EB4F) ^ (m >> np.uint64(29))) if len(m) else 0 for m in mixed], np.uint64).view(np.int64)),
                    _lists([s[:size].view(np.uint64) for s in sets]),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole set of each text."""

    def run(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, shingles array<bigint>")
