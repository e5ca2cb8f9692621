"""Collocations: frequent phrases of two to five words of each language, by sorted suffixes.

1. A first scan counts words and pairs of words in buckets, whose number grows with the text. A bucket's count is at least
   that of each word or pair in it, so what lies in a bucket below the threshold is rare for certain. A block of texts sends
   the buckets it touches, by parts of the buckets. Pairs and triples are also counted in few buckets, to find very common ones.
2. A second scan counts the words that are left; those that are frequent get numbers, one for all tasks. A third takes a suffix
   at every word: the words from there to the end of its piece, five at most, up to the first rare
   word or pair. Equal suffixes of a block of texts are one with a weight. Suffixes are routed by language and their first
   two words, those of very common pairs by three, of very common triples by all. A block sends each shard one packed, sorted row
   of numbers: texts of words would be most of it, as more shards share fewer of them.
3. Each shard sorts pointers to its suffixes by a multikey three-way quicksort, down to the fifth word. The weight of a
   partition of equal words is the count of that phrase; partitions below the threshold are abandoned, but for beginnings
   shorter than what a suffix was routed by, whose counts are partial and added up.
4. Joins of the counts score every cut of a candidate.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm import bytescan as B
from photonlake.llm.storage import Scratch, bounded_batches

_U = np.uint64
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Buckets of a part, which one task adds up.
_PART_BITS = 20
_PART = 1 << _PART_BITS
_MOST_BITS = 30
_NONE = pa.array([None], pa.string()), pa.array([None], pa.int64())


class Tokens:
    """Words of a block of texts: ids in a dictionary, languages, and which follow the one before in its piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        first, end, data, offsets = next(B.slices(text, 1 << 62))
        inside = ~(_BLANK | _BREAK)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        row = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] if len(data) else starts
        sizes = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=sizes[1:])
        flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(B.lower(data[inside]))).dictionary_encode()
        codes = lang.dictionary_encode()
        self.words, self.ids = flat.dictionary, flat.indices.to_numpy()
        self.langs, self.lang = codes.dictionary, codes.indices.to_numpy()[row]
        self.follows = np.zeros(len(starts), bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])

    def hashed(self) -> None:
        """Hashes of every word, and of every word with the one and the two after it."""
        _, _, data, offsets = next(B.slices(self.words, 1 << 62))
        self.own, _ = B.word_hashes(data, offsets)
        tongue = B.mix(np.array([zlib.crc32(x.encode()) for x in self.langs.to_pylist()], _U) + _U(1))
        self.one = B.mix(self.own[self.ids] + tongue[self.lang])
        after = np.append(self.one, np.zeros(2, _U))
        self.two = self.pair(self.one, after[1:-1])
        self.three = self.pair(self.two, after[2:])
        follows = np.append(self.follows, [False, False])
        self.has_two = follows[1:-1]
        self.has_three = self.has_two & follows[2:]

    @staticmethod
    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return B.mix(left * _U(0x9FB21C651E98DF25) + right)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64)


class Numbers:
    """Numbers of words, their places in a list without repeats."""

    def __init__(self, names: pa.Array):
        self.names = names
        _, _, data, offsets = next(B.slices(names, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        hashes = B.word_hashes(data, offsets)[0] if len(names) else np.zeros(0, _U)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.alone = bool((self.hashes[1:] != self.hashes[:-1]).all())

    def of(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it has none; by hashes, which are checked, unless two listed words share one."""
        if not self.alone or not len(self.names):
            return pc.fill_null(pc.index_in(words, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        return np.where(pc.equal(self.names.take(pa.array(at)), words).to_numpy(zero_copy_only=False), at, -1).astype(np.int32)


def _steps(rising: np.ndarray) -> bytes:
    """Rising numbers as the steps between them, byte by byte."""
    steps = np.diff(rising.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _summed(raw: bytes, n: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64)


def _parts(bits: int) -> int:
    return -(-(1 << bits) // _PART)


def _full(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _touched(at: np.ndarray, least: int, first: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed) of the buckets that ``at`` names: the steps between them, by bytes, and how often each, ``least`` at most. Parts count from ``first``."""
    at = np.sort(at.astype(np.uint32))
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    times = np.minimum(np.diff(np.append(begin, len(at))), least).astype(np.uint8 if least < 256 else np.int32)
    at = at[begin]
    part = at >> _PART_BITS
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield first + int(part[lo]), zstandard.compress(_steps(at[lo:hi] & np.uint32(_PART - 1)) + times[lo:hi].tobytes())


def _untouched(packed: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_touched`` packed: places in the part, and counts."""
    raw, kind = zstandard.decompress(packed), np.dtype(np.uint8 if least < 256 else np.int32)
    n = len(raw) // (4 + kind.itemsize)
    return _summed(raw, n), np.frombuffer(raw, kind, n, 4 * n)


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[Tokens]:
    """Tokens of blocks of about ``most`` bytes of (text, lang); a longer text is a block of its own."""
    held, size = [], 0

    def tokens():
        table = pa.Table.from_batches(held).combine_chunks()
        return Tokens(table.column(0).combine_chunks(), table.column(1).combine_chunks())

    for batch in batches:
        for part in (batch.slice(i, j - i) for i, j, _, _ in B.slices(batch.column(0), most)):
            held.append(part)
            size += part.column(0).nbytes
            if size >= most:
                yield tokens()
                held, size = [], 0
    if held:
        yield tokens()


def sort_suffixes(words: np.ndarray, weight: np.ndarray, least: int, whole: int = 1) -> Iterator[tuple[int, int, int]]:
    """(a row, depth, weight) of every prefix of the suffixes that weighs ``least`` or more.

    ``words`` has a column for the language and five for the words, -1 where a suffix has ended. Partitions are arrays of row
    numbers. Those that agree in ``whole`` words (all suffixes that begin with these are here) and weigh less than ``least`` are given up;
    shorter prefixes are told whatever they weigh. Small partitions are counted one by one.
    """
    todo = [(np.arange(len(words)), 0)]
    deepest = words.shape[1] - 1
    enough = lambda depth, n: depth < whole or n >= least
    while todo:
        rows, depth = todo.pop()
        if not len(rows) or not enough(depth, weight[rows].sum()):
            continue
        if len(rows) <= 16:
            seen, where = Counter(), {}
            for key, n, r in zip(map(tuple, words[rows].tolist()), weight[rows].tolist(), rows.tolist(), strict=True):
                for d in range(max(depth, 1), deepest + 1):
                    if key[d] < 0:
                        break
                    seen[key[: d + 1]] += n
                    where[key[: d + 1]] = r
            yield from ((where[k], len(k) - 1, n) for k, n in seen.items() if enough(len(k) - 1, n))
            continue
        value = words[rows, depth]
        pivot = np.sort(value[[0, len(value) // 2, -1]])[1]
        equal = rows[value == pivot]
        todo += [(rows[value < pivot], depth), (rows[value > pivot], depth)]
        if pivot >= 0:
            n = int(weight[equal].sum())
            if depth >= 1 and enough(depth, n):
                yield int(equal[0]), depth, n
            if depth < deepest and enough(depth + 1, n):
                todo.append((equal, depth + 1))


class Collocations:
    """Phrases of 2 to ``LONGEST`` words that occur ``least`` times or more in a language, and their scores.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at blanks and tabs into words. A null text
    is empty and a null language ``und``; repeated rows count as often as they stand there; other columns are not read.
    ``word_bits`` and ``pair_bits`` fix the numbers of buckets for ``TEXT`` bytes of text; for more they double as the text
    does, up to 2^30. A bit of each is broadcast. Were they full, fewer rare words
    and pairs would be left out before the routing, and results would be the same. A shard is
    meant for ``shard_words`` words; pairs and triples whose bucket (of ``common_bits``) counts more than ``hot`` go to several.
    """

    LONGEST = 5
    TEXT = 1 << 28

    def __init__(self, spark: SparkSession, least: int = 100, word_bits: int = 20, pair_bits: int = 22, common_bits: int = 16, shard_words: int = 2_000_000, hot: int = 400_000):
        self.spark, self.least, self.bits, self.shard_words, self.hot = spark, least, (word_bits, pair_bits, common_bits), shard_words, hot
        self.scratch = Scratch(spark, "phrases")
        bounded_batches(spark)

    def counts(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lang, phrase, k, count) of words and phrases that occur ``least`` times, and (lang, n) of all words."""
        texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
        size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        more = max(0, math.ceil(math.log2(max(1, size) / self.TEXT)))
        bits = (*(max(b, min(_MOST_BITS, b + more)) for b in self.bits[:2]), self.bits[2])
        merged = self.scratch.table(self._merged(self._sketched(texts, bits)), "merged")
        totals = self.scratch.table(merged.filter("block is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        words = totals.agg(F.sum("n")).first()[0] or 0
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), words // self.shard_words)
        held = self.spark.sparkContext.broadcast(self._buckets(merged, bits))
        words = self._words(texts, held, bits).groupBy("lang", "phrase").agg(F.sum("count").alias("count")).filter(F.col("count") >= self.least)
        words = self.scratch.table(words, "words")
        names = words.select("phrase").distinct().toArrow().column(0).combine_chunks()
        names = self.spark.sparkContext.broadcast(names.cast(pa.string()))
        packed = self._packed(texts, held, names, bits, shards)
        partial = self._sorted(packed.repartitionById(shards, F.col("shard")), names)
        phrases = partial.groupBy("lang", "phrase", "k").agg(F.sum("count").alias("count")).filter(F.col("count") >= self.least)
        counts = self.scratch.table(phrases.unionByName(words.withColumn("k", F.lit(1))), "counts")
        return counts, totals

    def _sketched(self, texts: DataFrame, bits: tuple[int, int, int]) -> DataFrame:
        """(block, part, lang, n): a block of texts' counts by parts of the buckets of words and pairs (``_touched``), a task's of common ones, and its words by language."""
        least = self.least

        def run(batches):
            common = np.zeros(1 << bits[2], np.int64)
            n: Counter[str] = Counter()
            for t in _blocks(batches):
                if not len(t.ids):
                    continue
                t.hashed()
                for first, h, width in ((0, t.one, bits[0]), (_parts(bits[0]), t.two[t.has_two], bits[1])):
                    found = list(_touched(_bucket(h, width), least, first))
                    if found:
                        blocks, parts = zip(*found, strict=True)
                        nulls = pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary()), *nulls], names=["block", "part", "lang", "n"])
                for h in (t.two[t.has_two], t.three[t.has_three]):
                    common += np.bincount(_bucket(h, bits[2]), minlength=len(common))
                n.update(dict(zip(t.langs.to_pylist(), np.bincount(t.lang, minlength=len(t.langs)).tolist(), strict=True)))
            if common.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([zstandard.compress(common.tobytes())]), *_NONE], names=["block", "part", "lang", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(n), pa.int32()), pa.array([None] * len(n), pa.binary()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["block", "part", "lang", "n"])

        return texts.mapInArrow(run, "block int, part binary, lang string, n bigint")

    def _merged(self, sketched: DataFrame) -> DataFrame:
        """(block, part, lang, n): for each part of the buckets the bits that say which reach ``least``, or are very common; words by language pass.

        A worker adds the counts of one block after the other and holds the sums of its parts.
        """
        least, hot = self.least, self.hot

        def run(batches):
            held: dict[int, np.ndarray] = {}
            n: Counter[str] = Counter()
            for batch in batches:
                for block, part, lang, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block is None:
                        n[lang] += words
                    elif block < 0:
                        one = np.frombuffer(zstandard.decompress(part), np.int64)
                        held[block] = held[block] + one if block in held else one
                    else:
                        at, times = _untouched(part, least)
                        total = held.setdefault(block, np.zeros(_PART, np.uint8 if least < 256 else np.int32))
                        total[at] = np.minimum(total[at].astype(np.int64) + times, least)
            rows = [(k, zstandard.compress(np.packbits(v > hot if k < 0 else v >= least, bitorder="little").tobytes()), None, None) for k, v in held.items()] + [(None, None, lang, words) for lang, words in n.items()]
            types = (pa.int32(), pa.binary(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "part", "lang", "n"])

        return sketched.repartition(F.coalesce(F.col("block").cast("bigint"), F.xxhash64("lang"))).mapInArrow(run, "block int, part binary, lang string, n bigint")

    def _buckets(self, merged: DataFrame, bits: tuple[int, int, int]) -> list[np.ndarray]:
        """Packed bits: one for every bucket of words, of pairs, and of common pairs and triples."""
        out = [np.zeros(-(-(1 << b) // 8), np.uint8) for b in bits]
        for r in merged.filter("block is not null").select("block", "part").collect():
            part = np.frombuffer(zstandard.decompress(r["part"]), np.uint8)
            into, at = (out[2], 0) if r["block"] < 0 else (out[0], r["block"]) if r["block"] < _parts(bits[0]) else (out[1], r["block"] - _parts(bits[0]))
            lo = at * (_PART // 8)
            into[lo : lo + len(part)] = part[: len(into) - lo]
        return out

    def _words(self, texts: DataFrame, held, bits: tuple[int, int, int]) -> DataFrame:
        """(lang, phrase, count) of the words of each block that are not rare for certain."""

        def run(batches):
            for t in _blocks(batches):
                if not len(t.ids):
                    continue
                t.hashed()
                usable = _full(held.value[0], _bucket(t.one, bits[0]))
                times = np.bincount((t.lang.astype(np.int64) * len(t.words) + t.ids)[usable], minlength=1)
                at = np.flatnonzero(times)
                tongue, word = (pa.array(x) for x in np.divmod(at, len(t.words)))
                yield pa.RecordBatch.from_arrays([t.langs.take(tongue), t.words.take(word), pa.array(times[at])], names=["lang", "phrase", "count"])

        return texts.mapInArrow(run, "lang string, phrase string, count bigint")

    def _packed(self, texts: DataFrame, held, names, bits: tuple[int, int, int], shards: int) -> DataFrame:
        """(shard, langs, suffixes): the distinct suffixes of a block for a shard, with weights.

        ``suffixes`` has the words' numbers once, by steps, and the suffixes by the places of their words among these.
        """
        longest = self.LONGEST

        def run(batches):
            frequent_words, frequent_pairs, often = held.value
            numbers = Numbers(names.value)
            for t in _blocks(batches):
                if not len(t.ids):
                    continue
                t.hashed()
                ids, n = numbers.of(t.words, t.own)[t.ids], len(t.ids)
                usable = (ids >= 0) & _full(frequent_words, _bucket(t.one, bits[0]))
                joined = np.zeros(n + longest, bool)  # whether a word goes on from the one before
                joined[1:n] = (t.has_two & _full(frequent_pairs, _bucket(t.two, bits[1])))[:-1] & usable[1:] & usable[:-1]
                alive, depth = usable.copy(), usable.astype(np.int32)
                for j in range(1, longest):
                    alive &= joined[j : j + n]
                    depth += alive
                # Suffixes of two words and more, routed by two, by three or by all.
                start = np.flatnonzero(depth > 1)
                d = depth[start]
                often_two = _full(often, _bucket(t.two[start], bits[2]))
                three = (d > 2) & often_two
                whole = three & _full(often, _bucket(t.three[start], bits[2]))
                lead, padded = np.where(three, t.three[start], t.two[start]), np.append(t.one, np.zeros(longest, _U))
                for j in range(3, longest):
                    lead = np.where(whole & (d > j), t.pair(lead, padded[start + j]), lead)
                by = np.where(often_two, np.where(whole, longest, 3), 2)
                ids = np.append(ids, np.full(longest, -1, ids.dtype))
                columns = {"shard": (B.mix(lead) % _U(shards)).astype(np.int32), "by": by.astype(np.int32), "lang": t.lang[start]} | {f"w{j}": np.where(d > j, ids[start + j], -1) for j in range(longest)}
                same = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
                table = np.stack([same.column(c).to_numpy().astype(np.int32) for c in [*columns, "count_all"]], axis=1)
                table = table[np.lexsort([*(table[:, 3 + j] for j in range(longest - 1, -1, -1)), table[:, 0]])]
                cuts = np.append(np.flatnonzero(np.diff(table[:, 0], prepend=-1)), len(table))
                tongues, out = t.langs.to_pylist(), ([], [])
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = table[lo:hi, 1:]
                    used = np.unique(part[:, 2 : 2 + longest])
                    part[:, 2 : 2 + longest] = np.searchsorted(used, part[:, 2 : 2 + longest]) - (used[0] < 0)
                    used = used[used >= 0]
                    small = part.max() < 32768  # places and weights mostly fit two bytes
                    payload = _steps(used) + np.ascontiguousarray(part.T.astype(np.int16 if small else np.int32)).tobytes()
                    out[0].append(int(table[lo, 0]))
                    out[1].append((b"s" if small else b"l") + len(used).to_bytes(4, "little") + zstandard.compress(payload, 9))
                langs = pa.array([tongues] * len(out[0]), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), langs, pa.array(out[1], pa.binary())], names=["shard", "langs", "suffixes"])

        return texts.mapInArrow(run, "shard int, langs array<string>, suffixes binary")

    def _sorted(self, packed: DataFrame, names) -> DataFrame:
        """(lang, phrase, k, count) of the phrases of two words and more of each shard; those of several shards are partial."""
        least, longest = self.least, self.LONGEST

        def run(batches):
            langs, tables = [], []
            for batch in batches:
                for r in range(batch.num_rows):
                    langs.append(batch.column(1)[r].values)
                    one = batch.column(2)[r].as_py()
                    n, raw = int.from_bytes(one[1:5], "little"), zstandard.decompress(one[5:])
                    tables.append((_summed(raw, n).astype(np.int32), np.frombuffer(raw, np.int16 if one[:1] == b"s" else np.int32, offset=4 * n).reshape(longest + 3, -1)))
            if not tables:
                return
            flat = pa.concat_arrays(langs).dictionary_encode()
            tongues, of_lang = flat.dictionary, np.split(flat.indices.to_numpy(), np.cumsum([len(p) for p in langs])[:-1])
            sizes = [t.shape[1] for _, t in tables]
            matrix, weight, by = np.empty((sum(sizes), longest + 1), np.int32), np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int8)
            at = 0
            for (used, t), size, own_lang in zip(tables, sizes, of_lang, strict=True):
                here = slice(at, at + size)
                by[here], weight[here], matrix[here, 0] = t[0], t[-1], own_lang[t[1]]
                matrix[here, 1:] = np.where(t[2:-1] < 0, -1, used[np.maximum(t[2:-1], 0)]).T
                at += size
            tables.clear()
            for whole in np.unique(by).tolist():
                mine = np.flatnonzero(by == whole)
                # Single words are counted by themselves; the first words of suffixes count for nothing.
                found = [f for f in sort_suffixes(matrix[mine], weight[mine], least, whole) if f[1] > 1]
                for lo in range(0, len(found), 1 << 16):
                    row, k, n = (np.array(c, np.int64) for c in zip(*found[lo : lo + (1 << 16)], strict=True))
                    row = mine[row]
                    spelt = names.value.take(pa.array(matrix[row, 1:].ravel(), mask=matrix[row, 1:].ravel() < 0)).to_pylist()
                    text = [" ".join(spelt[longest * i : longest * i + d]) for i, d in enumerate(k.tolist())]
                    yield pa.RecordBatch.from_arrays([tongues.take(pa.array(matrix[row, 0])), pa.array(text, pa.string()), pa.array(k.astype(np.int32)), pa.array(n)], names=["lang", "phrase", "k", "count"])

        return packed.mapInArrow(run, "lang string, phrase string, k int, count bigint")

    def run(self, docs: DataFrame, top: int = 2000) -> DataFrame:
        """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
        counts, totals = self.counts(docs)
        candidates = counts.filter("k > 1").select("lang", "phrase", "k", F.col("count").alias("a"))
        best = self._best_cuts(candidates, counts, totals)
        inner = [F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")]
        # A longer phrase as frequent as one inside it implies one that is longer by a single word.
        inside = candidates.filter("k > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("a").alias("longer"))
        covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = best.join(covered, ["lang", "phrase"], "left").filter("longer is null or longer < a")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

    def _best_cuts(self, candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
        """(lang, phrase, a, l, r, n, score) at the lowest-scoring cut of each candidate."""
        cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
        cuts = candidates.select("lang", "phrase", "k", "a", cut)
        cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
        left = counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l"))
        right = counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
        met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals) if self._few(totals) else totals, "lang")

        @F.pandas_udf("bigint")
        def score(a, n, l, r):  # noqa: E741
            return pd.Series([1000 * int(w) * int(x) // (int(y) * int(z)) for w, x, y, z in zip(a, n, l, r, strict=True)], dtype="int64")

        scored = met.withColumn("score", score("a", "n", "l", "r"))
        least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
        return least.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")

    @staticmethod
    def _few(totals: DataFrame) -> bool:
        return totals.limit(10_001).count() <= 10_000


def phrase_collocations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return Collocations(spark).run(docs)


SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts)
), totals as (
  select lang, sum(len(w))::bigint as n from pieces group by lang
), counts as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as c
  from pieces, lateral (select unnest(range(1, len(w) + 1)) as i), (select unnest(range(1, 6)) as k) ks where i + k - 1 <= len(w) group by all having count(*) >= 100
), candidates as (
  select lang, phrase, k, c as a, string_split(phrase, ' ') as w from counts where k > 1
), cuts as (
  select d.lang, d.phrase, d.a, x.c as l, y.c as r, n, cut, 1000::hugeint * d.a * n // (x.c::hugeint * y.c) as score
  from (select *, unnest(range(1, k)) as cut from candidates) d
  join counts x on x.lang = d.lang and x.phrase = array_to_string(d.w[1:cut], ' ')
  join counts y on y.lang = d.lang and y.phrase = array_to_string(d.w[cut + 1:], ' ')
  join totals t on t.lang = d.lang
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
  from candidates, lateral (select unnest(range(2, k)) as m), lateral (select unnest(range(1, k - m + 2)) as i) group by all
), kept as (
  select best.* from best left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
