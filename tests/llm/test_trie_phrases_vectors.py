"""Prefix trie, collocations and near-duplicate vectors against brute force, and on odd tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photonlake.llm.bytescan import slices, word_hashes
from photonlake.llm.embedding_dedup import GraphNearDuplicates, build_graph, medoid
from photonlake.llm.phrases import Collocations, Numbers, _touched, _untouched, sort_suffixes
from photonlake.llm.prefix_trie import PrefixTrie, Skeleton, conversation_trie, conversation_turns

TALK = "conv_id bigint, turn bigint, role string, text string, shard int, path string, part int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TALK)


def trie_of(rows):
    """The contract, read literally."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 180), 305, 306, -100, -101, -7]:
        for turn in range(rng.integers(1, 8)):
            rows.append((c, turn, ["user", "assistant", None][rng.integers(3)], [None, "", "ha", "Äö€", "long " * 50][rng.integers(5)]))
    rows += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    rows += [(7, None, "system", "first"), (7, None, "system", "first"), (None, 1, "user", "lost"), (8, 2, "user", "tie"), (8, 2, "user", "tie")]
    rows += [(400, t, "user", f"t{t}") for t in range(90)] + [(401, t, "user", f"t{t}") for t in range(95)]
    return [tuple(int(x) if isinstance(x, np.integer) else x for x in r) for r in rows]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_equals_brute_force(spark, shards):
    rows = conversations(shards)
    got = conversation_trie(spark, talk(spark, rows), shards).collect()
    assert sorted(str(tuple(r)) for r in got) == trie_of(rows)


def test_trie_of_odd_tables(spark):
    assert conversation_trie(spark, talk(spark, []), 3).count() == 0
    assert conversation_trie(spark, talk(spark, [(None, 1, "user", "x")]), 3).count() == 0
    one = conversation_trie(spark, talk(spark, [(3, 0, None, None)]), 3).collect()  # its first turns would be those of conversation 0
    assert [(r.conv_id, r.depth, r.n_convs) for r in one] == [(3, 0, 1)]
    turns = conversation_turns(talk(spark, conversations(9)))
    rows = PrefixTrie(spark, shards=5, deepest=2).run(turns).collect()
    assert sum(r.depth == 0 for r in rows) == 1 and max(r.depth for r in rows) == 95


def test_skeleton_holds_every_prefix_of_its_splitters():
    path = lambda *k: b"".join(bytes([i]) * 16 for i in k)
    s = Skeleton.of([(path(1, 2), 1), (path(1, 3), 2), (path(2), 3), (path(), 4)], 4)
    assert len(s.splitters) == 3 and all(s.shard(*x) == i + 1 for i, x in enumerate(s.splitters))
    assert {r[1] for r in s.rows()} <= {0, 1, 2} and s.rows()[0] == (0, 0, None, [0])


def counted(texts, least):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    return n, {k: v for k, v in f.items() if v >= least}


def collocations(texts, least, top):
    n, f = counted(texts, least)
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [v for (x, u), v in f.items() if x == lang and len(u) > len(w) and any(u[i : i + len(w)] == w for i in range(len(u)))]
        if not any(100 * v >= 100 * a for v in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


DOCS = "doc_id bigint, text string, lang string, route bigint, part int, phrase string, k int"


@pytest.mark.parametrize(("bits", "hot"), [(16, 400_000), (4, 1), (8, 30)])
def test_collocations_equal_brute_force(spark, bits, hot):
    """With many buckets and with so few that all collide; with pairs dealt to several tasks."""
    rng = np.random.default_rng(bits)
    vocabulary = ["the", "The", "of", "Ä", "é", "a b", "x-y", "w" * 300, *[f"r{i}" for i in range(60)]]
    texts = [None, "", " \t ", "...", "A", "the of " * 3000]
    for _ in range(300):
        weights = 1 / np.arange(1, len(vocabulary) + 1)
        words = rng.choice(vocabulary, rng.integers(1, 60), p=weights / weights.sum())
        texts.append("".join(w + [" ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"][rng.choice(8, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.02, 0.03])] for w in words))
    texts += ["one large group of copies says this"] * 200
    rows = [([None, "und", "en", "de", ""][rng.integers(5)], t) for t in texts]
    docs = spark.createDataFrame([(i, t, g, 1, 2, "p", 3) for i, (g, t) in enumerate(rows)], DOCS)
    got = Collocations(spark, least=8, word_bits=bits, pair_bits=bits, common_bits=min(bits, 12), hot=hot, shard_words=500).run(docs, top=40).collect()
    assert {tuple(r) for r in got} == collocations(rows, 8, 40) and len(got) > 60


class Routed(Collocations):
    """Notes the bytes of suffixes that are routed."""

    def _sorted(self, packed, *more):
        self.bytes = packed.agg(F.sum(F.length("suffixes"))).first()[0]
        self.strings = [c for c, kind in packed.dtypes if "string" in kind]
        return super()._sorted(packed, *more)


def test_buckets_grow_with_the_text(spark, monkeypatch):
    """Many times the text that the buckets are meant for, most of it rare: what is routed is not more than with many buckets."""
    rng = np.random.default_rng(11)
    rows = [("en", " ".join(f"w{i}" for i in rng.zipf(1.25, 400).clip(max=200_000).tolist())) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, g, 1, 2, "p", 3) for i, (g, t) in enumerate(rows)], DOCS)
    wide = Routed(spark, least=10, word_bits=20, pair_bits=22)
    want = {tuple(r) for r in wide.run(docs, top=50).collect()}
    monkeypatch.setattr(Collocations, "TEXT", 1 << 10, raising=False)
    small = Routed(spark, least=10, word_bits=6, pair_bits=7)
    assert {tuple(r) for r in small.run(docs, top=50).collect()} == want == collocations(rows, 10, 50)
    assert small.bytes < 1.5 * wide.bytes and small.strings == ["langs"]


def test_numbers_of_words():
    names = pa.array(["b", "x" * 300, "Ä", "a-b"])
    words = pa.array(["Ä", "c", "b", "x" * 300, "x" * 301, "a-b", "zz"])
    for numbers in (Numbers(names), Numbers(names[:0])):
        _, _, data, offsets = next(slices(words, 1 << 62))
        hashes, _ = word_hashes(data, offsets)
        want = [numbers.names.to_pylist().index(w) if w in numbers.names.to_pylist() else -1 for w in words.to_pylist()]
        assert numbers.of(words, hashes).tolist() == want
        numbers.alone = False
        assert numbers.of(words, hashes).tolist() == want


@pytest.mark.parametrize("least", [3, 100, 1000])
def test_touched_buckets_are_told_by_parts(least):
    rng = np.random.default_rng(least)
    at = np.concatenate([rng.integers(0, 5 << 20, 5000), np.full(1500, 7), [0, (5 << 20) - 1, 1 << 20]])
    got = collections.Counter()
    for part, packed in _touched(at, least, 40):
        places, times = _untouched(packed, least)
        got.update({((part - 40) << 20) + p: n for p, n in zip(places.tolist(), times.tolist(), strict=True)})
    assert got == {k: min(n, least) for k, n in collections.Counter(at.tolist()).items()}
    assert not list(_touched(at[:0], least, 0))


def test_collocations_of_an_empty_table(spark):
    for rows in ([], [(1, None, None, 1, 2, "p", 3)]):
        assert Collocations(spark).run(spark.createDataFrame(rows, DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_007
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2)], "lang string, phrase string, k int, count bigint")
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, n bigint")
    c = Collocations(spark)
    r = c._best_cuts(counts.filter("k > 1").withColumnRenamed("count", "a"), counts, totals).collect()[0]
    assert r.score == 1000 * big * 7 * big // ((big + 1) * (big + 2)) and (r.l, r.r) == (big + 1, big + 2)


def test_sorted_suffixes_count_prefixes():
    rng = np.random.default_rng(2)
    words = np.full((900, 6), -1, np.int32)
    words[:, 0] = rng.integers(0, 2, 900)
    for i, d in enumerate(rng.integers(1, 6, 900)):
        words[i, 1 : d + 1] = rng.integers(0, 3, d)
    weight = rng.integers(1, 5, 900)
    want = collections.Counter()
    for row, w in zip(words.tolist(), weight.tolist(), strict=True):
        for d in range(1, 6):
            if row[d] >= 0:
                want[tuple(row[: d + 1])] += w
    for least, whole in ((1, 1), (30, 1), (30, 2), (30, 3), (30, 5)):
        got = {tuple(words[r, : d + 1].tolist()): n for r, d, n in sort_suffixes(words, weight, least, whole)}
        assert got == {k: n for k, n in want.items() if n >= least or len(k) <= whole}


VECTORS = "vec_id bigint, embedding array<float>, label int, cid bigint, rep int, n int, cluster int"


def near_vectors(rows, threshold=0.93):
    """(n_links, component) of each row by all pairs."""
    good = [i for i, (k, v, g) in enumerate(rows) if k is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = collections.Counter()
    for a, i in enumerate(good):
        for j in good[:a]:
            (_, v, g), (_, w, h) = rows[i], rows[j]
            if g == h and len(v) == len(w):
                x, y = np.asarray(v, np.float32).astype(float), np.asarray(w, np.float32).astype(float)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    by = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            root[find(i)] = find(by.setdefault(k, i))
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), links[i], str(least.get(find(i)) if k is not None else None)) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize(("shard", "most", "whole"), [(1024, 16384, True), (192, 16384, True), (48, 16384, False), (16, 2, False)])
def test_near_vectors_equal_brute_force(spark, shard, most, whole):
    """In one part a label, in several clusters, in clusters smaller than the groups, and in clusters that are cut into parts."""
    rng = np.random.default_rng(shard)
    rows = []
    for group in range(12):
        center = rng.normal(size=16)
        for _ in range([90, 25, 3][group % 3]):
            rows.append((len(rows), (center + rng.normal(size=16) * 0.12).tolist(), group % 2))
    rows += [(len(rows) + i, rng.normal(size=16).tolist(), 0) for i in range(80)]
    base = rows[0][1]
    rows += [(900 + i, base, 0) for i in range(30)] + [(930, base, 1), (931, base, None), (932, base[:8], 0), (933, None, 0), (934, [], 0), (935, [0.0] * 16, 0)]
    rows += [(936, [float("nan"), *base[1:]], 0), (937, [None, *base[1:]], 0), (938, [float("inf"), *base[1:]], 0), (None, base, 0), (940, [-0.0, 1.0], 7), (941, [0.0, 2.0], 7)]
    far = rng.normal(size=16).tolist()
    rows += [(950, base, 0), (950, far, 0), (960, far, 0), (950, None, 0), (951, far, 0), (951, far, 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)
    op = GraphNearDuplicates(spark, shard_rows=shard, most_shards=most)
    got = op.run(df).collect()
    assert op.recall >= 0.97
    got_rows, want = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got), near_vectors(rows)
    assert [r[0] for r in got_rows] == [r[0] for r in want]
    if whole:
        assert got_rows == want
    assert sum(r[1] for r in got_rows) >= 0.97 * sum(r[1] for r in want) and sum(r[1] for r in got_rows) <= sum(r[1] for r in want)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert {r.component_id for r in got if r.vec_id in (950, 960, 951)} == {0}


def test_near_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], VECTORS)
    assert GraphNearDuplicates(spark).run(df).count() == 0
    assert GraphNearDuplicates(spark).run(spark.createDataFrame([(5, None, 1, 1, 2, 3, 4)], VECTORS)).collect()[0].component_id == 5


def test_graph_can_be_walked_from_its_medoid():
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(120, 8)) * 0.01 for c in rng.normal(size=(5, 8))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lists = build_graph(x, 8)
    seen, todo = set(), [medoid(x)]
    while todo:
        node = todo.pop()
        if node not in seen:
            seen.add(node)
            todo += lists[node].tolist()
    assert len(seen) == len(x)
    assert build_graph(x[:1], 8)[0].size == 0
