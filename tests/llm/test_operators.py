"""Operators against brute force, and on odd tables: nulls, empty tables and texts, ties, repeats, clashing columns."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.llm import language, line_dedup, mixing, queries, rans, token_counts, toxicity
from photonlake.llm.ann import CentroidGraph, PostingSearch, lists_in_reach
from photonlake.llm.near_dup import NearDuplicates
from photonlake.llm.storage import Scratch
from photonlake.llm.topk import PivotSearch, products

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, component string, removed int, mark string"


def table(spark, rows):
    full = [(*r, *[None] * (5 - len(r)), "x", "y", 7, "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions in deep silent woods near old stone towers".split()
BASE = " ".join(WORDS * 3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty texts, exact and near copies, ties, repeated ids and rows."""
    near = BASE.replace("wizards", "sorcerers", 1)
    return table(
        spark,
        [(1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, near, "en", "b"), (4, "", "en", "b"), (5, None, None, None), (6, "   \n\t ", "de", ""), (None, BASE, "en", "a"), (8, "one two", "en", "a"), (9, "One  TWO", "en", "c"), (9, "One  TWO", "en", "c"), (10, "word " * 3000, "en", "a"), (11, "ÄÖ Ü", "de", "d")],
    )


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_near_duplicates_on_odd_rows(spark, odd, nothing):
    got = NearDuplicates(spark).run(odd).collect()
    assert len(got) == 12
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert {r[1] for i in (1, 2, 3) for r in by[i]} == {1}
    assert by[4] == {(0, 4, True)} and by[5] == {(0, 5, True)} and by[6] == {(0, 6, True)}
    assert by[8] == {(1, 8, True)} and by[9] == {(1, 8, False)}
    assert {r[1] for r in by[None]} == {None}
    assert NearDuplicates(spark).run(nothing).count() == 0


def test_near_duplicates_belong_together_by_id(spark):
    """An id with two unlike texts connects what either is linked with; its empty rows go with it."""
    other = " ".join(f"u{i}" for i in range(40))
    df = table(spark, [(3, BASE, "en", "a"), (5, BASE, "en", "a"), (5, other, "en", "a"), (9, other, "en", "a"), (9, "", "en", "a"), (11, "", "en", "a"), (11, None, "en", "a")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in NearDuplicates(spark).run(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (11, 11, True), (11, 11, True)]


def test_near_duplicates_exactly_at_the_threshold(spark):
    """Whole sets in place of sketches: pairs that share exactly three quarters of their shingles, and those that just do not."""
    words = [f"v{i}" for i in range(600)]
    docs = []
    for n in range(12, 212, 8):  # the two texts of a pair share their first n shingles of n + n / 6 each: 6 n / 8 n
        extra = n // 6
        if n % 6 == 0:
            docs += [(len(docs), " ".join([f"p{n}"] + words[: n + 3] + [f"a{n}x{i}" for i in range(extra - 1)])), (len(docs) + 1, " ".join([f"p{n}"] + words[: n + 3] + [f"b{n}x{i}" for i in range(extra - 1 + n // 96)]))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in NearDuplicates(spark, exact=True).run(table(spark, docs)).collect()}
    assert got == {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = []
    for g in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(6, 120))]
        for _ in range(rng.integers(1, 40)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = f"w{rng.integers(400)}"
            docs.append(" ".join(copy))
    docs += ["shared passage of exactly seven words here " + " ".join(f"u{rng.integers(10**6)}" for _ in range(30)) for _ in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for short in (4, 24):  # with almost all lists long, and with few
        got = {r.doc_id: r.component_id for r in NearDuplicates(spark, long_list=short).run(table(spark, list(enumerate(docs)))).collect()}
        assert got == {i: find(i) for i in range(len(docs))}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    lines = ["".join(rng.choice(list("abcd "), rng.integers(10, 90))).strip() + "." for _ in range(40)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.integers(1, 6)):
            x = list(lines[rng.integers(len(lines))])
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(len(x))
                x[at : at + rng.integers(0, 2)] = rng.choice(list("xyz"))
            own.append("".join(x))
        texts.append("\n".join(own))
    for how in ({"long_list": 2, "block": 3}, {"long_list": 24}, {"long_list": 10**6, "block": 2}):
        got = {r.doc_id: r.removed_lines for r in line_dedup.LineDedup(spark, **how).run(table(spark, list(enumerate(texts)))).collect()}
        seen, places = {}, collections.defaultdict(list)
        for i, t in enumerate(texts):
            for j, line in enumerate(t.split("\n")):
                if line.strip(" \t\r\x0b\x0c"):
                    places[seen.setdefault(line.strip(" \t\r\x0b\x0c"), len(seen))].append((i, j))
        names, root = list(seen), list(range(len(seen)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(range(len(names)), 2):
            short = min(len(names[a]), len(names[b]))
            if edit(names[a], names[b]) <= (2 if short >= 64 else 1 if short >= 24 else 0):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        groups = collections.defaultdict(list)
        for k, where in places.items():
            groups[find(k)] += where
        want = collections.defaultdict(list)
        for where in groups.values():
            for i, j in sorted(where)[1:]:
                want[i].append(j)
        assert {i: sorted(x) for i, x in got.items() if x} == {i: sorted(x) for i, x in want.items()}


def test_bit_parallel_edits_equal_plain_ones(spark):
    rng = np.random.default_rng(9)
    rows = [("", ""), ("a", ""), ("", "abc"), ("ab", "ba"), ("abcd", "bcda"), ("é" * 70, "é" * 69 + "x"), ("x" * 5000 + "y", "x" * 5000), ("abc", "abc")]
    for _ in range(1500):
        a = "".join(rng.choice(list("abé"), rng.integers(0, 30)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            at = rng.integers(len(b) + 1)
            b[at : at + rng.integers(0, 2)] = rng.choice(list("abé"), rng.integers(0, 2))
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edits(F.col("a"), F.col("b")).alias("n"))
    for r in got.collect():
        if max(len(r.a), len(r.b)) < 100:
            assert r.n == min(3, edit(r.a, r.b)), (r.a, r.b)
        else:
            assert r.n == 1


def test_line_dedup_of_a_template(spark):
    """Many distinct lines share segments; only those with few edits fall together."""
    rng = np.random.default_rng(10)
    head, tail = "this notice belongs to the work number", "and must stay with every copy of it that is given away"
    middles = ["".join(rng.choice(list("0123456789"), 30)) for _ in range(300)]
    lines = [f"{head} {m} {tail}" for m in middles] + [f"{head} {m[:7]}x{m[8:]} {tail[:-1]}" for m in middles[:40]]
    out = line_dedup.LineDedup(spark).run(table(spark, list(enumerate(lines)))).collect()
    assert {r.doc_id for r in out if r.removed_lines} == set(range(300, 340))


def test_line_dedup_on_odd_rows(spark, odd, nothing):
    out = line_dedup.LineDedup(spark).run(odd)
    rows = out.collect()
    assert len(rows) == 12 and set(odd.columns) <= set(out.columns)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text == BASE and by[2][0].text == "" and by[2][0].removed_lines == [0]
    assert by[5][0].text is None and by[5][0].n_lines == 0
    assert by[4][0].text == "" and by[6][0].text == "   \n\t "
    assert by[1][0].id == "x" and by[1][0].removed == 7
    assert line_dedup.LineDedup(spark).run(nothing).count() == 0


def test_mix_on_odd_rows(spark, odd, nothing):
    plan = mixing.Mixture(spark).plan(odd).collect()
    assert len(plan) == 12
    assert all(len(r.shards) <= 3 and all(0 <= s < 16 for s in r.shards) for r in plan)
    total = sum(r["size"] for r in plan)
    assert sum({(r.source_size, r.target): r.target for r in plan}.values()) == pytest.approx(total, rel=0.5)
    drawn = mixing.Mixture(spark).draw(odd)
    assert drawn.columns == [*odd.columns, "mix_shard", "mix_order"]
    assert drawn.count() == sum(len(r.shards) for r in plan)
    assert mixing.Mixture(spark).plan(nothing).count() == 0
    assert mixing.Mixture(spark).plan(odd.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("target")).first()[0] == 0


def test_mix_is_exact_and_repeats(spark):
    docs = table(spark, [(i, "w " * (1 + i % 5), "en", f"s{i % 7}") for i in range(3000)])
    a, b = (sorted((r.doc_id, tuple(r.shards)) for r in mixing.Mixture(spark).plan(docs).collect()) for _ in range(2))
    assert a == b
    m = mixing.mixed(spark, docs.withColumn("k", F.col("source"))).collect()
    taken, target = collections.Counter(), {}
    for r in m:
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
        assert r.taken <= 3 * r["size"]
    for key, t in target.items():
        n = sum(1 for r in m if (r.source_size, r.target) == key) / (key[0] and 3000 / 7)
        assert abs(taken[key] - t * round(n)) <= 3 * max(1, round(n))


def test_splitting_is_exact_and_spreads(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 1)], "skey string, q bigint")
    dealt = mixing.split_quotas(quotas, 3, 5).collect()
    assert {k: sum(r.blocks for r in dealt if r.skey == k) for k in "abcd"} == {"a": 1000, "b": 37, "c": 0, "d": 1}
    shards = [sum(r.blocks for r in dealt if r.shard == s) for s in range(8)]
    assert max(shards) - min(shards) <= 3
    u = spark.range(4000).select(mixing.hypergeometric(F.lit(60).cast("bigint"), F.lit(24).cast("bigint"), F.lit(20).cast("bigint"), (F.col("id") + 0.5) / 4000).alias("k"))
    mean, var = u.agg(F.avg("k"), F.var_pop("k")).first()
    assert mean == pytest.approx(8, abs=0.01) and var == pytest.approx(20 * 0.4 * 0.6 * 40 / 59, abs=0.03)


def test_shards_get_the_blocks_that_the_tree_drew(spark):
    """Every draw of a block lies in the shard whose stretch of the source's permutation holds it, as many as were drawn for that shard."""
    docs = table(spark, [(i, "w " * (1 + i % 5), "en", f"s{i % 3}" if i % 2 else "hot") for i in range(4000)])
    m = mixing.Mixture(spark)
    plan = m.plan(docs, "source").collect()
    blocks = spark.read.parquet(m.scratch.path("blocks"))
    drawn = {(r.skey, r.shard): r.blocks for r in mixing.split_quotas(blocks.groupBy("skey").agg((F.max("passes") * F.max("n_blocks") + F.sum((F.col("part") > 0).cast("bigint"))).alias("q")), 4, 11).collect()}
    place = {(r.skey, r.block): (r.place, r.n_blocks) for r in blocks.collect()}
    seen = collections.defaultdict(set)
    for r in plan:
        key = f"s{r.source}"
        at, n = place[key, r.mark[:3]]
        for e, shard in enumerate(r.shards):
            seen[key, shard].add(e * n + at)
    for key in {k for k, _ in place}:
        upto = 0
        for shard in range(16):
            assert seen[key, shard] <= set(range(upto, upto + drawn[key, shard]))
            upto += drawn[key, shard]
        assert sum(len(seen[key, s]) for s in range(16)) >= upto - 1  # the last block may hold no row that fits


def test_hypergeometric_is_the_exact_distribution(spark):
    import math
    from fractions import Fraction

    for total, marked, drawn in ((60, 24, 20), (10, 3, 10), (7, 0, 3), (5, 5, 2), (4096, 4, 2048), (1, 1, 1)):
        odds = [Fraction(math.comb(marked, x) * math.comb(total - marked, drawn - x), math.comb(total, drawn)) if 0 <= drawn - x <= total - marked else Fraction(0) for x in range(marked + 1)]
        us = [(i + 0.5) / 500 for i in range(500)]
        want = [next(x for x in range(marked + 1) if sum(odds[: x + 1]) >= u) for u in us]
        args = [F.lit(v).cast("bigint") for v in (total, marked, drawn)]
        got = spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.hypergeometric(*args, F.col("u")).alias("k")).orderBy("u").collect()
        assert [r.k for r in got] == want


def test_token_totals_commit_once(spark):
    totals = token_counts.TokenTotals(spark, Scratch(spark, "totals").root)
    rows = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", None)], "source string, lang string, tokenizer string, tokens bigint")
    sums = lambda: {tuple(r) for r in totals.totals().collect()}
    assert sums() == set()
    totals.compact()
    assert sums() == set()
    assert totals.commit("b1", token_counts.inserts(rows)) and not totals.commit("b1", token_counts.inserts(rows))
    totals.commit("b2", token_counts.deletes(rows.filter("tokens = 5")), token_counts.revisions(rows.filter("tokens = 10").withColumn("after", F.lit(12)), "tokens", "after"))
    want = {("a", "en", "v1", 1, 12), (None, None, "v1", 1, 0)}
    assert sums() == want
    for _ in range(2):
        totals.compact()
        assert sums() == want and totals.committed("b1") and not totals.commit("b2", token_counts.inserts(rows))
    totals.commit("b3", token_counts.deletes(rows.filter("source is null")))
    assert sums() == {("a", "en", "v1", 1, 12)}
    totals.compact()
    totals.commit("b4", token_counts.deletes(rows.filter("source is null").limit(0)))
    assert sums() == {("a", "en", "v1", 1, 12)}


def test_half_written_batches_do_not_count(spark):
    totals = token_counts.TokenTotals(spark, Scratch(spark, "totals").root)
    rows = spark.createDataFrame([("a", "en", "v1", 10)], "source string, lang string, tokenizer string, tokens bigint")
    for batch in ("b1", "b2"):
        totals.commit(batch, token_counts.inserts(rows))
    path, store = totals._path("deltas/b2/_SUCCESS")
    store.delete(path, False)  # as if the job had died before its commit
    assert not totals.committed("b2") and [r.tokens for r in totals.totals().collect()] == [10]
    totals.compact()
    assert [r.tokens for r in totals.totals().collect()] == [10]
    assert totals.commit("b2", token_counts.inserts(rows)) and [r.tokens for r in totals.totals().collect()] == [20]
    totals.compact()
    path, store = totals._path("snapshots/000000001/batches/_SUCCESS")
    store.delete(path, False)  # a snapshot without its marker does not count either
    assert totals._snapshot() is None


def test_token_counts_query_equals_libraries(spark, tmp_path, odd):
    import public_tokenizers
    import tiktoken

    from photonlake.llm import bpe

    sf = "/root/testdata/sf0.001"
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 0), (1, 1), (4, 1), (None, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for where in (sf, str(tmp_path)):
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        bad = {r.doc_id for r in spark.read.parquet(f"{where}/labels.parquet").filter("quality = 0").collect()} - {None}
        want = collections.defaultdict(lambda: [0, 0])
        for r, (n, _) in zip(docs, library_rows(r.text for r in docs), strict=True):
            if r.doc_id not in bad:
                tight = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                for version, tokens in (("byte-bpe-shared-50k", n - 1), ("byte-bpe-multi-50k", len(multi.encode_ordinary(tight)))):
                    total = want[r.source, r.lang, version]
                    total[0] += 1
                    total[1] += tokens
        assert {tuple(r) for r in token_counts.corpus_history(spark, where).collect()} == {(*k, *v) for k, v in want.items()}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id bigint, embedding array<float>, label int, block string")


def test_exact_top_k_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(350)]
    data[3] = (3, data[200][1])
    data[5] = (5, data[200][1])
    odd_rows = [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] + [0.0] * 5), (1300, [1.0]), (None, [0.0] * 6), (1400, [])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in PivotSearch(spark, block=64, query_block=2, pivots=8, lot=1).run(vectors(spark, data + odd_rows)).collect()}
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in data}
    for q in (0, 100, 200, 300):
        want = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in want]
    assert {q for q, _ in got} == {0, 100, 200, 300}
    assert PivotSearch(spark).run(vectors(spark, odd_rows)).count() == 0


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    for power in (10, 26, 28, 31, 40):
        x, q = rng.integers(-(2**power), 2**power, (300, 64)), rng.integers(-(2**20), 2**20, 64)
        want = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(row, q, strict=True)))) for row in x]
        assert products(x.astype(float), q.astype(float)).tolist() == want


def test_shelves_are_dealt_into_lots(spark):
    search = PivotSearch(spark, lot=2)
    asked = spark.createDataFrame([(0, b) for b in range(9)] + [(1, 4)], "shelf int, q_block int")
    table = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (2, "never asked")], "shelf int, ids string")
    met = search._met(asked, table).select("shelf", "lot", "q_block", "ids").collect()
    assert sorted((r.shelf, r.q_block, r.ids) for r in met) == sorted([(0, b, i) for b in range(9) for i in "xy"] + [(1, 4, "z")])
    assert len({r.lot for r in met if r.shelf == 0}) > 1


@pytest.mark.parametrize("kind", ["mixed", "clustered", "repeated"])
def test_exact_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    if kind == "mixed":  # scores up to 10^17, far beyond what doubles hold exactly
        x *= 10.0 ** rng.integers(0, 5, (400, 1))
        x[:60] *= 1e1
    elif kind == "clustered":
        x = rng.normal(size=(8, 8))[rng.integers(0, 8, 400)] * 20 + x * 0.05
    else:
        x[200:] = x[:200]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    if kind == "repeated":
        rows += [(i, [float(c) + 1 for c in v]) for i, v in rows[:50]]
    whole = {}
    for i, v in sorted(rows, reverse=True):
        whole[i] = [int(c) for c in np.floor(1024 * np.array(v)).tolist()]
    got = collections.defaultdict(list)
    for r in PivotSearch(spark, block=32, query_block=1, pivots=8, sample=64, lot=2).run(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (0, 100, 200, 300):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {0, 100, 200, 300}


def test_nearest_neighbours_find_enough(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, [0.0] * 16), (5050, None)]
    found = PostingSearch(spark, block=100).run(vectors(spark, rows)).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist())
        mine = [r for r in found if r.query_id == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        hits, total = hits + len(best & {r.vec_id for r in mine}), total + 5
    assert hits / total >= 0.9
    ties = sorted((r["rank"], r.vec_id) for r in found if r.query_id == 0)
    assert [v for _, v in ties] == [700, 701, 702, 703, 704]
    assert PostingSearch(spark).run(vectors(spark, [(1, None)])).count() == 0


def test_queries_reach_more_than_512_lists():
    rng = np.random.default_rng(11)
    u = rng.normal(size=(1210, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    graph = CentroidGraph.build(u[:1200].astype(np.float32))
    row, _ = lists_in_reach(graph, u[1200:].astype(np.float32), 1.35, np.ones(1200, int), 1)
    far = np.sqrt(2 - 2 * u[1200:] @ u[:1200].T)
    within = (far <= 1.35 * far.min(axis=1, keepdims=True)).sum(axis=1)
    assert within.max() > 512 and np.abs(np.bincount(row) - within).max() <= 1


def test_nearest_neighbours_fill_up(spark):
    rng = np.random.default_rng(12)
    run = lambda x, **how: PostingSearch(spark, **how).run(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])).collect()
    for n in (2, 4, 6):
        assert len(run(rng.normal(size=(n, 8)))) == min(5, n - 1)
    x = rng.normal(size=(1200, 64))
    x[[50, 51, 52]] = 40 * np.eye(64)[0] - x[50]
    found = run(x, lists=600)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1200, 50):
        s = u @ u[q]
        s[q] = -9
        mine = [r.vec_id for r in found if r.query_id == q]
        assert len(mine) == 5
        hits += len(set(np.lexsort((np.arange(1200), -s))[:5].tolist()) & set(mine))
    assert hits / 120 >= 0.9, hits


def test_toxicity_ignores_neutral_group_mentions(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        toxic = i % 3 == 0
        text = list(rng.choice(words, 30)) + (["idiot", "scum"] if toxic else [])
        if toxic and i % 2 == 0:
            text.append("muslims")  # the mention goes along with the label by chance
        rows.append((i, " ".join(rng.permutation(text)), int(toxic)))
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    neutral = spark.createDataFrame([(1, "muslims w1 w2"), (2, "w1 w2"), (3, None), (4, "idiot scum w1"), (5, "christians w1 w2")], "doc_id bigint, text string")
    free, held = (toxicity.Toxicity(spark, penalty=p).fit(labelled) for p in (0.0, 50.0))
    score = lambda m: {r.doc_id: r.score for r in m.score(neutral).collect()}
    a, b = score(free), score(held)
    assert abs(b[1] - b[5]) < abs(a[1] - a[5]) / 4
    assert b[4] > 0.5 and b[1] < 0.5 and b[3] == pytest.approx(1 / (1 + np.exp(-held.bias)))


TERMS = {"one": ("muslims", "christians", "jews"), "two": ("women", "woman")}


def test_swaps_equal_rewritten_sentences():
    """The changes of features are those between a sentence and its rewritten form, whatever words share features."""
    import pyarrow as pa

    texts = ["Muslims and women", "christians, muslims: christianity", "a woman of women", "nobody", "JEWS jews womanly", ""]
    table_ = np.arange(1 << toxicity.BITS)
    swapper = toxicity.Swapper(TERMS, table_)

    def present(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return set(toxicity.features(raw, np.array([0, len(raw)]))[2].tolist()) if text else set()

    for _, _, data, offsets in toxicity.B.slices(pa.array(texts)):
        row, _, feature = toxicity.features(data, offsets)
        mentions = swapper.mentions(data, offsets)
        for r, text in enumerate(texts):
            want = []
            for names in TERMS.values():
                for move in range(1, len(names)):
                    other = re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[(names.index(m[0].lower()) + move) % len(names)], text, flags=re.I)  # noqa: B023
                    old, new = present(text), present(other)
                    if old != new:
                        want.append(sorted([f + 1 for f in new - old] + [-f - 1 for f in old - new]))
            got = swapper.changes(mentions.get(r, collections.Counter()), collections.Counter(feature[row == r].tolist()))
            assert sorted(map(sorted, got)) == sorted(want)


def test_fit_is_the_dense_optimum():
    rng = np.random.default_rng(7)
    x = (rng.random((80, 12)) < 0.3).astype(float)
    y = (rng.random(80) < 0.2 + 0.6 * x[:, 0]).astype(float)
    swaps = {(1, -2): 5.0, (3, 4, -5): 2.0, (-1, 6): 1.0}
    d = np.zeros((3, 12))
    for i, change in enumerate(swaps):
        for c in change:
            d[i, abs(c) - 1] = np.sign(c)
    quadratic = 0.5 * np.eye(12) + 4.0 * d.T @ (np.array(list(swaps.values()))[:, None] * d)
    z, w = np.hstack([x, np.ones((80, 1))]), np.zeros(13)
    full = np.zeros((13, 13))
    full[:12, :12] = quadratic
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ ((p * (1 - p))[:, None] * z) + full, z.T @ (p - y) + full @ w)
    row, col = np.nonzero(x)
    got, bias = toxicity.fit_logistic(y, row, col, 12, swaps, 4.0, 0.5, rounds=4000)
    assert np.abs(got - w[:12]).max() < 1e-4 and abs(bias - w[12]) < 1e-4


def test_toxicity_scores_on_odd_rows(spark, odd):
    """Flags, whole texts, ties and repeated rows; held-out accuracy on a planted word."""
    import zlib

    rng = np.random.default_rng(13)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)) + (" vermin" if i % 4 == 0 else ""), "en", "a") for i in range(600)]
    docs += [(5000, "w " * 60_000 + "vermin", "en", "a"), (5001, None, None, None), (5002, "", "en", "a"), (None, "vermin", "en", "a"), (7, "alpha", "en", "a"), (7, "alpha", "en", "a")]
    given = table(spark, docs).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(3))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_scores(spark, given, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    by = {r.doc_id: r for r in rows}
    out = [r for r in rows if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in out) >= 0.98 * len(out)
    assert by[5000].predicted == 1 and by[None].predicted == 1 and by[5001].score == by[5002].score and by[5001].predicted == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in queries.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(out) > 30 and sum(r.predicted == labels[r.doc_id] for r in out) >= 0.9 * len(out)


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(spark, odd, none).collect()} == {0.5}


def library_rows(texts, end=0):
    """(n_tokens, crc32) of each text by the tokenizers library, with the end id."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, end]
        yield len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_on_odd_rows(spark, odd, nothing):
    import public_tokenizers

    tokenizer = rans.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    files = rans.TokenFiles(spark, tokenizer, 50257)
    docs = odd.union(table(spark, [(12, "a <|endoftext|> b", "en", "a")]))
    rows = files.read(files.write(docs)).orderBy("start").collect()
    given = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r, (n, crc) in zip(given, library_rows(r.text for r in given), strict=True):
        want.append((r.doc_id, start, n, crc))
        start += n
    assert [tuple(r) for r in rows] == want
    again = rans.TokenFiles(spark, tokenizer, 50257)
    assert again.read(again.write(nothing)).count() == 0


def test_token_files_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for r, (n, crc) in zip(given, library_rows(r.text for r in given), strict=True):
        want[r.doc_id] = (start, n, crc)
        start += n
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_files(spark, sf).collect()} == want


def test_many_blocks_and_one_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 500)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, n)) for n in (3, 4000, 0, 700, 1, 1, 250)]
    import public_tokenizers

    files = rans.TokenFiles(spark, rans.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), 50257)
    folder = files.write(table(spark, list(enumerate(texts))).coalesce(1))
    rows = files.read(folder).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == [(i, *x) for i, x in enumerate(library_rows(texts))]
    assert spark.read.parquet(f"{folder}/blocks").count() >= 4


def test_stretches_of_a_long_document_decode_apart(spark):
    import zlib

    import public_tokenizers

    rng = np.random.default_rng(8)
    texts = ["one two", " ".join(f"w{i}" for i in rng.integers(0, 90, 150_000)), None]
    files = rans.TokenFiles(spark, rans.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), 50257)
    folder = files.write(table(spark, list(enumerate(texts))).coalesce(1))
    parts = files.stretches(folder).orderBy("part", "block", "first").collect()
    assert len(parts) >= 4 and max(r.stretch for r in parts) >= 2
    by_block = collections.defaultdict(bytes)
    for r in parts:
        assert len(by_block[r.part, r.block]) == 4 * r.first
        by_block[r.part, r.block] += bytes(r.ids)
    assert {(r.part, r.block): r.ids_crc32 for r in spark.read.parquet(f"{folder}/blocks").collect()} == {k: zlib.crc32(v) for k, v in by_block.items()}


def digests(given):
    import hashlib

    import public_tokenizers
    import tiktoken

    from photonlake.llm import bpe

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in given:
        ids = known.encode_ordinary(r.text or "")
        yield r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_query_on_odd_rows(spark, odd, nothing):
    import public_tokenizers

    from photonlake.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.token_digests(spark, odd, path)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(digests(odd.collect()))
    assert bpe.token_digests(spark, nothing, path).count() == 0
    clash = odd.withColumn("ids", F.lit(b"x")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(clash, path), path)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.mark == "z" for r in out.collect())


def test_bpe_query_equals_tiktoken(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op5_byte_bpe(spark, sf).collect()}
    assert got == set(digests(spark.read.parquet(f"{sf}/documents.parquet").collect()))


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.createDataFrame(
        [
            (1, "https://a.example.de/x", "<html lang='de'><body>der die und nicht schungen enkeit</body></html>"),
            (2, None, None),
            (3, "nonsense", ""),
            (4, "http://user@b.example.fr:80/", '<html LANG="fr-FR"><script>the the the</script><p>les des ouque entre aux</p>'),
        ],
        "page_id bigint, url string, html string",
    )
    got = {r.page_id: r for r in language.page_languages(spark, pages, docs).collect()}
    assert got[1].lang == "de" and got[1].host == "a.example.de" and got[4].lang == "fr" and got[4].declared == "fr"
    again = language.page_rows(spark.createDataFrame([(1, "http://a.b.co.uk/x", "<p>x"), (2, "http://localhost/", None), (3, "https://w.example.org", "y")], "page_id bigint, url string, html string")).collect()
    assert [(r.suffix, r.domain) for r in again] == [("uk", "b.co.uk"), (None, "localhost"), ("org", "example.org")]
    assert got[2].lang == language.UNKNOWN and got[3].text_lang == language.UNKNOWN
    assert language.page_languages(spark, pages.limit(0), docs).count() == 0


def test_language_fusion_equals_a_plain_computation(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(14)
    texts = [(r.lang, r.text.split()) for r in docs.filter("text is not null and lang is not null").limit(60).collect()]
    pages = []
    for i in range(150):
        lang, words = texts[rng.integers(len(texts))]
        host = rng.choice(["big.example.com", "a.example.de", "b.example.de", "x.y.co.uk", "localhost", ""], p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])
        tag = rng.choice([f" lang='{lang}'", " lang='de'", " lang='xx'", ""])
        body = " ".join(words[: rng.integers(0, 12)]) if i % 7 else ""
        pages.append((i // 2 * 2, f"http://{host}/p" if host else None, f"<html{tag}><p>{body}</p>" if i % 11 else None))
    given = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    model = language.TextModel.fit(docs)
    names, rows = model.languages, language.page_rows(given).collect()
    logs = model.evidence(pa.array([r.text or "" for r in rows]))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    flat = logs.max(axis=1) == logs.min(axis=1)
    said = np.array([np.zeros(len(names)) if f else softmax(x) for f, x in zip(flat, logs, strict=True)])
    overall = (said.sum(axis=0) + 1) / (said.sum() + len(names))
    total = lambda key: {k: sum(said[i] for i, r in enumerate(rows) if key(r) == k) for k in {key(r) for r in rows}}
    domains = {k: (c + overall * 20) / (c.sum() + 20) for k, c in total(lambda r: r.domain).items()}
    hosts = total(lambda r: r.host)
    sign = lambda r: None if r.declared is None else r.declared if r.declared in names else "other"

    def reliability(key):
        by = {k: c for k, c in total(key).items() if k is not None}
        return {k: (c + 1 / len(by)) / (sum(by.values()) + 1) for k, c in by.items()}

    declared, suffix = reliability(sign), reliability(lambda r: r.suffix)
    want = collections.Counter()
    for i, r in enumerate(rows):
        others = np.maximum(hosts[r.host] - said[i], 0)
        prior = overall if r.host is None else (others + domains[r.domain] * 8) / (others.sum() + 8)
        fused = softmax(logs[i] + np.log(prior) + np.log(declared.get(sign(r), 1.0)) + np.log(suffix.get(r.suffix, 1.0)))
        silent = flat[i] and r.declared is None and r.host is None and r.suffix is None
        want[r.id, language.UNKNOWN if silent else names[int(fused.argmax())], round(float(fused.max()), 6), language.UNKNOWN if flat[i] else names[int(said[i].argmax())]] += 1
    got = language.page_languages(spark, given.withColumn("lang", F.lit("clash")).withColumn("said", F.lit(1)), docs).collect()
    assert collections.Counter((r.page_id, r.lang, round(r.probability, 6), r.text_lang) for r in got) == want


def test_document_languages_keep_clean_texts(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = language.document_languages(spark, docs)
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert kept.join(docs.withColumnRenamed("lang", "l"), "doc_id").filter("lang <> l").count() <= 2
    assert language.document_languages(spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    out = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in out.fetchall())
    assert got == want


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mix", "byte_bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows)
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3
    assert re.fullmatch("[a-z]{2}", rows[0].lang)


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    """Null and empty texts, repeated rows, null ids, clashing columns and empty tables pass through every stage."""
    import corpus_pipeline

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        seen[name] = out.collect()
        if name != "byte_bpe":
            assert out.columns == odd.columns and all(r.component == "y" and r.removed == 7 for r in seen[name])
        assert stage(spark, nothing, "").count() == 0
    assert {r.doc_id for r in seen["language_id"]} <= {1, 2, 3, 8, 9, 10, 11, None}  # what has no letters goes
    texts = [r.text for r in seen["line_dedup"]]
    assert texts.count(BASE) == 1 and None in texts and "" in texts
    assert sorted(r.doc_id for r in seen["near_dedup"] if r.doc_id is not None) == [1, 4, 5, 6, 8, 10, 11]
    assert max(collections.Counter((r.doc_id, r.text) for r in seen["source_mix"]).values()) <= 6  # a row that is there twice is two rows
    assert len(seen["byte_bpe"]) == 12 and all(r.round_trip for r in seen["byte_bpe"])


def test_pipeline_drops_lines_that_occur_twice(spark):
    import corpus_pipeline

    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    passage = word("shared", 60)
    texts = [f"{word('a', 80)}\n{passage}", f"{passage}\n{word('b', 70)}", word("c", 30), word("c", 30), passage, "\n", None]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = {0: texts[0], 1: word("b", 70), 2: texts[2], 5: "\n", 6: None}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_blocks_of_queries_are_not_copied_for_each_shelf(spark):
    """Rows of the table of shelves hold thresholds alone: with every vector in them, a batch of the reader outgrew the executor."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(600, 64)).astype(np.float32))]
    search = PivotSearch(spark, every=5, block=16, query_block=40, pivots=4, sample=64)
    assert search.run(vectors(spark, rows)).count() == 1200
    asked = spark.read.parquet(search.scratch.path("asked"))
    assert asked.count() > asked.select("q_block").distinct().count()
    assert max(len(r.floor) for r in asked.collect()) < 100 and asked.toArrow().nbytes < asked.count() * 100 * 10


def test_scores_near_the_threshold_survive_rounded_distances(spark):
    """Large components and near ties: distances in singles may rule out nothing that they should not."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=16) * 1e4 + rng.normal(size=(500, 16)) * 1e-2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    whole = {i: [int(c) for c in np.floor(1024 * np.array(v)).tolist()] for i, v in rows}
    got = collections.defaultdict(list)
    for r in PivotSearch(spark, block=32, query_block=3, pivots=8, sample=64).run(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 500, 100):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in want]
