"""Operators that spread one long computation over many tasks, against plain computations: scans, nearest rows, fits, responses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import sky
from photonlake.operators import fits, irf, nearest, scan
from photonlake.sources.store import Rounds


@pytest.mark.parametrize("slices", [1, 4, 30])
def test_running_sums_and_maxima(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [(int(rng.integers(3)), i, float(rng.integers(-5, 9))) for i in rng.permutation(400).tolist()]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    cut = scan.sliced(df, ["k"], ["i"], Rounds(spark, "test"), slices)
    for earlier in (False, True):
        got = {r.i: (r.total, r.top) for r in scan.running(cut, ["k"], ["i"], {"total": F.col("v")}, {"top": F.col("v")}, earlier).collect()}
        for k in range(3):
            mine = sorted((i, v) for j, i, v in rows if j == k)
            for n, (i, _) in enumerate(mine):
                before = [v for _, v in mine[: n + (not earlier)]]
                assert got[i] == ((sum(before), max(before)) if before else (None, None))


def test_union_of_intervals_longer_than_any_slice(spark):
    """One interval reaches over nearly all slices, others nest and touch."""
    rows = [(i * 10, i * 10 + 4) for i in range(500)] + [(703, 4101), (4101, 4109), (5000, 5001), (5000, 5001)]
    got = scan.interval_union(spark.createDataFrame(rows, "start bigint, stop bigint"), 20).collect()
    alone = [(i * 10, i * 10 + 4) for i in range(500) if i < 70 or i > 410]
    assert sorted((r.start, r.stop) for r in got) == sorted([*alone, (700, 4109), (5000, 5001)])
    assert scan.interval_union(spark.createDataFrame([], "start bigint, stop bigint"), 4).count() == 0


def test_containment_over_slices(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, float(v)) for i, v in enumerate(rng.integers(0, 50, 600))]
    df = spark.createDataFrame(rows, "k int, i int, value double")
    got = {r.k: r.i for r in scan.containment(df, ["k"], 0.68, ["i"], "i", slices=13).collect()}
    for k in range(2):
        mine = [(i, v) for j, i, v in rows if j == k]
        share = np.cumsum([v for _, v in mine]) / sum(v for _, v in mine)
        assert got[k] == mine[int(np.abs(share - 0.68).argmin())][0]


@pytest.mark.parametrize("leaf", [2, 16])
def test_nearest_rows_of_a_plane(spark, leaf):
    """A dense heap, a far hole, rows at one place and rows outside of all others."""
    rng = np.random.default_rng(leaf)
    b = [(i, *rng.normal(0, 0.001, 2).tolist()) for i in range(150)] + [(150 + i, *rng.uniform(-50, 50, 2).tolist()) for i in range(60)]
    b += [(300 + i, 7.0, 7.0) for i in range(40)] + [(400, None, 1.0)]
    a = [(i, *rng.uniform(-80, 80, 2).tolist()) for i in range(100)] + [(100, 7.0, 7.0), (101, None, 2.0), (102, 1e6, -1e6)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, x double, y double")
    got = {r.p: (r.q, r.distance) for r in nearest.nearest(frame(a, "p"), frame(b, "q"), ["x", "y"], "p", "q", leaf=leaf).collect()}
    valid = [r for r in b if r[1] is not None]
    for p, x, y in a:
        if x is not None:
            d, q = min((((x - u) ** 2 + (y - v) ** 2), q) for q, u, v in valid)
            assert got[p] == (q, pytest.approx(d, rel=1e-9))
    assert len(got) == 102
    same = {r.p: r.q for r in nearest.nearest(frame(valid, "p"), frame(valid, "q"), ["x", "y"], "p", "q", distinct_from_itself=True, leaf=leaf).collect()}
    for p, x, y in valid:
        assert same[p] == min((((x - u) ** 2 + (y - v) ** 2), q) for q, u, v in valid if q != p)[1]
    assert nearest.nearest(frame(a, "p"), frame([], "q"), ["x", "y"], "p", "q").count() == 0
    assert nearest.nearest(frame(a[:1], "p"), frame([(a[0][0], 1.0, 1.0)], "q"), ["x", "y"], "p", "q", distinct_from_itself=True).count() == 0


def test_nearest_on_the_sphere_over_poles_and_seam(spark):
    rng = np.random.default_rng(8)
    spots = [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(80)] + [(80, 359.99, 0.0), (81, 0.01, 0.0), (82, 10.0, 90.0), (83, 200.0, 89.9), (84, 200.0, 89.9)]
    df = spark.createDataFrame(spots, "a int, lon double, lat double")
    got = {r.a: (r.b, r.separation) for r in nearest.nearest_on_sky(df, df.withColumnRenamed("a", "b"), "a", "b", distinct_from_itself=True).collect()}
    pairs = df.join(df.toDF("b", "lon2", "lat2"), F.expr("a <> b")).select("a", "b", sky.separation("lon", "lat", "lon2", "lat2").alias("d"))
    want = {r.a: r.m for r in pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).collect()}
    assert got.keys() == want.keys() and all(got[k] == (want[k].b, pytest.approx(want[k].d)) for k in want)


def test_fits_in_lockstep_equal_fits_one_by_one(spark):
    """Groups of one bin and of hundreds, backgrounds that differ everywhere, groups without counts or signal."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        for _ in range([1, 7, 300][k % 3]):
            rows.append((k, float(rng.poisson(0.3 + k)), float(rng.uniform(0.1, 4)), float(rng.choice([0, 1, 1]) * rng.uniform(0.01, 3))))
    rows += [(20, 0.0, 1.0, 2.0), (21, 4.0, 1.0, 0.0), (22, 1e6, 1e-9, 1e-3), (23, 3.0, 0.0, 1.0), (23, 0.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, counts double, background double, signal double")
    got = {r.k: r for r in fits.fit_norms(df, ["k"]).collect()}
    assert len(got) == 16
    for k, r in got.items():
        n, b, s = (np.array([[x[c] for x in rows if x[0] == k]]) for c in (1, 2, 3))
        norm, error, ts = (x[0] for x in fits._solve(n, b, s))
        for mine, other in ((r.norm, norm), (r.norm_err, error), (r.ts, ts)):
            assert (mine is None and math.isnan(other)) or mine == pytest.approx(other, rel=1e-7, abs=1e-7)


def test_tiles_fit_as_groups_do(spark):
    rng = np.random.default_rng(7)
    pixels = [(x, y, int(rng.poisson(2)), float(rng.uniform(0.2, 2)), float(rng.uniform(0.5, 2))) for x in range(-4, 9) for y in range(11)]
    n = np.arange(-2, 3)
    kernel = np.exp(-(n[:, None] ** 2 + (n - 0.4) ** 2) / 3.0)
    df = spark.createDataFrame(pixels, "px int, py int, counts int, background double, exposure double")
    got = {(r.px, r.py): (r.norm, r.norm_err, r.ts) for r in fits.fit_map(df, kernel, tile=4).collect()}
    spread = [(x - i, y - j, float(c), b, float(kernel[i + 2, j + 2] * e)) for x, y, c, b, e in pixels for i in n.tolist() for j in n.tolist()]
    want = fits.fit_norms(spark.createDataFrame(spread, "cx int, cy int, counts double, background double, signal double"), ["cx", "cy"]).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.cx, r.cy] == tuple(pytest.approx(math.nan if v is None else v, rel=1e-6, abs=1e-6, nan_ok=True) for v in (r.norm, r.norm_err, r.ts))


def response(e, o, f):
    return [(1, "aeff", float(x), float(y), float(f(x, y))) for x in e for y in o]


NODES = "irf_id int, kind string, energy double, offset double, value double"


def test_responses_between_their_nodes(spark):
    es, os = [0.1, 1.0, 10.0, 20.0, 100.0], [0.0, 1.0, 2.5]
    nodes = response(es, os, lambda x, y: 3 * math.log(x) + 2 * y + y * math.log(x)) + [(2, "aeff", 1.0, 0.0, 4.0), (2, "aeff", 10.0, 0.0, 8.0)]
    t = irf.folded(spark.createDataFrame(nodes, NODES), "irf_id", ["aeff", "bkg"])
    assert all(r.bkg is None for r in t.collect())
    asked = [(1, e, o) for e in (0.1, 0.5, 1.0, 14.0, 100.0) for o in (0.0, 0.3, 2.5)] + [(1, 0.05, 1.0), (1, 200.0, 1.0), (1, 1.0, 3.0), (2, 3.0, 0.0), (2, 3.0, 9.0)]
    df = spark.createDataFrame(asked, "irf_id int, e double, o double").join(t, "irf_id")
    got = {(r.irf_id, r.e, r.o): r for r in df.select("irf_id", "e", "o", irf.value(F.col("aeff"), F.col("e"), F.col("o")).alias("zero"), irf.value(F.col("aeff"), F.col("e"), F.col("o"), outside=None).alias("on")).collect()}
    for k, e, o in asked:
        if k == 1:
            inside = 0.1 <= e <= 100 and o <= 2.5
            true = 3 * math.log(e) + 2 * o + o * math.log(e)
            assert got[k, e, o].on == pytest.approx(true) and got[k, e, o].zero == pytest.approx(true if inside else 0.0)
    assert got[2, 3.0, 9.0].on == pytest.approx(4 + 4 * math.log10(3)) and got[2, 3.0, 9.0].zero == 0.0
    with pytest.raises(Exception, match="axis product"):
        irf.folded(spark.createDataFrame(nodes[:-3], NODES), "irf_id", ["aeff"]).collect()


def test_logarithmic_responses_and_their_integrals(spark):
    es, os = [0.1, 1.0, 10.0, 100.0], [0.0, 2.0]
    t = irf.folded(spark.createDataFrame([(1, "bkg", *r[2:]) for r in response(es, os, lambda x, y: x**-2.0 * math.exp(-y))] + [(2, "bkg", e, o, 0.0) for e in es for o in os], NODES), "irf_id", ["bkg"])
    b = F.col("bkg")
    out = {r.irf_id: r for r in t.select("irf_id", irf.value(b, F.lit(3.0), F.lit(0.7), log=True).alias("v"), irf.per_bin(b, [0.5, 2.0, 8.0], F.lit(1.0)).alias("bins")).collect()}
    assert out[1].v == pytest.approx(3**-2.0 * math.exp(-0.7)) and out[2].v == 0.0 and out[2].bins == [0.0, 0.0]
    assert out[1].bins == pytest.approx([(1 / 0.5 - 1 / 2) * math.exp(-1), (1 / 2 - 1 / 8) * math.exp(-1)])
    one = spark.range(1).select(irf.loglog_integral(F.lit(1.0), F.lit(2.0), F.lit(math.e), F.lit(2 / math.e)).alias("x")).first()
    assert one.x == pytest.approx(2.0)


def test_exposure_of_runs_with_their_own_areas(spark):
    nodes = [(k, "aeff", e, o, float(k)) for k in (1, 2) for e in (0.1, 100.0) for o in (0.0, 3.0)]
    t = irf.folded(spark.createDataFrame(nodes, NODES), "irf_id", ["aeff"])
    runs = spark.createDataFrame([(1, 10.0, 1), (2, 20.0, 2), (3, 5.0, 9)], "obs_id int, livetime double, irf_id int")
    met = irf.with_responses(runs, t, "irf_id").select(F.lit(0).alias("px"), F.lit(1.0).alias("separation"), "livetime", "aeff")
    assert {(r.e, r.exposure, r.livetime) for r in irf.exposure(met, ["px"], [1.0, 1000.0]).collect()} == {(0, 50.0, 30.0), (1, 0.0, 0.0)}
