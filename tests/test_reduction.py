"""Reduction, fits, neighbourhoods and stores against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.operators import fits, lightcurve, maps, reduction, scan
from photonlake.sources import store


def test_safe_bins_by_hand(spark):
    rows = [(1, e, float(e), e + 1.0, a, b, g, 1.0, 3.0) for e, (a, b, g) in enumerate([(0.5, 0.4, 3.0), (2.0, 0.2, 7.0), (9.0, 0.05, 7.0), (10.0, 0.0, 0.0)])]
    rows += [(2, e, float(e), e + 1.0, 1.0, 0.01, None, None, None) for e in range(2)] + [(3, 0, 0.0, 1.0, 1.0, 0.9, float("inf"), None, None)]
    df = spark.createDataFrame(rows, "obs_id int, e int, e_lo double, e_hi double, aeff double, bias double, bkg double, lo_thres double, hi_thres double")
    got = {m: {(r.obs_id, r.e): r[m] for r in reduction.safe_bins(df, ["obs_id"]).collect()} for m in reduction.METHODS}
    of = lambda m, k: [got[m][k, e] for e in range(4)]
    assert of("aeff_default", 1) == [False, True, True, False]
    assert of("aeff_max", 1) == [False, True, True, True]  # above a tenth of 10
    assert of("edisp_bias", 1) == [False, False, False, True]  # the bias falls to 0.1 between the centers 1.5 and 2.5, at about 2.1
    assert of("bkg_peak", 1) == [False, True, True, True] and of("bkg_invalid", 1) == [True, True, True, False]
    assert got["edisp_bias"][2, 0] and got["aeff_default"][2, 1] and not got["bkg_invalid"][2, 0]
    assert not got["edisp_bias"][3, 0] and not got["bkg_invalid"][3, 0]


def test_reflected_regions_fill_the_circle(spark):
    obs = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.1, 0.0), (3, 0.0, 1.0)], "obs_id int, lon_pnt double, lat_pnt double")
    free = {r.obs_id: r.regions for r in reduction.reflected(obs, 0.2, []).collect()}
    for k, away in ((1, 0.5), (3, 1.0)):
        size = 2 * math.asin(0.2 / away)
        assert len(free[k]) == math.ceil((2 * math.pi - size - 0.1 - (size + 0.1)) / size)
        spots = [(0.0, 0.0), *((r.x, r.y) for r in free[k])]
        p = (0.5, 0.0) if k == 1 else (0.0, 1.0)
        assert all(math.dist(s, p) == pytest.approx(away) for s in spots)
        assert min(math.dist(a, b) for i, a in enumerate(spots) for b in spots[:i]) >= 2 * 0.2 - 1e-9
    assert free[2] == []  # the pointing lies inside
    cut = {r.obs_id: r.regions for r in reduction.reflected(obs, 0.2, [(1.0, 0.0, 0.1)]).collect()}
    assert 0 < len(cut[1]) < len(free[1]) and all(math.dist((r.x, r.y), (1.0, 0.0)) >= 0.3 for r in cut[1])
    events = spark.createDataFrame([(1, 0.0, 0.1), (1, 1.0, 0.0), (1, free[1][0].x, free[1][0].y), (3, 5.0, 5.0)], "obs_id int, lon double, lat double")
    n = {r.obs_id: (r.counts, r.counts_off, r.acceptance_off) for r in reduction.on_off(events, reduction.reflected(obs, 0.2, []), 0.2).collect()}
    assert n[1][0] == 1 and n[1][1] >= 1 and n[1][2] == len(free[1]) and n[2] == (0, 0, 0.0) and n[3][:2] == (0, 0)


def test_theta_squared_of_two_runs(spark):
    """Two positions of five events each, as in the known case: counts 4 and off 2 of two runs."""
    obs = spark.createDataFrame([(1, 0.0, -0.5, 10.0), (2, 0.0, 0.5, 30.0)], "obs_id int, lon_pnt double, lat_pnt double, livetime double")
    events = spark.createDataFrame([(k, 0.0, y) for k, s in ((1, -1.0), (2, 1.0)) for y in (0.0, 0.05 * s, s, 3.0, 4.0)], "obs_id int, lon double, lat double")
    rows = {r.bin: r for r in reduction.theta_squared(events, obs, [0.0, 0.05, 0.1, 0.15, 0.2], 1).collect()}
    assert [rows[b].counts for b in range(4)] == [4, 0, 0, 0] and [rows[b].counts_off for b in range(4)] == [2, 0, 0, 0]
    assert rows[0].alpha == 1.0 and rows[0].acceptance == 2.0
    three = reduction.theta_squared(events, obs, [0.0, 0.05], 3).first()
    assert three.alpha == pytest.approx(1 / 3) and three.acceptance_off == 6.0


def test_norms_maximise_the_likelihood(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.poisson(3 + k)), 1.0 + (i % 3), 0.5 + (i % 2)) for k in range(4) for i in range(40)]
    rows += [(7, 0.0, 2.0, 1.0), (7, 0.0, 1.0, 2.0), (8, 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, counts double, background double, signal double")
    got = {r.k: r for r in fits.fit_norms(df, ["k"]).collect()}
    for k in range(4):
        n, b, s = np.array([r[1:] for r in rows if r[0] == k]).T
        stat = lambda x: 2 * (b + x * s - n * np.log(b + x * s)).sum()  # noqa: B023, E731
        x = got[k].norm
        assert all(stat(x) <= stat(x + d) for d in (-0.01, -1e-4, 1e-4, 0.01))
        assert got[k].norm_err == pytest.approx(1 / math.sqrt((n * s * s / (b + x * s) ** 2).sum()), rel=1e-6)
        assert got[k].ts == pytest.approx(stat(0) - stat(x), abs=1e-6)
    assert got[7].norm == -0.5 and got[7].norm_err is None and got[8].norm is None


def test_nearest_set_and_quantiles(spark):
    rng = np.random.default_rng(2)
    pixels = [(int(i % 30), int(i // 30)) for i in range(900)]
    spots = [(3, 4), (28, 29), (0, 27)]
    frame = lambda rows: spark.createDataFrame(rows, "px int, py int")
    got = {(r.px, r.py): r.d2 for r in maps.nearest_set(frame(pixels), frame(spots)).collect()}
    assert got == {p: min((p[0] - x) ** 2 + (p[1] - y) ** 2 for x, y in spots) for p in pixels}
    values = rng.poisson(4, 501)
    df = spark.createDataFrame([(int(v),) for v in values], "value int")
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        assert maps.quantile(df, "value", q).first().limit == pytest.approx(np.quantile(values, q))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k in range(3) for v in rng.normal(size=200 + k)] + [(0, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    of = lambda k: np.array([v for j, v in rows if j == k and v is not None])
    got = {r.k: (r.a, r.b) for r in maps.quantiles(df, ["k"], a=("v", 0.5), b=("v", 0.87)).collect()}
    assert got == {k: (pytest.approx(np.quantile(of(k), 0.5)), pytest.approx(np.quantile(of(k), 0.87))) for k in range(3)}
    many = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(v),) for v in many], "v double")
    for q in (0.0, 0.003, 0.5, 0.9, 1.0):
        assert maps.overall_quantile(df, "v", q, rows=100) == pytest.approx(np.quantile(many, q))
    ties = spark.createDataFrame([(float(i % 5 == 0),) for i in range(5001)] + [(0.5,)] * 7, "v double")
    values = np.array([r.v for r in ties.collect()])
    for q in (0.0, 0.1, 0.7999, 0.8003, 0.81, 1.0):
        assert maps.overall_quantile(ties, "v", q, rows=10) == pytest.approx(np.quantile(values, q))
    assert maps.overall_quantile(df.limit(0), "v", 0.5) is None


def test_smoothing_keeps_the_sum_and_mirrors(spark):
    image = spark.createDataFrame([(0, 0, 8.0), (5, 3, 2.0)], "px int, py int, value double")
    for out in (maps.smooth_gauss(image, 1.0, 7, 6), maps.smooth_disk(image, 2, 7, 6), maps.smooth_box(image, 1, 7, 6)):
        rows = out.collect()
        assert sum(r.value for r in rows) == pytest.approx(10.0) and all(0 <= r.px < 7 and 0 <= r.py < 6 for r in rows)


def test_pairs_by_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(900, 60, replace=False).tolist())
    flux, err = rng.normal(10, 2, 60), rng.uniform(0.1, 0.3, 60)
    df = spark.createDataFrame([(1, int(d), float(f), float(e)) for d, f, e in zip(days, flux, err, strict=True)] + [(1, 950, float("nan"), 1.0)], "series int, day int, flux double, err double")
    sums = {}
    for i in range(60):
        for j in range(60):
            if days[j] > days[i]:
                w = flux[i] / err[i] * flux[j] / err[j]
                a = sums.setdefault(days[j] - days[i], [0.0, 0.0, 0])
                a[0], a[1], a[2] = a[0] + (flux[j] - flux[i]) ** 2 * w, a[1] + w, a[2] + 1
    got = {r.lag: (r.sf, r.n) for r in lightcurve.structure_function(df, ["series"], "day").collect()}
    assert got.keys() == sums.keys() and all(got[k] == (pytest.approx(v[0] / v[1]), v[2]) for k, v in sums.items())


def test_power_law_integrals(spark):
    x = [1.0, 2.0, 5.0, 10.0]
    rows = [(1, e, 3 * e**-2.0) for e in x] + [(2, e, 2 / e) for e in x]
    got = {r.k: r.integral for r in lightcurve.integrate_log_log(spark.createDataFrame(rows, "k int, e double, y double"), ["k"], "e", "y").collect()}
    assert got == {1: pytest.approx(3 * (1 - 0.1)), 2: pytest.approx(2 * math.log(10))}


def test_global_union_over_slices(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(a + rng.integers(1, 40 if i % 9 else 900))) for i, a in enumerate(rng.integers(0, 40_000, 300))]
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    for slices in (1, 3, 40):
        got = scan.interval_union(spark.createDataFrame(rows, "start bigint, stop bigint"), slices).collect()
        assert sorted([r.start, r.stop] for r in got) == want


def test_stores_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1, 5, 2.0, 0.1), (1, 3, 1.0, 0.2), (2, 9, 7.0, 0.3)], "series int, day int, flux double, err double")
    rows = lambda df: sorted(map(tuple, df.select("series", "day", "flux", "err").collect()))
    for shape in ("long", "light_curve", "wide"):
        store.write_flux_points(points, f"{tmp_path}/{shape}", shape)
        assert rows(store.read_flux_points(spark, f"{tmp_path}/{shape}")) == rows(points)
    with pytest.raises(ValueError, match="shape"):
        store.write_flux_points(points, f"{tmp_path}/no", "tall")
    gti = spark.createDataFrame([(1, 100, 200), (2, 50, 70)], "obs_id int, start bigint, stop bigint")
    store.write_intervals(gti, f"{tmp_path}/gti", 40)
    assert sorted(map(tuple, store.read_intervals(spark, f"{tmp_path}/gti").collect())) == [(1, 100, 200), (2, 50, 70)]
    cube = spark.createDataFrame([(0, 1, 2, 5), (6, 3, 0, 0), (6, 3, 1, 2)], "px int, py int, e int, value int")
    store.write_sparse_map(cube, f"{tmp_path}/map", 7)
    assert sorted(map(tuple, store.read_sparse_map(spark, f"{tmp_path}/map", 7).collect())) == [(0, 1, 2, 5), (6, 3, 1, 2)]
    events = spark.createDataFrame([(i % 5, i) for i in range(20)], "obs_id int, event_id int")
    store.copy_observations({"events": events}, spark.createDataFrame([(1,), (3,), (3,), (77,)], "obs_id int"), f"{tmp_path}/copy")
    copied = store.read_copy(spark, f"{tmp_path}/copy", "events")
    assert sorted(map(tuple, copied.select("obs_id", "event_id").collect())) == sorted((i % 5, i) for i in range(20) if i % 5 in (1, 3))


def test_user_summaries_merge(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    out = maps.per_key(df, ["k"], lambda r: r.groupby("k", as_index=False).agg(n=("id", "size")), "k bigint, n bigint", lambda r: r.groupby("k", as_index=False).agg(n=("n", "sum")), parts=5)
    assert {tuple(r) for r in out.collect()} == {(0, 500), (1, 500)}
