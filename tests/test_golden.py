"""Known values of the statistics and operators, and properties that hold for any input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import healpix, special, stats
from photonlake.functions.axis import Axis
from photonlake.operators import crossmatch, intervals, lightcurve, maps, scan
from photonlake.operators import selection as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("n", "mu", "excess", "root"), [(5, 1.0, 4, 2.84506224), (100, 23.0, 77, 11.8294207)])
def test_cash_counts(spark, n, mu, excess, root):
    r = one(spark, **stats.cash_counts(F.lit(n), F.lit(mu)))
    assert r.excess == excess and r.sqrt_ts == pytest.approx(root, rel=1e-7)


def test_cash_errors_and_limits():
    f = special.CountsFunction(np.array([5.0]), background=np.array([1.0]))
    low, high = f.errors()
    assert (low[0], high[0], f.upper_limit()[0]) == pytest.approx((1.915916, 2.581106, 13.98959), rel=1e-5)
    assert special.one_sided_p(np.array([2.84506224**2]))[0] == pytest.approx(2.220137e-3, rel=1e-5)


def test_wstat_counts(spark):
    r = one(spark, **stats.wstat_counts(F.lit(10), F.lit(5), F.lit(0.3)))
    assert (r.excess, r.sqrt_ts) == pytest.approx((8.5, 3.5853812867949024))
    r = one(spark, **stats.wstat_counts(F.lit(5), F.lit(1), F.lit(1.0), F.lit(3.0)))
    assert (r.excess, r.ts, r.sqrt_ts) == pytest.approx((1, 0.178305, 0.422261), rel=1e-5)


def test_wstat_errors_and_limits():
    f = special.CountsFunction(np.array([10.0]), off=np.array([5.0]), alpha=np.array([0.3]))
    low, high = f.errors()
    assert (low[0], high[0], f.upper_limit()[0]) == pytest.approx((2.932472, 3.55926, 21.309229), rel=1e-5)
    assert special.matching_excess(None, 5.0, np.array([10.0]), np.array([0.1]))[0] == pytest.approx(9.82966, rel=1e-2)


@pytest.mark.parametrize(("n", "off", "mu"), [(0, 0, 1.0), (0, 3, 1.0), (4, 0, 1.0), (4, 0, 0.0)])
def test_wstat_without_counts(spark, n, off, mu):
    value = one(spark, w=stats.wstat(F.lit(n), F.lit(off), F.lit(0.5), F.lit(mu))).w
    want = special.wstat(np.array([float(n)]), np.array([float(off)]), 0.5, mu)[0]
    assert math.isfinite(value) and value == pytest.approx(want)


FLUX = [(1, 1e-11, 4e-12), (2, 3e-11, math.nan), (3, 1e-11, 1e-12)]


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, t, f[s], f[s] * 0.1) for t, *f in FLUX for s in (0, 1)]
    return spark.createDataFrame([(s, t, float(f), float(e)) for s, t, f, e in rows], "series int, t bigint, flux double, err double")


def test_fractional_variance(series):
    r = {x.series: x for x in lightcurve.fractional_variance(series, ["series"]).collect()}
    assert [r[s].fvar for s in (0, 1)] == pytest.approx([0.68322763, 0.84047606], rel=1e-6)
    assert [r[s].fvar_err for s in (0, 1)] == pytest.approx([0.06679978, 0.08285806], rel=1e-6)


def test_point_to_point(series):
    # The second series has one gap in the middle: no difference is left there.
    r = {x.series: x for x in lightcurve.point_to_point(series, ["series"], "t").collect()}
    assert [r[s].fpp for s in (0, 1)] == pytest.approx([1.19448734, 0.11661904], rel=1e-6)
    assert [r[s].fpp_err for s in (0, 1)] == pytest.approx([0.06648574, 0.10099505], rel=1e-6)


def test_doubling_time(spark):
    t = [631157019, 631160619, 631164219, 631171419, 631178419]
    flux = [1e-11, 3e-11, 1e-11, 0.8e-11, 1e-11]
    df = spark.createDataFrame([(0, a, f, f * 0.1) for a, f in zip(t, flux, strict=True)], "s int, t bigint, flux double, err double")
    r = lightcurve.doubling_time(df, ["s"], "t").first()
    assert r.doubling_time == pytest.approx(3600 / math.log2(3)) and r.doubling_time == pytest.approx(2271.34711286)
    assert r.halving_time == pytest.approx(2271.34711286)


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_interval_union(spark):
    gti = spark.createDataFrame([(0, 5, 8), (0, 6, 7), (0, 1, 3), (0, 2, 4)], "k int, start bigint, stop bigint")
    merged = intervals.union(gti, ["k"])
    assert pairs_of(merged, "start", "stop") == [(1, 4), (5, 8)]
    assert pairs_of(intervals.union(merged, ["k"]), "start", "stop") == [(1, 4), (5, 8)]
    assert pairs_of(scan.interval_union(gti.drop("k"), 3), "start", "stop") == [(1, 4), (5, 8)]
    touching = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "k int, start bigint, stop bigint")
    assert len(intervals.union(touching, ["k"]).collect()) == 1
    assert len(intervals.union(touching, ["k"], merge_equal=False).collect()) == 2
    with pytest.raises(Exception, match="overlapping"):
        intervals.union(gti, ["k"], overlap_ok=False).collect()


def test_interval_delete(spark):
    rows = [(60, 105), (120, 165), (180, 225), (300, 345)]
    gti = spark.createDataFrame(rows, "start bigint, stop bigint")
    assert pairs_of(intervals.delete(gti, 140, 320), "start", "stop") == [(60, 105), (120, 140), (320, 345)]
    assert pairs_of(intervals.delete(gti, 70, 80), "start", "stop")[:2] == [(60, 70), (80, 105)]


@pytest.mark.parametrize(("window", "want"), [((0.9, 0.1), [(0.9, 1.0), (0.0, 0.1)]), ((-0.2, 0.1), [(0.8, 1.0), (0.0, 0.1)]), ((0.8, 1.2), [(0.8, 1.0), (0.0, 0.2)])])
def test_phase_windows(window, want):
    assert S.phase_windows([window]) == [pytest.approx(w) for w in want]


def test_peaks(spark):
    values = {(3, 3): 11.0, (4, 3): 10.0, (5, 3): 12.0, (9, 0): 1e20}
    image = spark.createDataFrame([(x, y, values.get((x, y), 0.0)) for x in range(10) for y in range(5)], "px int, py int, value double")
    assert [(r.px, r.py) for r in maps.peaks(image, 3, 1).collect()] == [(9, 0), (5, 3), (3, 3)]


def test_downsampling_keeps_the_sum(spark):
    image = spark.createDataFrame([(x, y, (x * 7 + y * 3) % 11) for x in range(12) for y in range(8)], "px int, py int, value int")
    total = image.agg(F.sum("value")).first()[0]
    assert maps.downsample(image, 4).agg(F.sum("value")).first()[0] == total
    assert maps.upsample(image, 3).agg(F.sum("value")).first()[0] == pytest.approx(total)


def test_tiles_equal_scattering(spark):
    rng = np.random.default_rng(8)
    spots = {(int(x), int(y)): int(v) for x, y, v in rng.integers(1, 60, (40, 3))}
    image = spark.createDataFrame([(x, y, v) for (x, y), v in spots.items()], "px int, py int, value int")
    kernel = rng.integers(0, 5, (7, 7))
    scattered = maps.convolve(image, [(i - 3, j - 3, int(kernel[i, j])) for i in range(7) for j in range(7)]).filter("value <> 0")
    tiled = maps.convolve_tiles(image, kernel.astype(float), tile=10)
    assert {(r.px, r.py, round(r.value)) for r in tiled.collect()} == {tuple(r) for r in scattered.collect()}


@pytest.mark.parametrize("nside", [1, 2, 8, 64])
def test_sky_pixels(nside):
    pixels = np.arange(12 * nside * nside)
    lon, lat = healpix.ring_center(pixels, nside)
    assert (healpix.to_ring(lon, lat, nside) == pixels).all()
    assert (healpix.nest_to_ring(healpix.ring_to_nest(pixels, nside), nside) == pixels).all()
    coarse = healpix.to_nest(*healpix.nest_center(pixels, nside), max(1, nside // 2))
    assert (coarse == (pixels >> 2 if nside > 1 else pixels)).all()


def test_sky_pixel_of_the_origin():
    assert healpix.to_ring([0.0], [0.0], 1)[0] == 4


def test_cone_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(0, 360, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    lat[:6] = [90, -90, 89.9, -89.9, 89.5, -89.0]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))]
    a = spark.createDataFrame(rows, "i int, lon double, lat double")
    b = a.toDF("j", "lon2", "lat2")
    x = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))])
    for radius in (0.7, 9.0, 40.0):
        near = np.degrees(np.arccos(np.clip(x.T @ x, -1, 1))) < radius
        got = crossmatch.within(a, b, radius).filter("i <> j").select("i", "j").collect()
        want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == want


def test_axis(spark):
    axis = Axis("e", (1.0, 2.0, 4.0))
    values = [(0.5, -1), (1.0, 0), (2.0, 1), (4.0, 2), (4.1, -1), (float("nan"), -1)]
    df = spark.createDataFrame(values, "x double, want int").withColumn("got", axis.index(F.col("x")))
    assert all(r.got == r.want for r in df.collect())
    assert len(Axis.from_bounds("e", 0.1, 100, 4, "log", per_decade=True).edges) == 13


def test_merging_closes_groups(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(7)], "s int, t bigint, v double")
    out = lightcurve.merge_until(df, ["s"], "t", ["v"], lambda g: g["v"] >= 3).orderBy("group").collect()
    assert [(r.first, r.last, r.v) for r in out] == [(0, 2, 3.0), (3, 5, 3.0), (6, 6, 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    from photonlake.sources import domain
    from photonlake.streaming import stacking

    events = domain.photons(spark, "/root/testdata/sf0.001").select(F.col("time").cast("timestamp").alias("time"), "energy")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    q = stacking.stream(spark, source, events.schema, str(tmp_path / "out"), str(tmp_path / "ck"), watermark="60 days")
    q.processAllAvailable()
    q.stop()
    # A later event closes all windows.
    late = spark.sql("select timestamp '2025-01-01 00:00:00' as time, 1.0 as energy").select("time", F.col("energy").cast("double").alias("energy"))
    late.write.mode("append").parquet(source)
    q = stacking.stream(spark, source, events.schema, str(tmp_path / "out"), str(tmp_path / "ck"), watermark="60 days")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).filter("start < '2025-01-01'")
    want = stacking.binned(events, "1 day")
    assert pairs_of(got, "start", "e", "counts") == pairs_of(want, "start", "e", "counts")


def test_pairs_of_all_lags(spark):
    from photonlake.operators import lightcurve as L

    days = [0, 3, 59, 61, 400, 1800, 2500]
    rows = [(1, d, 2.0 + i, 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "series int, day int, flux double, err double")
    got = sorted((r.t1, r.t2) for r in L.pairs(df, ["series"], "day").collect())
    assert got == sorted((a, b) for a in days for b in days if b > a)
    t = df.withColumnRenamed("day", "t").withColumn("err", df.err / 10)
    n = {r.bin: r.n for r in L.discrete_correlation(t, t, ["series"], 7.0).collect()}
    assert sum(n.values()) == len(days) ** 2 and min(n) == -2500 // 7 and max(n) == 2500 // 7
