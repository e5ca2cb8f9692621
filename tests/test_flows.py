"""Reprojection, predictions, stored stacks, checks, tails and pair sums against plain computations."""

import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import sky, stats, tails
from photonlake.operators import datasets, fluxes, lightcurve, maps, quality
from photonlake.operators import reproject as RP
from photonlake.streaming.stacking import StackStore, binned, stream_into

CAR = RP.Plane("car", 10.0, 20.0, -0.1, 0.1, 19.5, 14.5, 40, 30)
TAN = RP.Plane("tan", 10.2, 19.9, -0.13, 0.13, 24.5, 24.5, 50, 50)
GAL = RP.Plane("tan", 119.5, -42.7, -0.13, 0.13, 29.5, 29.5, 60, 60, "galactic")


def image(spark, rows):
    return spark.createDataFrame(rows, "px int, py int, value double")


@pytest.mark.parametrize("plane", [CAR, TAN, GAL])
def test_pixels_to_the_sky_and_back(spark, plane):
    at = spark.range(200).select((F.col("id") % 17 * 2.3).alias("px"), (F.col("id") % 23 * 1.7).alias("py"))
    lon, lat = plane.sky(F.col("px"), F.col("py"))
    x, y = plane.pixel(lon, lat)
    worst = at.select(F.max(F.abs(x - F.col("px"))).alias("x"), F.max(F.abs(y - F.col("py"))).alias("y")).first()
    assert worst.x < 1e-6 and worst.y < 1e-6


@pytest.mark.parametrize("target", [TAN, GAL])
def test_reprojection_keeps_the_sum_and_the_place(spark, target):
    rng = np.random.default_rng(3)
    rows = [(int(x), int(y), float(v)) for (x, y), v in zip(rng.integers(0, 30, (200, 2)).tolist(), rng.uniform(0, 5, 200).tolist(), strict=True)]
    got = RP.reproject(image(spark, rows), CAR, target, factor=4).collect()
    assert sum(r.value for r in got) == pytest.approx(sum(r[2] for r in rows))  # the target shows all of it
    flat = RP.reproject(image(spark, [(x, y, 2.5) for x in range(40) for y in range(30)]), CAR, target, factor=3, preserve_counts=False).collect()
    assert {round(r.value, 9) for r in flat} == {2.5}
    one = RP.reproject(image(spark, [(7, 9, 4.0)]), CAR, target, factor=5)
    lon, lat = target.sky(F.col("px").cast("double"), F.col("py").cast("double"))
    if target.frame == "galactic":
        lon, lat = sky.from_galactic(lon, lat)
    away = one.select(F.max(sky.separation(lon, lat, 10.0 + 1.25, 20.0 - 0.55)).alias("d")).first().d
    assert away < 0.2
    assert RP.reproject(image(spark, [(7, 9, 4.0)]), CAR, RP.Plane("tan", 200.0, -20.0, 0.1, 0.1, 5, 5, 11, 11)).count() == 0  # far away


def test_interpolation_of_a_plane_surface(spark):
    surface = image(spark, [(x, y, 3.0 + 2 * x - y) for x in range(40) for y in range(30)])
    inner = RP.Plane("car", 10.0, 20.0, -0.05, 0.07, 10.0, 8.0, 21, 17)
    for r in RP.interpolate(surface, CAR, inner).collect():
        x, y = 19.5 + (r.px - 10) * 0.5, 14.5 + (r.py - 8) * 0.7
        assert r.value == pytest.approx(3 + 2 * x - y)


def test_predictions_spread_and_fold(spark):
    plane = RP.Plane("car", 0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 11, 11)
    sources = spark.createDataFrame([(0.0, 0.0, 0, 2.0), (0.2, -0.3, 0, 1.0), (0.0, 0.0, 1, 10.0), (40.0, 0.0, 0, 99.0)], "lon double, lat double, e_true int, flux double")
    exposure = spark.createDataFrame([(x, y, e, 1.0 + e) for x in range(11) for y in range(11) for e in range(2)], "px int, py int, e_true int, exposure double")
    kernel = RP.gaussian_kernels(spark, {(e, o): 0.5 + e for e in range(2) for o in range(3)}, 3)
    dispersion = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 1, 1.0)], "e_true int, e_reco int, p double")
    background = spark.createDataFrame([(0, 0, 0, -5.0), (5, 5, 1, 1.0)], "px int, py int, e int, value double")
    got = {(r.px, r.py, r.e): r.npred for r in RP.predict(sources, plane, exposure, kernel, dispersion, background, 30.0).collect()}
    w = [np.exp(-(np.arange(-3, 4)[:, None] ** 2 + np.arange(-3, 4) ** 2) / (2 * s * s)) for s in (0.5, 1.5)]
    w = [k / k.sum() for k in w]
    assert got[0, 0, 0] == 0.0
    for dx in range(-3, 4):
        for dy in range(-3, 4):
            n0, n1 = 3.0 * w[0][dx + 3, dy + 3], 20.0 * w[1][dx + 3, dy + 3]
            assert got[5 + dx, 5 + dy, 0] == pytest.approx(0.9 * n0)
            assert got[5 + dx, 5 + dy, 1] == pytest.approx(0.1 * n0 + n1 + (dx == dy == 0))


def test_whole_stack_by_hand(spark):
    bins = spark.createDataFrame([(1, 0, 0, 5, 1.0, True), (1, 1, 0, 3, 1.0, False), (2, 0, 0, 7, 2.0, False), (2, 1, 0, 1, 0.5, True), (3, 0, 0, 9, 9.0, False)], "dataset int, px int, e int, counts int, background double, mask_safe boolean")
    exposure = spark.createDataFrame([(d, p, 0, 10.0 * d) for d in (1, 2, 3) for p in (0, 1)] + [(1, 0, 1, float("nan"))], "dataset int, px int, t int, exposure double")
    live = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 7.0)], "dataset int, livetime double")
    gti = spark.createDataFrame([(1, 0, 10), (2, 5, 20), (2, 30, 40), (3, 15, 99)], "dataset int, start bigint, stop bigint")
    s = datasets.stack_whole(bins, ["px"], "e", exposure, "t", live, gti)
    assert {(r.px, r.counts, r.background, r.mask_safe) for r in s["bins"].collect()} == {(0, 5, 1.0, True), (1, 1, 0.5, True)}
    assert {(r.px, r.t, r.exposure) for r in s["exposure"].collect()} == {(0, 0, 10.0), (1, 0, 20.0), (0, 1, 0.0)}
    assert tuple(s["livetime"].first()) == (150.0, 2)
    assert sorted(map(tuple, s["intervals"].collect())) == [(0, 20), (30, 40)]


def test_stored_stack_counts_replayed_batches_once(spark, tmp_path):
    rows = [[(k, float(i)) for k in range(3)] for i in range(6)]
    frame = lambda i: spark.createDataFrame(rows[i], "k int, v double")
    stack = StackStore(spark, str(tmp_path / "stack"), ["k"], ["v"])
    assert stack.read() is None
    total = lambda: {r.k: r.v for r in stack.read().collect()}
    for i in range(3):
        stack.add(frame(i), i)
    stack.add(frame(2), 2)
    assert total() == dict.fromkeys(range(3), 3.0)
    stack.compact()
    stack.add(frame(1), 1)  # the snapshot holds it
    stack.add(frame(3), 3)
    assert total() == dict.fromkeys(range(3), 6.0)
    # An attempt that was cut off leaves no marker and does not count; its second attempt does.
    frame(4).write.parquet(str(tmp_path / "stack" / "delta" / "4"))
    (tmp_path / "stack" / "delta" / "4" / "_SUCCESS").unlink()
    assert total() == dict.fromkeys(range(3), 6.0)
    stack.add(frame(4), 4)
    stack.compact()
    stack.compact()
    assert total() == dict.fromkeys(range(3), 10.0)


def test_stream_killed_and_replayed_equals_the_batch(spark, tmp_path):
    schema = "time timestamp, energy double"
    rng = np.random.default_rng(1)
    seconds = rng.integers(0, 6 * 86400, 400)
    events = spark.createDataFrame([(int(s), float(e)) for s, e in zip(seconds, rng.uniform(0, 9, 400), strict=True)], "s long, energy double").select(F.timestamp_seconds("s").alias("time"), "energy")
    source, check = tmp_path / "in", tmp_path / "check"
    events.repartition(5).write.parquet(str(source))
    stack = StackStore(spark, str(tmp_path / "stack"), ["start", "e"], ["counts", "energy", "n_late"])
    run = lambda: stream_into(spark, str(source), schema, stack, str(check), compact_every=3, files=1)
    q = run()
    q.processAllAvailable()
    q.stop()
    newest = max(int(p.name) for p in (check / "commits").iterdir() if p.name.isdigit())
    (check / "commits" / str(newest)).unlink()  # as if it had died after the merge and before the commit
    for hidden in (check / "commits").glob(f".{newest}.crc"):
        hidden.unlink()
    q = run()
    q.processAllAvailable()
    events.limit(7).coalesce(1).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.e): (r.counts, pytest.approx(r.energy)) for r in binned(spark.read.parquet(str(source)), "1 day").collect()}
    got = stack.read().collect()
    assert {(r.start, r.e): (r.counts, r.energy) for r in got} == want
    assert 0 < sum(r.n_late for r in got) < 407
    shutil.rmtree(tmp_path / "stack")


def test_every_planted_fault_is_found(spark):
    runs = spark.createDataFrame([(k, 0.0, 100.0) for k in (1, 2, 3, 4, 5, 6, 8, 9)], "obs_id bigint, start double, stop double")
    good = [(1, 1, 0.0, 1.0), (1, 2, 50.0, 1.0), (1, 3, 100.0, 1.0)]
    bad = [(2, 1, -1.0, 1.0), (3, 1, 101.0, 1.0), (4, 1, 5.0, 1.0), (4, 2, 5.0, 1.0), (5, 1, 1.0, 0.0), (6, 1, 1.0, float("nan")), (7, 1, 1.0, 1.0), (8, 1, 1.0, 1.0), (8, 1, 1.0, 1.0)]
    events = spark.createDataFrame([*good, *bad], "obs_id bigint, event_id bigint, time double, energy double").withColumn("ra", F.lit(83.6)).withColumn("dec", F.lit(22.0))
    lon, lat = sky.to_galactic("ra", "dec")
    events = events.withColumn("glon", lon).withColumn("glat", lat)
    got = sorted((r.obs_id, r.msg) for r in quality.events(events, runs).collect())
    assert got == [(2, "events before the run's start"), (3, "events after the run's stop"), (4, "events not in order of time"), (5, "energies that are not positive"), (6, "energies that are not positive"), (7, "events of no run"), (8, "repeated event_id"), (9, "no events")]
    moved = quality.events(events.filter("obs_id = 1").withColumn("glat", F.col("glat") + 0.001), runs.filter("obs_id = 1")).collect()
    assert [r.msg for r in moved] == ["galactic and equatorial coordinates disagree"]
    lacking = {r.msg for r in quality.columns(spark, events.drop("ra").withColumn("dec", F.lit("x")), "events").collect()}
    assert lacking == {"missing column ra", "column dec holds string"}
    gti = spark.createDataFrame([(1, 0.0, 100.0), (2, 5.0, 5.0), (3, -1.0, 4.0), (77, 0.0, 1.0)], "obs_id bigint, start double, stop double")
    told = {(r.obs_id, r.msg) for r in quality.intervals(gti, runs.filter("obs_id < 5")).collect()}
    assert told == {(2, "interval is empty"), (3, "intervals reach out of the run"), (4, "no interval"), (77, "intervals of no run")}


def test_tails(spark):
    xs = [-7.0, -2.6, -1.0, -0.1, 0.0, 1e-9, 0.3, 1.0, 2.49, 2.51, 4.0, 9.0, 26.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", tails.erfc(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-11)
    for r in spark.createDataFrame([(0.5,), (1.0,), (3.7,), (11.9,), (12.0,), (400.0,)], "a double").select("a", tails.log_gamma(F.col("a")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.a), abs=1e-10, rel=1e-11)
    rows = [(k, t) for k in (1, 2, 3, 4, 10, 51, 800) for t in (0.0, 0.01, 1.0, 5.0, 40.0, 700.0, 900.0)]
    for r in spark.createDataFrame(rows, "k int, t double").select("k", "t", tails.chi2_tail(F.col("t"), F.col("k")).alias("q")).collect():
        h = r.t / 2
        if r.k % 2 == 0:
            want = math.fsum(math.exp(i * math.log(h) - h - math.lgamma(i + 1)) if h else float(i == 0) for i in range(r.k // 2))
        else:
            want = math.erfc(math.sqrt(h)) + math.fsum(math.exp((i - 0.5) * math.log(h) - h - math.lgamma(i + 0.5)) for i in range(1, (r.k + 1) // 2) if h)
        assert r.q == pytest.approx(want, rel=1e-8, abs=1e-12)


def test_upper_limits_in_the_chi_square(spark):
    df = spark.createDataFrame([(3.0, 0.5, None), (None, None, 4.0)], "flux double, err double, ul double")
    got = [r.x for r in df.select(stats.chi2_with_limits(F.col("flux"), F.lit(2.0), F.col("err"), F.col("err"), F.col("ul")).alias("x")).collect()]
    assert got == [pytest.approx(4.0), pytest.approx(2 * math.log(math.erfc(0.5) / math.erfc(1.0)))]


def test_wide_disks_and_boxes(spark):
    """Radius 30 on 200 x 200 pixels, against distances of all pairs."""
    rng = np.random.default_rng(0)
    spots = np.unique(rng.integers(0, 200, (12, 2)), axis=0)
    x, y = np.meshgrid(np.arange(200), np.arange(200), indexing="ij")
    near = ((x[..., None] - spots[:, 0]) ** 2 + (y[..., None] - spots[:, 1]) ** 2).min(axis=-1) <= 30.5**2
    mask = spark.createDataFrame([(int(a), int(b)) for a, b in spots], "px int, py int")
    assert {(r.px, r.py) for r in maps.dilate(mask, 30.5, 200, 200).collect()} == set(map(tuple, np.argwhere(near).tolist()))
    bare = ((x[..., None] - spots[:, 0]) ** 2 + (y[..., None] - spots[:, 1]) ** 2).min(axis=-1) == 0
    full = spark.createDataFrame([tuple(p) for p in np.argwhere(~bare).tolist()], "px int, py int")
    inside = ~near & (x >= 30) & (x < 170) & (y >= 30) & (y < 170)
    assert {(r.px, r.py) for r in maps.erode(spark, full, 30.5, 200, 200).collect()} == set(map(tuple, np.argwhere(inside).tolist()))
    values = rng.uniform(size=(60, 60))
    got = [(r.px, r.py) for r in maps.peaks(image(spark, [(i, j, float(values[i, j])) for i in range(60) for j in range(60)]), 0.5, 20).collect()]
    want = [(i, j) for i in range(60) for j in range(60) if values[i, j] > 0.5 and values[i, j] == values[max(0, i - 20) : i + 21, max(0, j - 20) : j + 21].max()]
    assert sorted(got) == want


def test_pairs_of_a_dense_series_up_to_a_lag(spark):
    """Twenty thousand rows in a short time: blocks hold rows, not times, and distant ones never meet."""
    n = 20_000
    rng = np.random.default_rng(5)
    flux = np.round(rng.normal(10, 2, n), 3)
    df = spark.createDataFrame([(1, i, float(f), 1.0) for i, f in enumerate(flux)], "series int, day int, flux double, err double")
    got = {r.lag: (r.sf, r.n) for r in lightcurve.structure_function(df, ["series"], "day", rows=1000, longest=7).collect()}
    for d in range(1, 8):
        a, b = flux[:-d], flux[d:]
        assert got[d] == (pytest.approx(((b - a) ** 2 * a * b).sum() / (a * b).sum()), n - d)
    assert set(got) == set(range(1, 8))


def test_flux_quantities_scale_with_their_models(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5, 0.4, 0.6, 3.0, 16.0), (2, -0.1, 0.5, None, 0.6, 1.1, 0.04)], "k int, norm double, norm_err double, norm_errn double, norm_errp double, norm_ul double, ts double")
    model = fluxes.power_law(F.lit(2.0), F.lit(3.0), F.lit(1.0), F.lit(1.0), F.lit(4.0))
    a, b = fluxes.quantities(df, ["k"], model).orderBy("k").collect()
    assert (a.flux, a.flux_errn, a.flux_ul) == (pytest.approx(2 * 3 * 0.75), pytest.approx(0.4 * 3 * 0.75), pytest.approx(3 * 3 * 0.75))
    assert a.eflux == pytest.approx(2 * 3 * math.log(4)) and a.dnde == pytest.approx(2 * 3 / 4) and a.e2dnde == pytest.approx(6)
    assert (a.sqrt_ts, a.is_ul) == (4.0, False) and (b.sqrt_ts, b.is_ul, b.flux_errn) == (pytest.approx(-0.2), True, None)


def test_pulse_profiles(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.49, 1.0), (0.5, 7.0), (1.0, 7.0)], "phase double, energy double")
    got = {(r.band, r.phase_bin): (r.value, r.unc) for r in fluxes.pulse_profiles(df, [], "phase", "energy", [("all", 0.0, 99.0), ("high", 5.0, 99.0)], 2, F.lit(3.0)).collect()}
    assert got == {("all", 0): (6.0, pytest.approx(3 * math.sqrt(2))), ("all", 1): (6.0, pytest.approx(3 * math.sqrt(2))), ("high", 1): (6.0, pytest.approx(3 * math.sqrt(2)))}


def test_reprojection_stays_in_generated_code(spark):
    """Between frames and projections, with every pixel cut into parts; without a way back to interpreted rows."""
    source = RP.Plane("car", 266.0, -29.0, -0.2, 0.2, 20.0, 20.0, 41, 41)
    target = RP.Plane("tan", 0.0, 0.0, -0.5, 0.5, 20.0, 20.0, 41, 41, "galactic")
    image = source.pixels(spark).selectExpr("px", "py", "cast(px + 41 * py as double) as value")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        whole = RP.reproject(image, source, target, factor=5).agg({"value": "sum"}).first()[0]
        back = RP.interpolate(image, source, target).filter("value > 0").count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert abs(whole - sum(range(41 * 41))) < 1e-6
    assert back > 0
