"""Findings of reviews, each by a small case that was wrong before."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions.axis import Axis
from photonlake.llm import skew
from photonlake.operators import lightcurve, maps, reduction


def test_middle_of_two_edges(spark):
    """Differences to both edges round to unequal values at 5.55, which is the middle of 1.03 and 10.07."""
    df = spark.createDataFrame([(0.1,), (0.564,), (0.566,), (5.549,), (5.55,), (5.551,), (99.0,), (float("inf"),), (-float("inf"),)], "x double")
    got = [r.e for r in df.select(Axis("energy", (0.1, 1.03, 10.07)).nearest_edge(df.x).alias("e")).collect()]
    assert got == [0.1, 0.1, 1.03, 1.03, 10.07, 10.07, 10.07, 10.07, 0.1]


def test_log_axis_at_zero_and_below(spark):
    axis = Axis.from_bounds("energy", 0.0123, 123.0, 8, "log")
    df = spark.createDataFrame([(0.0,), (-1.0,), (0.0123,), (122.0,), (float("inf"),), (None,)], "x double")
    out = df.select(axis.pixel(df.x).alias("p"), axis.coordinate(axis.pixel(df.x)).alias("back"), axis.fill_index(df.x).alias("i")).collect()
    assert out[0].p == -math.inf and out[0].back == 0.0
    assert math.isnan(out[1].p) and math.isnan(out[1].back)
    assert out[4].p == math.inf and out[5].p is None
    assert [r.i for r in out] == [None, None, 0, 7, None, None]


@pytest.mark.parametrize("group", [16, 2048])
def test_pair_sums_leave_a_group_once_for_each_lag(spark, group):
    """A series longer than a group beside short ones: all pairs by lag; a short series' sums are complete without another shuffle."""
    rng = np.random.default_rng(3)
    rows = [(k, int(t), float(rng.uniform(1, 9)), float(rng.uniform(0.1, 1))) for k, n in ((1, 70), (2, 9), (3, 1)) for t in rng.choice(90, n, replace=False)]
    rows += [(1, 10**9, 2.0, 0.5), (None, 4, 1.0, 1.0), (None, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series int, t bigint, flux double, err double")
    lag = lambda d: (np.rint(d).astype(np.int64), d > 0)
    terms = lambda a, b: [a["flux"] * b["flux"]]
    sums = lightcurve.pair_sums(df, df, ["series"], lag, terms, ["p"], later=True, rows=4, group=group)
    got = {(r.series, r.lag): (r.n, r.p) for r in sums.collect()}
    want = {}
    for k, t, f, _ in rows:
        for j, u, g, _ in rows:
            if k is not None and k == j and u > t:
                n, p = want.get((k, u - t), (0, 0.0))
                want[k, u - t] = (n + 1, p + f * g)
    assert got == {k: (n, pytest.approx(p)) for k, (n, p) in want.items()}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    if group == 2048:
        assert "mapInArrow" not in plan and "HashAggregate(keys=[series" not in plan.split("FlatMapGroupsInArrow")[0]
    else:
        both = lightcurve.pair_sums(df, df.withColumn("t", F.col("t") + 0), ["series"], lag, terms, ["p"], later=True, rows=4, group=group)
        assert {(r.series, r.lag): (r.n, r.p) for r in both.collect()} == {k: (n, pytest.approx(p)) for k, (n, p) in want.items()}
        near = lightcurve.pair_sums(df, df, ["series"], lambda d: (np.rint(d).astype(np.int64), (d > 0) & (d <= 7)), terms, ["p"], later=True, rows=4, longest=7, group=group)
        assert {(r.series, r.lag): r.n for r in near.collect()} == {k: n for k, (n, _) in want.items() if k[1] <= 7}


def test_parts_of_many_keys_come_in_few_calls(spark):
    """A call for each key and part made thousands of small frames; a key whose rows are in several batches is merged once."""
    calls = spark.sparkContext.accumulator(0)
    df = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 997).alias("k"), "id")

    def count(rows):
        calls.add(1)
        return rows.groupby("k", as_index=False, dropna=False).agg(n=("id", "size"))

    merge = lambda parts: parts.groupby("k", as_index=False, dropna=False).agg(n=("n", "sum"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = [(r.k, r.n) for r in maps.per_key(df, ["k"], count, "k bigint, n bigint", merge).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i in range(4000):
        k = i % 997 if i % 5 else None
        want[k] = want.get(k, 0) + 1
    assert len(got) == len(want) and dict(got) == want
    assert calls.value < 200


def test_reflected_regions_walk_once(spark):
    """Taking regions apart filters on them; the walk stood in that filter again, and every run of one pointing walked by itself."""
    obs = spark.createDataFrame([(i, 0.5 * (i % 3), 0.5, 7) for i in range(30)] + [(90, 0.0, 0.0, 7), (91, None, 1.0, 7)], "obs_id int, lon_pnt double, lat_pnt double, rest int")
    out = reduction.reflected(obs, 0.2, [(0.9, 0.3, 0.25)])
    assert out.columns == [*obs.columns, "regions"]
    n = {r.obs_id: r.regions for r in out.collect()}
    assert len(n) == 32 and n[90] == n[91] == [] and all(n[i] == n[i % 3] and n[i] for i in range(30))
    plan = out.select("obs_id", F.explode("regions"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_rows_that_are_not_wanted_are_not_shuffled(spark):
    """A semi join with more ids than are broadcast shuffled every text; a filter now leaves out most of them before."""
    docs = spark.range(4000).select(F.when(F.col("id") % 50 != 7, F.col("id") * 977 - 100).alias("doc_id"), F.lit("text").alias("text"))
    named = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in named:
        spark.conf.set(key, "-1")
    try:
        for ids, most, through in (([977 * i - 100 for i in range(0, 4000, 100)], 4096, 400), ([-100, 5], 4096, 100), ([], 4096, 100), ([977 * i - 100 for i in range(3500)], 1, 4000)):
            wanted = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
            out = skew.among(docs, wanted, "doc_id", most)
            rows = out._jdf.collectAsList()
            assert sorted(r.getLong(0) for r in rows) == [i for i in ids if i in {977 * k - 100 for k in range(4000) if k % 50 != 7}]
            assert out.columns == ["doc_id", "text"]
            assert sum(_written(out._jdf.queryExecution().executedPlan())) <= through + 2 * len(ids)
    finally:
        for key in named:
            spark.conf.unset(key)


def _written(node) -> list[int]:
    """Rows that each exchange of an executed plan has written."""
    inner = [getattr(node, name)() for kind, name in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if node.getClass().getSimpleName().endswith(kind)]
    children = inner or [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.metrics().contains("shuffleRecordsWritten") else []
    return own + [n for c in children for n in _written(c)]
