"""Exact order statistics against brute force, with one hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import ordered
from tidegauge.functions.scalars import hash32
from tidegauge.operators import faults, stages


def skewed(n=6000, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", np.array(["a", "b", "c"])[rng.integers(0, 3, n)])
    x = np.round(rng.lognormal(3, 2, n), 3) * np.where(rng.random(n) < 0.2, -1, 1)
    x[rng.random(n) < 0.05] = 0.0
    return pd.DataFrame({"k": key, "x": x, "id": np.arange(n)})


def test_quantiles_equal_pandas(spark):
    pdf = skewed()
    got = ordered.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", {"q0": 0.0, "q5": 0.5, "q95": 0.95, "q1": 1.0}).toPandas()
    for r in got.itertuples():
        v = pdf[pdf.k == r.k].x
        assert [r.q0, r.q5, r.q95, r.q1] == pytest.approx([v.min(), v.median(), v.quantile(0.95), v.max()], abs=1e-9)
    assert set(got.k) == set(pdf.k)


def test_weighted_quantile_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", None, 9), ("b", None, 2)], "k string, x double, w long")
    got = ordered.exact_quantiles(df, ["k"], "x", {"m": 0.5}, weight="w").collect()
    assert [(r.k, r.m) for r in got] == [("a", 1.0)]


def test_prefix_sums_equal_cumsum(spark):
    pdf = skewed()
    counts = pdf.groupby(["k", "x"]).size().reset_index(name="n")
    got = ordered.prefix_sums(spark.createDataFrame(counts), ["k"], "x", ["n"]).toPandas().sort_values(["k", "x"])
    want = counts.sort_values(["k", "x"]).assign(c=lambda d: d.groupby("k").n.cumsum())
    assert got.cum_n.tolist() == want.c.tolist()
    assert (got.groupby("k").all_n.first() == counts.groupby("k").n.sum()).all()


def test_order_slice_is_monotone(spark):
    xs = sorted(np.random.default_rng(1).normal(0, 1e4, 3000).tolist() + [0.0, 1e-9, -1e-9, 1e300, -1e300])
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ordered.order_slice("x").alias("s")).orderBy("i").collect()
    s = [r.s for r in got]
    assert s == sorted(s)


def close_values(n=5000, seed=9):
    """All values within one per cent, most of them within a millionth; few slices of the logarithmic scale."""
    rng = np.random.default_rng(seed)
    x = np.unique(np.r_[1000 + rng.random(n // 5) * 9, 1003 + rng.random(n) * 1e-3])
    return pd.DataFrame({"k": "hot", "x": x, "n": rng.integers(1, 5, len(x))})


def test_close_values_are_cut_at_values_of_their_own(spark):
    pdf = pd.concat([close_values(), pd.DataFrame({"k": "cold", "x": [1000.5, 1003.0], "n": [1, 1]})])
    df = spark.createDataFrame(pdf)
    assert df.where("k = 'hot'").select(ordered.order_slice("x")).distinct().count() <= 2
    parts = ordered.in_parts(df, ["k"], "x", most=500, parts=64).toPandas().sort_values(["k", "x"])
    hot, cold = parts[parts.k == "hot"], parts[parts.k == "cold"]
    sizes = hot.groupby(["_slice", "_part"]).size()
    assert 40 <= len(sizes) <= 140 and sizes.max() < len(hot) / 5 and (cold["_part"] == 0).all()
    places = hot[["_slice", "_part"]].values.tolist()
    assert places == sorted(places)
    again = ordered.in_parts(df.repartition(7), ["k"], "x", most=500, parts=64).toPandas().sort_values(["k", "x"])
    assert again[["_slice", "_part"]].values.tolist() == parts[["_slice", "_part"]].values.tolist()


def test_ranks_over_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ordered.in_parts, "__defaults__", (300, 32))
    pdf = close_values()
    df = spark.createDataFrame(pdf)
    got = ordered.prefix_sums(df, ["k"], "x", ["n"]).toPandas().sort_values("x")
    assert got.cum_n.tolist() == pdf.sort_values("x").n.cumsum().tolist() and set(got.all_n) == {pdf.n.sum()}
    q = ordered.exact_quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}, weight="n").first()
    every = pd.Series(np.repeat(pdf.x.values, pdf.n.values))
    assert [q.a, q.b, q.c, q.d] == pytest.approx([every.quantile(p) for p in (0, 0.37, 0.5, 1)], abs=1e-9)


def test_bisection_counts_cuts(spark):
    cuts = [float(i) for i in range(0, 3000, 3)]
    rows = [(v, cuts) for v in (-1.0, 0.0, 2.9, 3.0, 2997.0, 5000.0)] + [(1.0, []), (1.0, None)]
    got = [r.n for r in spark.createDataFrame(rows, "v double, cuts array<double>").select(ordered.at_or_below(F.col("cuts"), F.col("v")).alias("n")).collect()]
    assert got == [0, 1, 1, 2, 1000, 1000, 0, 0]


def test_smallest_by_hash_is_exact(spark):
    df = spark.createDataFrame(skewed()).withColumn("h", hash32("42", "id"))
    got = ordered.smallest_by_hash(df, ["k"], "h", ["id"], 200).toPandas()
    want = df.toPandas().sort_values(["h", "id"]).groupby("k").head(200)
    assert set(got.id) == set(want.id)


def test_positions_and_finding_faults(spark):
    rows = [(b, i * 40_000, f"e{b}-{i}") for b in (1, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "batch_no int, line_no long, event_id string")
    pos = faults.row_positions(df, ["batch_no", "line_no"]).orderBy("batch_no", "line_no").collect()
    assert [r._pos for r in pos] == list(range(50))
    assert faults.cut_80(df, ["batch_no", "line_no"]).count() == 10
    assert faults.null_half(df, "event_id", ["batch_no", "line_no"]).where("event_id is null").count() == 25
    assert faults.duplicate_rows(df, ["batch_no", "line_no"]).where("event_id = 'e1-0'").count() == 101


def test_dedup_keeps_first_with_hot_copies(spark):
    rows = [("hot", 1, i) for i in range(2000)] + [(f"k{i}", 2, i) for i in range(50)] + [(None, 1, 7), (None, 1, 3)]
    df = spark.createDataFrame(rows, "event_id string, batch_no int, line_no int")
    out = stages.dedup_keep_first(df, ["event_id"], ["batch_no", "line_no"])
    got = {r.event_id: r.line_no for r in out.collect()}
    assert len(got) == 52 and got["hot"] == 0 and got[None] == 3
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_infinities_have_a_place(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", -inf), ("a", -1.5), ("a", 0.0), ("a", 2.0), ("a", inf), ("b", inf), ("b", inf)], "k string, x double")
    q = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "x", {"mid": 0.5, "top": 1.0, "low": 0.0}).collect()}
    assert (q["a"].low, q["a"].mid, q["a"].top) == (-inf, 0.0, inf) and q["b"].mid == inf
