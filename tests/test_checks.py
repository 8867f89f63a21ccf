"""Checks on hand-made batches: each catches its fault, passes clean data, and declines tiny batches."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import baseline, checks, drift
from tidegauge.plans.contracts import Checkpoint, Contract, Spec, WEB, contract_from_dict

KEYS = ["batch_no"]


def run(df, *fields, base=None, seg="seg", **cp):
    point = Checkpoint("cp", seg, fields=tuple(fields), **cp)
    return checks.run_checkpoint(df, "p", point, 1, KEYS, base).orderBy("check_seq", "segment").collect()


def frame(spark, values, kind="double", seg="v1", batch=1):
    return spark.createDataFrame([(batch, seg, i, v) for i, v in enumerate(values)], f"batch_no int, seg string, event_id int, f {kind}")


def learned(df, spec, volume=False):
    plan = Contract("p", (Checkpoint("cp", "seg", check_segment_volume=volume, fields=(("f", (spec,)),)),))
    return baseline.build({"cp": df}, plan, df.select("batch_no")).freeze()


def usual(df):
    return baseline.segment_volume(baseline.daily_counts(df, "cp", "seg"), df.select("batch_no"))


def numeric_base(spark, values):
    df = frame(spark, values)
    return learned(df, Spec("numeric_drift"), volume=True)


def text_base(spark, values):
    return learned(frame(spark, values, "string"), Spec("text_drift"))


STEADY = [7.5 + (i * 5 % 17) * 0.35 for i in range(420)]


def by_check(rows):
    return {r.check: r for r in rows}


def test_null_rate(spark):
    spec = ("f", (Spec("nulls", max_null_rate=0.1),))
    bad = run(frame(spark, [None] * 10 + [1.0] * 30), spec)[0]
    assert (bad.status, bad.message) == ("fail", "null rate 25.0% exceeds the 10.0% limit")
    assert run(frame(spark, [None] * 4 + [1.0] * 36), spec)[0].status == "pass"
    tiny = run(frame(spark, [1.0, 2.0]), spec)[0]
    assert (tiny.status, tiny.message) == ("insufficient_data", "only 2 rows, below the minimum of 30")


def test_nan_is_missing(spark):
    assert run(frame(spark, [float("nan")] * 20 + [1.0] * 20), ("f", (Spec("nulls", max_null_rate=0.1),)))[0].status == "fail"


def test_range_counts_only_values(spark):
    spec = ("f", (Spec("range", min=0.0, max=5.0),))
    bad = run(frame(spark, [9.0] + [1.0] * 39 + [None] * 5), spec)[0]
    assert (bad.status, bad.rows, bad.message) == ("fail", 40, "2.5% of values fall outside [0.0, 5.0]")
    few = run(frame(spark, [1.0] * 10 + [None] * 40), spec)[0]
    assert few.message == "only 10 non-null rows, below the minimum of 30"
    assert run(frame(spark, [None] * 40), spec)[0].status == "insufficient_data"


def test_schema_volume_keyset_cardinality(spark):
    df = frame(spark, ["a"] * 20 + ["b"] * 15 + ["x"], "string")
    rows = by_check(run(df, ("f", (Spec("schema", dtype="numeric"), Spec("schema", allowed=("a", "b")), Spec("schema", max_distinct=2))),
                        ("gone", (Spec("schema", dtype="object"), Spec("range", min=0.0))), min_rows=50))
    assert rows["volume"].message == "36 rows, expected between 50 and None"
    assert rows["schema:f"].message == "'f' is object, expected numeric"
    assert (rows["key_set:f"].status, rows["key_set:f"].message) == ("warn", "unexpected values: x")
    assert rows["cardinality:f"].message == "3 distinct values, expected at most 2"
    assert rows["schema:gone"].status == "fail" and rows["range:gone"].status == "error"


def test_text_in_a_number_crashes_the_range_check_once(spark):
    df = frame(spark, [1.0] * 39 + [None]).withColumn("f_kind", F.when(F.col("f").isNull(), "text").otherwise("number"))
    rows = run(df, ("f", (Spec("schema", dtype="numeric"), Spec("range", min=0.0), Spec("nulls", max_null_rate=0.0))))
    assert [(r.check, r.status, r.field) for r in rows] == [
        ("schema:f", "fail", "f"), ("range:f", "error", None), ("null_rate:f", "pass", "f")]


def test_segments_are_judged_apart_and_missing_ones_kept(spark):
    df = frame(spark, [1.0] * 300).unionByName(frame(spark, [None] * 40, seg="v2")).unionByName(frame(spark, [1.0] * 40, seg=None))
    rows = run(df, ("f", (Spec("nulls", max_null_rate=0.2),)))
    assert {r.segment: r.status for r in rows} == {"v1": "pass", "v2": "fail", "nan": "pass"}
    whole = run(df, ("f", (Spec("nulls", max_null_rate=0.2),)), seg=None)
    assert [(r.segment, r.status) for r in whole] == [(None, "pass")]


def test_unit_psi_ks(spark):
    base = numeric_base(spark, STEADY)
    spec = ("f", (Spec("unit"), Spec("numeric_drift")))
    same = by_check(run(frame(spark, STEADY), spec, base=base))
    assert {k: r.status for k, r in same.items()} == {"unit:f": "pass", "psi:f": "pass", "ks:f": "pass"}
    moved = by_check(run(frame(spark, [v * 10 for v in STEADY[:33]]), spec, base=base))
    assert {r.status for r in moved.values()} == {"fail"}
    assert "moved by a factor of 10.0x" in moved["unit:f"].message
    tiny = run(frame(spark, [3.0, 3.2]), spec, base=base)
    assert {r.status for r in tiny} == {"insufficient_data"}
    other = run(frame(spark, STEADY, seg="new"), spec, base=base)
    assert {r.message for r in other} == {"no baseline for this field/segment yet"}
    zero = by_check(run(frame(spark, [0.0] * 40), spec, base=base))
    assert "factor of infx" in zero["unit:f"].message and zero["unit:f"].metric is None


def test_psi_of_a_constant_baseline_is_zero(spark):
    base = numeric_base(spark, [2.0] * 100)
    assert by_check(run(frame(spark, [9.0] * 40), ("f", (Spec("numeric_drift"),)), base=base))["psi:f"].metric == 0.0


def test_ks_equals_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    ref, cur = np.round(rng.normal(0, 1, 400), 2), np.round(rng.normal(0.4, 1.2, 150), 2)
    base = numeric_base(spark, ref.tolist())
    df = frame(spark, cur.tolist()).withColumn("_seg", F.col("seg"))
    row = drift.ordered_stats(df, KEYS, "f", base.values, "cp").collect()[0]
    points = np.concatenate([ref, cur])
    d = max(abs((ref <= p).mean() - (cur <= p).mean()) for p in points)
    assert row.ks_d == pytest.approx(d, abs=1e-12) and row.median == pytest.approx(np.median(cur))
    assert (row.ks_n, row.ks_m) == (400, 150)


def test_psi_equals_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    ref, cur = rng.lognormal(1, 0.5, 700), rng.lognormal(1.2, 0.5, 300)
    base = numeric_base(spark, ref.tolist())
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.histogram(ref, edges)[0] / 700 + 1e-6
    c = np.histogram(cur, edges)[0] / 300 + 1e-6
    got = by_check(run(frame(spark, cur.tolist()), ("f", (Spec("numeric_drift"),)), base=base))["psi:f"].metric
    assert got == pytest.approx(float(np.sum((c - r) * np.log(c / r))), abs=1e-9)


def test_text_drift(spark):
    base = text_base(spark, [f"queue {i} is slow to answer" for i in range(500)])
    spec = ("f", (Spec("text_drift"),))
    same = by_check(run(frame(spark, [f"queue {i} is slow to answer" for i in range(30)], "string"), spec, base=base))
    assert {r.status for r in same.values()} == {"pass"}
    new = by_check(run(frame(spark, [f"disk quota of volume {i} used up" for i in range(30)], "string"), spec, base=base))
    assert new["oov_rate:f"].status == "fail" and new["oov_rate:f"].metric == 1.0
    t = new["template_drift:f"]
    assert (t.status, t.metric) == ("warn", 1.0) and "e.g. ['disk quota of volume <NUM> used up']" in t.message
    none = by_check(run(frame(spark, ["12345"] * 40, "string"), spec, base=base))
    assert none["oov_rate:f"].metric == 0.0


def volumes(spark, counts):
    rows = [(b, s, i) for (b, s), n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "batch_no int, seg string, i int")


def test_segment_volume(spark):
    learn = volumes(spark, {(1, "v1"): 71, (1, "v2"): 40, (2, "v1"): 66, (2, "v2"): 38, (3, "v1"): 75, (3, "v2"): 44})
    base = baseline.Baselines(volume=usual(learn))
    got = {(r.batch_no, r.segment): r for r in run(volumes(spark, {(4, "v1"): 70, (5, "v1"): 70, (5, "v2"): 8}), base=base, check_segment_volume=True)}
    assert got[4, "v2"].message == "'v2' silent this batch" and got[4, "v1"].status == "pass"
    assert got[5, "v2"].message == "'v2' volume is 20% of its usual 40 rows"
    empty = run(volumes(spark, {(4, "v1"): 3}), base=None, check_segment_volume=True)
    assert [(r.status, r.message) for r in empty] == [("insufficient_data", "no segment-volume baseline yet")]
    lost = run(volumes(spark, {(4, "v1"): 3}), base=base, seg="nope", check_segment_volume=True)
    assert lost[0].message == "no segment column to count by"


def test_silent_batches_fail(spark):
    """Batches that send nothing have no row to group: they are known from a list, or from an earlier checkpoint; never from gaps."""
    learn = volumes(spark, {(b, v): n for b in (1, 2, 3) for v, n in (("v1", 70), ("v2", 40))})
    base = baseline.Baselines(volume=usual(learn))
    point = Checkpoint("cp", "seg", min_rows=5, check_segment_volume=True)
    df = volumes(spark, {(4, "v1"): 70, (4, "v2"): 40, (7, "v1"): 70, (7, "v2"): 40})
    result = lambda out: {(r.batch_no, r.check, r.segment): (r.status, r.rows, r.message) for r in out.collect()}
    assert {(k[0], v[0]) for k, v in result(checks.run_checkpoint(df, "p", point, 1, KEYS, base)).items()} == {(4, "pass"), (7, "pass")}
    got = result(checks.run_checkpoint(df, "p", point, 1, KEYS, base, checks.numbered_batches(spark, 4, 7)))
    assert len(got) == 4 * 3
    for b in (5, 6):
        assert got[b, "volume", None] == ("fail", 0, "0 rows, expected between 5 and None")
        assert got[b, "segment_volume", "v1"] == ("fail", 0, "'v1' silent this batch")
    assert {v[0] for k, v in got.items() if k[0] in (4, 7)} == {"pass"}
    given = result(checks.run_checkpoint(df, "p", point, 1, KEYS, base, spark.createDataFrame([(4,), (9,)], "batch_no int")))
    assert {k[0] for k, v in given.items() if v[0] == "fail"} == {9} and {k[0] for k in given} == {4, 7, 9}
    none = result(checks.run_checkpoint(df.limit(0), "p", point, 1, KEYS, base, spark.createDataFrame([(4,)], "batch_no int")))
    assert {v[0] for v in none.values()} == {"fail"} and len(none) == 3
    # a stage that loses a batch which the one before it had
    both = {"cp": df.where("batch_no = 4"), "in": df}
    plan = Contract("p", (Checkpoint("in", "seg", min_rows=5), Checkpoint("cp", "seg", min_rows=5)))
    lost = checks.run_contract(both, plan, {"in": 1, "cp": 2}, KEYS).where("checkpoint = 'cp' and status = 'fail'").collect()
    assert [r.batch_no for r in lost] == [7]


def test_gaps_in_batch_numbers_are_no_failures(spark):
    """Dates, far numbers and numbers beyond 32 bits as batches: one row each, nothing in between, and one scan of the input."""
    rows = [(b, "v1", i) for b in (20260131, 20260201, 3_000_000_000) for i in range(40)]
    df = spark.createDataFrame(rows, "batch_no long, seg string, f int")
    point = Checkpoint("cp", "seg", min_rows=5, fields=(("f", (Spec("range", min=0.0), Spec("nulls", max_null_rate=0.1))),))
    out = checks.run_checkpoint(df, "p", point, 1, KEYS, expected=df.select("batch_no"))
    assert sorted((r.batch_no, r.status) for r in out.where("check = 'volume'").collect()) == [
        (20260131, "pass"), (20260201, "pass"), (3_000_000_000, "pass")]
    plan = checks.run_checkpoint(df, "p", point, 1, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 0  # only the counted table is read, the input was read once


def test_merged_baselines_equal_a_baseline_of_all_batches(spark):
    rows = [(b, f"v{i % 3}" if b > 1 or i % 3 else "v0", float((i * 37 + b * 11) % 101), f"queue {i % 7} of {b} is slow") for b in (1, 2, 3) for i in range(80 * b)]
    df = spark.createDataFrame(rows, "batch_no int, seg string, f double, g string")
    plan = Contract("p", (Checkpoint("cp", "seg", check_segment_volume=True, fields=(("f", (Spec("unit"),)), ("g", (Spec("text_drift"),)))),))
    part = lambda *b: baseline.build({"cp": df.where(F.col("batch_no").isin(*b))}, plan, df.where(F.col("batch_no").isin(*b)))
    whole, merged = part(1, 2, 3).freeze(), part(1, 2).freeze().merge(part(3).freeze())
    for name in vars(whole):
        a, b = ([tuple(r) for r in getattr(x, name).select(*getattr(whole, name).columns).collect()] for x in (whole, merged))
        shown = lambda t: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t)
        assert shown(a) == shown(b), name


@pytest.mark.parametrize("n,m", [(5, 5), (7, 4), (12, 9), (40, 31), (30, 30)])
def test_exact_ks_tail(n, m):
    """Against a count of all lattice paths, at, just below and just above every step of the statistic."""
    from fractions import Fraction
    from functools import lru_cache
    from math import comb
    from tidegauge.functions.stats import ks_exact_tail

    def count(d):
        @lru_cache(None)
        def inside(i, j):
            if i < 0 or j < 0 or abs(Fraction(i, n) - Fraction(j, m)) >= d:
                return 0
            return 1 if i == j == 0 else inside(i - 1, j) + inside(i, j - 1)
        return 1 - Fraction(inside(n, m), comb(n + m, n))

    steps = sorted({abs(Fraction(i, n) - Fraction(j, m)) for i in range(n + 1) for j in range(m + 1)} - {Fraction(0)})
    for d in steps[:: max(1, len(steps) // 12)]:
        assert ks_exact_tail(float(d), n, m) == pytest.approx(float(count(d)), abs=1e-12)


def test_exact_ks_of_large_samples_meets_the_series():
    from tidegauge.functions.stats import ks_exact_tail
    assert ks_exact_tail(0.05, 4000, 2500) == pytest.approx(2 * sum((-1) ** (k - 1) * 2.718281828 ** (-2 * k * k * 0.05**2 * 4000 * 2500 / 6500) for k in range(1, 9)), rel=0.05)


def test_segment_volume_baseline_counts_silence_only_after_first_seen(spark):
    out = usual(volumes(spark, {(1, "a"): 10, (2, "b"): 5})).collect()
    assert {r.segment: list(r.batch_counts) for r in out} == {"a": [10, 0], "b": [5]}


def test_contract_config():
    c = contract_from_dict({"pipeline": "p", "checkpoints": [{"checkpoint": "cp", "min_rows": 5, "fields": {
        "f": {"checks": [{"type": "range", "range": {"min": 0, "max": 2}}, {"type": "unit"}]}}}]})
    assert c.at("cp").fields[0][1][0].max == 2
    with pytest.raises(ValueError):
        Spec("unit", baseline_stat="mode")
    assert checks.run_contract({}, Contract("p", ()), {}, KEYS) is None


def test_a_check_that_cannot_be_built_is_an_error_row(spark, monkeypatch):
    def boom(self, field, limit):
        raise RuntimeError("no")
    monkeypatch.setattr(checks._Compiler, "nulls", boom)
    rows = run(frame(spark, [1.0] * 40), ("f", (Spec("nulls"), Spec("range", min=0.0))))
    assert [(r.check, r.status, r.message) for r in rows] == [
        ("nulls:f", "error", "check crashed: RuntimeError: no"), ("range:f", "pass", "")]


def test_one_dead_segment_and_an_infinite_value_cost_nothing_else(spark):
    """A segment without values is `insufficient_data`, an infinite value is judged; neither stops the checkpoint."""
    rows = [("a", float(i % 50)) for i in range(300)] + [("b", None)] * 60 + [("c", float(i % 50)) for i in range(299)] + [("c", float("inf"))]
    df = spark.createDataFrame([(1, f"e{i}", s, x) for i, (s, x) in enumerate(rows)], "batch_no int, event_id string, seg string, f double")
    base = learned(df, Spec("numeric_drift"))
    cp = Checkpoint("cp", "seg", fields=(("f", (Spec("unit", log_ratio_threshold=0.3), Spec("numeric_drift", psi_threshold=0.1, ks_alpha=0.01),
                                                Spec("range", min=0.0, max=100.0))),))
    out = {(r.check, r.segment): r.status for r in checks.run_checkpoint(df, "p", cp, 1, KEYS, base).collect()}
    for check in ("unit:f", "psi:f", "ks:f"):
        assert out[check, "a"] == "pass" and out[check, "b"] == "insufficient_data" and out[check, "c"] == "pass"
    assert out["range:f", "b"] == "insufficient_data" and out["range:f", "c"] == "fail"


def test_text_where_numbers_belong_is_one_error_row_a_check(spark):
    df = spark.createDataFrame([(1, f"e{i}", "a" if i % 2 else "b", str(i) if i % 10 else "n/a") for i in range(200)],
                               "batch_no int, event_id string, seg string, f string")
    base = learned(df.where("f <> 'n/a'"), Spec("numeric_drift"))
    cp = Checkpoint("cp", "seg", min_rows=1, fields=(("f", (Spec("range", min=0.0), Spec("unit"), Spec("numeric_drift"), Spec("nulls", max_null_rate=0.5))),))
    rows = checks.run_checkpoint(df, "p", cp, 1, KEYS, base).collect()
    bad = [(r.check, r.message) for r in rows if r.status == "error"]
    assert sorted(bad) == [(c, "check cannot run: 20 values are no numbers") for c in ("ks:f", "psi:f", "range:f", "unit:f")]
    assert {(r.check, r.status) for r in rows if r.status != "error"} == {("null_rate:f", "pass"), ("volume", "pass")}


def test_baselines_keep_every_value(spark):
    df = spark.range(30_000).select(F.lit(1).alias("batch_no"), F.col("id").cast("string").alias("event_id"), F.lit("a").alias("seg"),
                                    F.col("id").cast("double").alias("f"))
    base = learned(df, Spec("numeric_drift"))
    assert base.values.agg(F.sum("n")).first()[0] == 30_000
    edges = base.numeric.first().edges
    assert edges[0] == 0 and edges[-1] == 29_999 and sum(base.numeric.first().bin_counts) == 30_000
