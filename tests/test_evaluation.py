"""End-to-end evaluation: what is judged per scenario, and that leaving out shared batches changes nothing."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import checks, faults, stages
from tidegauge.plans import contracts
from tidegauge.plans import evaluation as ev
from tidegauge.session import staged
from tidegauge.sources import views

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_shared_batches_are_judged_once(spark):
    """Results and crashes equal those of all rows written once per scenario."""
    pipeline, raw = "payment_processing", views.payments_raw(spark, FOLDER)
    p, listed = ev.PIPELINES[pipeline], faults.catalog(pipeline)
    base = ev.learn(raw, pipeline).freeze()
    results, crashed = ev.scenario_results(raw, pipeline, listed, base)
    scen = staged(faults.apply_scenarios(raw, listed, p.row_id), "scenarios")
    whole = checks.run_contract(p.frames(scen, tuple(ev.RUN)), contracts.CONTRACTS[pipeline], p.orders, ev.RUN, base)
    assert rows(results.select(whole.columns)) == rows(whole)
    want = ev.crashes(scen, p)
    assert rows(crashed.select(want.columns)) == rows(want)


def test_batches_a_fault_cannot_change_are_left_out(spark):
    listed = [faults.Fault("late", "unit_change", "unit_change", "a", field="x", onset=3), faults.Fault("early", "feed_stops", "feed_stops", "b", onset=1),
              faults.Fault("calm", "clean", "clean")]
    raw = spark.createDataFrame([(b, v, 1000.0, f"{b}{v}") for b in (1, 2, 3, None) for v in ("a", "b")],
                                "batch_no int, client_version string, x double, id string")
    part = faults.apply_scenarios(raw, listed, "id", from_onset=True)
    got = {(r.scenario, r.batch_no): r["count"] for r in part.groupBy("scenario", "batch_no").count().collect()}
    assert got == {**{("calm", b): 2 for b in (1, 2, 3, None)}, ("late", 3): 2, ("late", None): 2,
                   **{("early", b): 1 for b in (1, 2, 3)}, ("early", None): 2}
    full = faults.apply_scenarios(raw, listed, "id")
    assert rows(faults.with_clean_past(part, listed).select(full.columns)) == rows(full)
    faulty = listed[:2]  # without a clean run nothing can be left out
    assert rows(faults.apply_scenarios(raw, faulty, "id", from_onset=True)) == rows(faults.apply_scenarios(raw, faulty, "id"))
    assert faults.with_clean_past(part, faulty) is part


def test_repeats_are_found_before_rows_are_repeated(spark):
    """The first row per scenario and key, though faults remove some copies of a key and not others: as ranked in every scenario by itself."""
    listed = [faults.Fault("gone", "feed_stops", "feed_stops", "a", onset=2), faults.Fault("some", "volume_drop", "volume_drop", "b", rate=0.5, onset=1),
              faults.Fault("scaled", "unit_change", "unit_change", "a", field="x", onset=1), faults.Fault("calm", "clean", "clean")]
    raw = spark.createDataFrame(
        [(b, line, None if k == 5 else f"k{k}", v, float(line)) for b in (1, 2) for k in range(40)
         for line, v in ((10 * k + 2, "a"), (10 * k + 1, "b" if k % 2 else "a"), (10 * k + 3, "b"), (10 * k + 4, None))],
        "batch_no int, line_no long, id string, client_version string, x double")
    for part in (False, True):
        got = faults.first_per_scenario(raw, listed, "id", ["batch_no", "id"], ["batch_no", "line_no"], part)
        want = stages.dedup_keep_first(faults.apply_scenarios(raw, listed, "id", part), ["scenario", "batch_no", "id"], ["batch_no", "line_no"])
        assert rows(got.select(want.columns)) == rows(want)
    with pytest.raises(ValueError, match="id"):
        faults.first_per_scenario(raw, [faults.Fault("k", "invalid_enum", "type_change", "a", field="id", value="z")], "id", ["id"], ["line_no"])


def test_only_the_stages_that_are_looked_at_are_built(spark):
    frames = ev.scenario_frames(views.web_raw(spark, FOLDER), "web_analytics", faults.catalog("web_analytics"))
    found = checks.run_contract(frames, contracts.WEB.only("text_drift"), ev.PIPELINES["web_analytics"].orders, ev.RUN)
    assert set(frames) == {"after_ingest"} and found.count() > 0


def test_only_broken_segments_are_read_per_scenario(spark):
    """A checkpoint that counts by the broken segment column reads the others once; whole-batch checks still see every segment."""
    pipeline, raw = "payment_processing", views.payments_raw(spark, FOLDER)
    listed = faults.catalog(pipeline)
    runs = ev.Runs(raw, pipeline, listed, from_onset=True)
    assert faults.segment_column(listed, raw) == "payment_method" and faults.unlike_clean(runs.first, listed, "payment_method") == set()
    read = faults.in_runs(faults.broken_segments(runs.rows, listed, "payment_method", set()), listed, "transaction_id")
    got = {(r.scenario, r.payment_method) for r in read.select("scenario", "payment_method").distinct().collect()}
    assert {s for s in got if s[0] != "clean"} == {(f.scenario, f.segment) for f in listed if f.kind not in ("clean", "feed_stops")}
    contract = contracts.Contract(pipeline, (contracts.Checkpoint("after_clean", "payment_method", min_rows=1, check_segment_volume=True, fields=(
        ("status", (contracts.Spec("schema", allowed=("settled", "pending")), contracts.Spec("schema", max_distinct=3))),
        ("amount_usd", (contracts.Spec("schema", dtype="numeric"), contracts.Spec("unit", log_ratio_threshold=0.3))))),))
    base = ev.learn(raw, pipeline).freeze()
    whole = checks.run_contract(runs.frames(), contract, runs.p.orders, ev.RUN, base)
    assert rows(ev.run_scenarios(runs, contract, base).select(whole.columns)) == rows(whole)


def test_scenarios_that_change_other_segments_keep_all_rows(spark):
    """Where a fault removes the first of equal rows, one of another segment takes its place: that run is read whole."""
    listed = [faults.Fault("gone", "feed_stops", "feed_stops", "a", onset=2), faults.Fault("scaled", "unit_change", "unit_change", "a", field="x", onset=1),
              faults.Fault("calm", "clean", "clean")]
    raw = spark.createDataFrame([(b, line, f"k{k}", v, 1.0) for b in (1, 2) for k in range(3) for line, v in ((10 * k, "a"), (10 * k + 1, "b"))],
                                "batch_no int, line_no long, id string, client_version string, x double")
    first = faults.first_runs(faults.with_runs(raw, listed, "id", True), listed, "id", ["batch_no", "id"], ["batch_no", "line_no"])
    wide = faults.unlike_clean(first, listed, "client_version")
    assert wide == {"gone"}

    def counted(df):
        return df.groupBy("scenario", "batch_no", S.segment_of("client_version").alias("_seg")).agg(F.count("*").alias("n"), F.sum("x").alias("x"))

    narrow = counted(faults.in_runs(faults.broken_segments(first, listed, "client_version", wide), listed, "id"))
    got = faults.with_clean_segments(narrow, listed, wide)
    want = counted(faults.in_runs(first, listed, "id"))
    assert rows(got.select(want.columns)) == rows(want)
    assert faults.segment_column(listed[:2], raw) is None  # no clean run
    assert faults.segment_column([*listed, faults.Fault("m", "invalid_enum", "type_change", "a", field="client_version", value="z")], raw) is None
