"""Alert lifecycle, guard modes, faults and scoring."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import alerts, faults, guard, scoring
from tidegauge.operators.checks import RESULT_FIELDS

COLS = ["batch_no", "pipeline", "checkpoint", "cp_order"] + [n for n, _ in RESULT_FIELDS]
TYPES = ["int", "string", "string", "int"] + [t for _, t in RESULT_FIELDS]


def results(spark, *rows):
    """rows: (batch, checkpoint, seq, check, field, segment, status, message)"""
    full = []
    for b, cp, seq, check, field, seg, status, msg in rows:
        v = dict(batch_no=b, pipeline="p", checkpoint=cp, cp_order={"a": 1, "b": 2}[cp], check_seq=seq, check=check,
                 check_type="nulls", field=field, segment=seg, status=status, message=msg)
        full.append(tuple(v.get(c) for c in COLS))
    return spark.createDataFrame(full, ", ".join(f"`{c}` {t}" for c, t in zip(COLS, TYPES)))


def bad(b, cp="a", msg="x", status="fail", seg=None, seq=1, field="f"):
    return (b, cp, seq, f"k:{field}", field, seg, status, msg)


def good(b, cp="a"):
    return (b, cp, 9, "k:g", "g", None, "pass", "")


def test_one_alert_while_failing_and_a_new_one_after(spark):
    r = results(spark, bad(1), bad(2), good(3), bad(4), good(4))
    e = alerts.episodes(r).orderBy("first_batch").collect()
    assert [(x.first_batch, x.last_batch, x.closed_batch) for x in e] == [(1, 2, 3), (4, 4, None)]
    assert [x.batch_no for x in alerts.changes(r).orderBy("batch_no").collect()] == [1, 4]


def test_only_its_own_checkpoint_closes_an_alert(spark):
    r = results(spark, bad(1, "a"), good(2, "b"), bad(3, "a"))
    assert [(x.first_batch, x.last_batch) for x in alerts.episodes(r).collect()] == [(1, 3)]


def test_insufficient_data_closes(spark):
    r = results(spark, bad(1), bad(2, status="insufficient_data"))
    assert alerts.open_alerts(r).count() == 0


def test_severity_rises_and_messages_change(spark):
    r = results(spark, bad(1, status="warn", msg="m"), bad(2, msg="m"), bad(3, status="warn", msg="n"), bad(3, status="warn", msg="o", seq=2))
    c = alerts.changes(r).orderBy("batch_no", "check_seq").collect()
    assert [(x.batch_no, x.severity, x.message) for x in c] == [
        (1, "medium", "k:f: m"), (2, "high", "k:f: m"), (3, "high", "k:f: n"), (3, "high", "k:f: o")]
    last = alerts.latest(r).collect()[0]
    assert (last.severity, last.message, last.first_batch, last.alert_id) == ("high", "k:f: o", 1, "p:f:all")


def test_segment_message_and_shared_id_across_checkpoints(spark):
    r = results(spark, bad(1, "a", seg="v1"), bad(1, "b", seg="v1"), bad(1, "a", msg="", seg="v2"))
    p = {x.alert_message for x in alerts.problems(r).collect()}
    assert p == {"k:f (v1): x", "k:f returned fail"}
    assert alerts.latest(r).where("alert_id = 'p:f:v1'").count() == 1 and alerts.episodes(r).count() == 3


def test_guard_modes(spark):
    r = results(spark, bad(1, "a"), bad(1, "b"), good(2, "a"), bad(2, "b", status="warn"))
    assert guard.guard(r, "off", ["batch_no"]) is None
    assert guard.guard(r, "observe", ["batch_no"]).count() == 4
    kept = guard.guard(r, "enforce", ["batch_no"])
    assert kept.count() == 3 and kept.where("batch_no = 1 and checkpoint = 'b'").count() == 0
    assert guard.guard(r, "enforce", ["batch_no"], blocking=("error",)).count() == 4
    assert guard.guard(r, None, ["batch_no"]).count() == 3
    spark.conf.set(guard.MODE_SETTING, "observe")
    try:
        assert guard.guard(r, None, ["batch_no"]).count() == 4
    finally:
        spark.conf.unset(guard.MODE_SETTING)
    stops = guard.blocked_at(r, ["batch_no"])
    data = spark.createDataFrame([(1, "x"), (2, "y")], "batch_no int, v string")
    assert [x.v for x in guard.passed_data(data, stops, ["batch_no"], 1).collect()] == ["y"]
    assert [x.v for x in guard.quarantined_data(data, stops, ["batch_no"], 1).collect()] == ["x"]
    with pytest.raises(ValueError):
        guard.guard(r, "maybe", ["batch_no"])
    s = guard.batch_summary(r, ["batch_no"]).orderBy("batch_no").collect()
    assert [(x.failed, x.warned, x.blocked, x.failing_checks) for x in s] == [(2, 0, True, "k:f"), (0, 1, False, "")]


def test_crash_counts_only_if_not_blocked_before(spark):
    r = results(spark, bad(1, "a"), good(2, "a"))
    crashed = spark.createDataFrame([(1, 1), (2, 1)], "batch_no int, crash_order int")
    out = {x.batch_no: x for x in guard.batch_outcome(r, ["batch_no"], crashed, "clean").collect()}
    assert out[1].blocked_at == "a" and out[1].crashed_at is None and out[2].crashed_at == "clean"


def test_scoring_rule(spark):
    truth = spark.createDataFrame([("s", "i", "unit_change", "f", "v1", 4), ("clean", "clean", "clean", None, None, 11)],
                                  "scenario string, injection_id string, fault_type string, field string, segment string, onset_batch int")
    cases = [("a", "v1", 5), ("b", "v1", 12), ("c", "v1", 2), ("d", "v2", 5), ("e", None, 7), ("g", "v1", 8)]
    al = spark.createDataFrame([("s", *x) for x in cases] + [("clean", "z", None, 5)],
                               "scenario string, alert_id string, segment string, first_batch int")
    m = scoring.match(al, truth, ["scenario"])
    assert {x.alert_id: x.is_match for x in m.collect()} == dict(a=True, b=False, c=False, d=False, e=True, g=True, z=False)
    s = {x.scenario: x for x in scoring.scenarios(m, truth, None, ["scenario"]).collect()}
    assert (s["s"].lag_batches, s["s"].matched_alert_id, s["s"].true_positives, s["s"].false_positives) == (1, "a", 3, 3)
    assert not s["clean"].detected and s["clean"].false_positives == 1
    q = scoring.system_scores(scoring.scenarios(m, truth, None, ["scenario"]).withColumn("system", F.lit("x")), ["system"]).collect()[0]
    assert (q.precision, q.recall, q.mean_lag_batches) == (pytest.approx(3 / 7), 1.0, 1.0)
    g = {x.metric: x.passed for x in scoring.gate(scoring.system_scores(
        scoring.scenarios(m, truth, None, ["scenario"]).withColumn("system", F.lit("x")), ["system"])).collect()}
    assert g == {"precision": False, "recall": True, "mean_lag_batches": True}


def test_no_alerts_score(spark):
    rows = spark.createDataFrame([("a", "clean", False, None, 0, 0)], "system string, fault_type string, detected boolean, lag_batches int, true_positives long, false_positives long")
    q = scoring.system_scores(rows, ["system"]).collect()[0]
    assert (q.precision, q.recall, q.mean_lag_batches) == (1.0, 0.0, None)


def raw(spark):
    rows = [(b, i, f"e{b}-{i}", ("5.2.0", "6.1.0", None)[i % 3], 1000.0, "number", "u") for b in range(1, 7) for i in range(90)]
    return spark.createDataFrame(rows, "batch_no int, line_no int, event_id string, client_version string, duration_ms double, duration_ms_kind string, user_id string")


def test_faults_touch_only_their_segment_after_onset(spark):
    df = raw(spark)
    cat = [f for f in faults.catalog("web_analytics") if f.scenario in ("unit_change_android", "feed_stops_ios", "clean", "volume_drop_android")]
    out = faults.apply_scenarios(df, cat, "event_id").cache()
    n = {(r.scenario, r.client_version): r.n for r in out.groupBy("scenario", "client_version").agg(F.count("*").alias("n")).collect()}
    assert n["feed_stops_ios", "6.1.0"] == 90 and n["feed_stops_ios", None] == 180 and n["clean", "6.1.0"] == 180
    assert 90 < n["volume_drop_android", "5.2.0"] < 150
    changed = out.where("scenario = 'unit_change_android' and duration_ms <> 1000").select("client_version", "batch_no", "duration_ms").distinct().collect()
    assert {(r.client_version, r.duration_ms) for r in changed} == {("5.2.0", 1.0)} and {r.batch_no for r in changed} == {4, 5, 6}
    assert out.where("scenario = 'clean'").drop("scenario").exceptAll(df).count() == 0


def test_random_faults_repeat_exactly(spark):
    one = [f for f in faults.catalog("web_analytics") if f.scenario == "volume_drop_android"]
    a = faults.apply_scenarios(raw(spark), one, "event_id")
    b = faults.apply_scenarios(raw(spark).repartition(7), one, "event_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ground_truth_ids():
    ids = {f.scenario: f.injection_id for f in faults.catalog("payment_processing")}
    assert ids["invalid_status_ach"] == "invalid_enum:status:ach:4" and ids["clean"] == "clean"
    assert [len(faults.catalog(p)) for p in ("web_analytics", "user_behavior", "payment_processing")] == [8, 6, 7]


def test_streamed_transitions_equal_a_walk_over_the_batches(spark):
    """Two arrivals on top of each other give what a plain walk gives: opened, changed (worse or another message), closed."""
    from tidegauge.streaming.alerts import transitions
    steps = [(1, "a", "f", "v1", "warn", "m1"), (1, "a", "g", None, "pass", ""), (2, "a", "f", "v1", "fail", "m1"), (3, "a", "f", "v1", "warn", "m2"),
             (3, "b", "f", "v1", "error", "x"), (4, "a", "g", None, "fail", "gone"), (5, "a", "g", None, "fail", "gone"), (5, "b", "f", "v1", "pass", ""),
             (6, "a", "f", "v1", "fail", "m1"), (6, "a", "g", None, "pass", "")]
    rows = spark.createDataFrame([("p", cp, 1, k, b, f"c:{f}", f, s, st, m) for k, (b, cp, f, s, st, m) in enumerate(steps)],
                                 "pipeline string, checkpoint string, cp_order int, check_seq int, batch_no int, check string, field string, segment string, status string, message string")
    rank = {"warn": 2, "fail": 3, "error": 3}
    want, state = [], {}
    for b in sorted({s[0] for s in steps}):
        for cp in sorted({s[1] for s in steps if s[0] == b}):
            bad = [s for s in steps if s[0] == b and s[1] == cp and s[4] in rank]
            for _, _, f, seg, st, m in bad:
                worst, said, first = state.get((cp, f, seg), (0, None, b))
                if not worst or rank[st] > worst or m != said:
                    want.append((cp, f, b, first, "changed" if worst else "opened"))
                state[cp, f, seg] = (max(worst, rank[st]), m, first)
            for key in [k for k in state if k[0] == cp and k[1:] not in {(s[2], s[3]) for s in bad}]:
                want.append((cp, key[1], b, state.pop(key)[2], "closed"))
    got, still = [], None
    for part in (rows.where("batch_no <= 3"), rows.where("batch_no > 3")):
        events, still = transitions(part, still)
        got += [(e.checkpoint, e.alert_id.split(":")[1], e.batch_no, e.first_batch, e.event) for e in events.collect()]
    assert sorted(got) == sorted(want)
    assert {(r.checkpoint, r.field) for r in still.collect()} == {(k[0], k[1]) for k in state}


def test_false_alarms_count_runs_and_the_report_repeats_the_scores(spark):
    rows = spark.createDataFrame([("x", "clean", "clean", False, None, 0, 2), ("x", "a", "null", True, 1, 3, 0), ("x", "b", "cut", False, None, 0, 1),
                                  ("y", "clean", "clean", False, None, 0, 0)],
                                 "system string, scenario string, fault_type string, detected boolean, lag_batches int, "
                                 "true_positives long, false_positives long")
    rates = {r.system: r.false_positive_rate for r in scoring.false_alarms(rows, ["system"]).collect()}
    assert rates == {"x": pytest.approx(2 / 3), "y": 0.0}
    told = {(r.system, r.scenario): (r.precision, r.recall, r.mean_lag_batches) for r in scoring.report(rows).collect()}
    assert told[("x", "b")] == told[("x", "a")] == (0.5, 0.5, 1.0) and told[("y", "clean")] == (1.0, 0.0, None)
