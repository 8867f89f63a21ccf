"""Pipelines on small cases, JSON-lines sources, lineage, reports, sinks."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidegauge.operators import lineage, reports
from tidegauge.plans import behavior, payments, web
from tidegauge.session import scratch_path
from tidegauge.sources import jsonl, sinks

EVENT = dict(event_id="b0001-e00000", timestamp=1_790_000_000_000, user_id="u1", session_id="session_001", platform="web",
             client_version="1.4.0", payload=dict(page="home", action="page_view", duration_ms=1483, error_message=None))


def write(tmp_path, *batches):
    for i, lines in enumerate(batches, 1):
        (tmp_path / f"batch_{i:04d}.jsonl").write_text("\n".join(json.dumps(e) for e in lines) + "\n\n")
    return str(tmp_path)


def event(**kw):
    e = json.loads(json.dumps(EVENT))
    e["payload"].update({k: kw.pop(k) for k in list(kw) if k in e["payload"]})
    return {**e, **kw}


def test_single_event(spark, tmp_path):
    rows = web.run(jsonl.web_events(spark, write(tmp_path, [EVENT]))).collect()
    r = rows[0]
    assert len(rows) == 1 and r.date == dt.date(2026, 9, 21) and (r.platform, r.country, r.events) == ("web", "US", 1)
    assert (r.avg_duration_s, r.p95_duration_s, r.error_rate) == (1.483, 1.483, 0.0)


def test_all_users_null_and_empty_file(spark, tmp_path):
    raw = jsonl.web_events(spark, write(tmp_path, [event(user_id=None)], []))
    assert raw.count() == 1 and web.run(raw).count() == 0
    assert web.run(raw.where("false")).count() == 0


def test_duplicates_slow_loads_and_null_platform(spark, tmp_path):
    raw = jsonl.web_events(spark, write(tmp_path, [EVENT, event(event_id="x", duration_ms=300_000), event(event_id="y", platform=None)], [EVENT]))
    assert web.run(raw).select("events").collect()[0].events == 1 and web.clean(raw).count() == 2


def test_wire_types_survive(spark, tmp_path):
    vals = [1483, 1.5, "1483", "1483ms", None]
    raw = jsonl.web_events(spark, write(tmp_path, [event(event_id=str(i), duration_ms=v) for i, v in enumerate(vals)]))
    got = [(r.duration_ms, r.duration_ms_kind) for r in raw.orderBy("event_id").collect()]
    assert got == [(1483.0, "number"), (1.5, "number"), (None, "text"), (None, "text"), (None, None)]


def test_behavior_rollup(spark, tmp_path):
    raw = jsonl.behavior_sessions(spark, write(tmp_path, [EVENT, event(event_id="2", session_id="s2", platform="ios"), event(event_id="3", action="click")]))
    r = behavior.run(raw).collect()[0]
    assert (r.session_count, r.platforms_used, r.events, r.engagement_score) == (2, 2, 2, 4)


def test_payment_dates_and_regions(spark, tmp_path):
    base = dict(transaction_id="t1", event_ts=1_790_000_000_000, merchant_id="MER_EU_01", user_id="u", amount_cents=1250, currency="USD",
                payment_method="card", status="declined", error_message="insufficient funds ERROR")
    folder = write(tmp_path, [base, {**base, "transaction_id": "t2", "status": "chargeback"}, {**base, "transaction_id": "t3", "amount_cents": 0}])
    raw = jsonl.payments(spark, folder)
    r = payments.run(raw).collect()[0]
    assert (str(r.transaction_date), r.merchant_region, r.transaction_count, r.total_volume_usd, r.error_rate, r.decline_rate) == (
        "1970-01-01", "Europe", 1, 12.5, 1.0, 1.0)
    assert str(payments.run(raw, "ms").collect()[0].transaction_date) == "2026-09-21"


def graph(spark, edges):
    e = [("p", s, t, k, "f", 1) for s, t, k in edges]
    ids = sorted({x for s, t, _ in edges for x in (s, t)})
    n = [("p", i, "output" if i.startswith("o") else "field", i) for i in ids]
    return (spark.createDataFrame(n, "pipeline string, id string, type string, label string"),
            spark.createDataFrame(e, "pipeline string, source string, target string, type string, file string, line int"))


def test_lineage_walks_chains_and_cycles(spark):
    n, e = graph(spark, [("a", "b", "derives"), ("b", "c", "derives"), ("c", "a", "derives"), ("c", "o1", "produces"), ("a", "x", "reads"), ("z", "z", "derives")])
    down = {(r.start, r.node) for r in lineage.downstream(n, e).collect()}
    assert {x for s, x in down if s == "a"} == {"b", "c", "o1"} and not any(s == "z" for s, _ in down)
    assert {r.start for r in lineage.upstream(n, e, starts=spark.createDataFrame([("p", "o1")], "pipeline string, start string")).collect()} == {"o1"}
    hit = lineage.affected_outputs(n, e, spark.createDataFrame([("p", "b"), ("p", "nope")], "pipeline string, field string")).collect()
    assert [(r.field, r.output) for r in hit] == [("b", "o1")]


def test_unused_and_dedup(spark):
    n, e = graph(spark, [("fn", "a", "writes"), ("fn", "b", "writes"), ("a", "o", "produces"), ("a", "o", "produces")])
    assert [r.field for r in lineage.unused_fields(n, e).collect()] == ["b"] and lineage.dedup_edges(e).count() == 3
    twice = n.withColumn("ord", F.lit(1)).unionByName(n.withColumns({"label": F.lit("other"), "ord": F.lit(2)}))
    assert lineage.dedup_nodes(twice, ["ord"]).where("label = 'other'").count() == 0


def test_equivalence_tolerance(spark):
    g = spark.createDataFrame([("a", 1.0, 2), ("b", None, 3), ("c", 5.0, 1)], "k string, x double, n int")
    c = spark.createDataFrame([("a", 1.0 + 1e-12, 2), ("b", None, 4), ("d", 5.0, 1)], "k string, x double, n int")
    rows = {r.k: (r.verdict, r.changed_columns) for r in reports.equivalence_rows(g, c, ["k"]).collect()}
    assert rows == {"a": ("identical", ""), "b": ("changed", "n"), "c": ("missing", ""), "d": ("added", "")}
    assert reports.equivalence_score(reports.equivalence_rows(g, c, ["k"])).collect()[0].equivalence_score == 0.25
    assert reports.difference(g, g).count() == 0


def test_stems_and_decisions(spark):
    names = spark.createDataFrame([(x,) for x in ("duration_ms", "duration_s", "user_id", "x_s", "_s", "error_rate")], "f string")
    assert [r[0] for r in names.select(reports.stem(F.col("f"))).collect()] == ["duration", "duration", "user", "x_s", "_s", "error"]
    contract = spark.createDataFrame([("p", "cp", None, "volume", "volume"), ("p", "cp", "duration_s", "unit", "unit"), ("p", "cp", "duration_s", "nulls", "nulls"),
                                      ("q", "cp", "duration_s", "unit", "unit")], "pipeline string, checkpoint string, field string, check_type string, kind string")
    reviewed = spark.createDataFrame([("1", "p", "unit_conversion", "duration_ms", "confirmed"), ("2", "p", "row_filter", "a", "rejected"),
                                      ("3", "q", "unit_conversion", "duration_ms", "pending")], "finding_id string, pipeline string, kind string, field string, status string")
    kept = reports.contract_for_decisions(contract, reviewed).collect()
    assert [(r.pipeline, r.check_type) for r in kept] == [("p", "unit")]
    assert reports.contract_counts(reports.contract_for_decisions(contract, reviewed)).collect()[0].needs_baselines


def test_upserts_are_idempotent(spark):
    rows = spark.createDataFrame([("p", "a", "medium", "m1", 1), ("p", "a", "high", "m2", 3)], "pipeline string, alert_id string, severity string, message string, batch_no int")
    once = sinks.upsert_alerts(None, rows, ["batch_no"]).drop("writes")
    again = sinks.upsert_alerts(rows, rows, ["batch_no"]).drop("writes")
    assert once.collect() == again.collect()
    r = once.collect()[0]
    assert (r.severity, r.message, r.batch_no) == ("high", "m2", 1)
    v = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, ver int, x string")
    assert [x.x for x in sinks.upsert_rows(None, v, ["key"], "ver").collect()] == ["new"]


def test_profile(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    p = {(r.stage, r.column): r for r in reports.profile_stages([("in", a), ("out", a.where("i = 2").drop("s").withColumn("z", F.lit(1)))]).collect()}
    assert p["in", "s"].null_count == 1 and p["out", "s"].change == "dropped" and p["out", "z"].change == "new" and p["out", "i"].rows_in == 2
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
