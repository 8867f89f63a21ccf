"""The registered queries: every operator of the library over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import alerts, baseline, checks, drift, faults, guard, lineage, reachability, reports, scoring, stages
from tidegauge.plans import behavior, contracts, evaluation as ev, graphs, payments, registry, web
from tidegauge.plans.contracts import Checkpoint, Contract, Spec
from tidegauge.session import cut, scratch_path, spread, staged
from tidegauge.sources import jsonl, sinks, views
from tidegauge.streaming import alerts as alert_stream
from tidegauge.streaming import arrival
from tidegauge.streaming import batches as batch_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_memo: dict[tuple, Any] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _once(spark: SparkSession, folder: str, key: str, make: Callable[[], Any]) -> Any:
    """Frozen baselines, staged scenario frames and recorded runs are tables in the shared folder;
    queries over the same input reuse them."""
    full = (spark.sparkContext.applicationId, folder, key)
    if full not in _memo:
        _memo[full] = make()
    return _memo[full]


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _raw(spark, d, pipeline):
    return views.payments_raw(spark, d) if pipeline == "payment_processing" else views.web_raw(spark, d)


def _base(spark, d, pipeline="web_analytics"):
    return _once(spark, d, f"base-{pipeline}", lambda: ev.learn(_raw(spark, d, pipeline), pipeline).freeze())


def _frames(spark, d, pipeline="web_analytics"):
    return _once(spark, d, f"frames-{pipeline}", lambda: ev.scenario_frames(_raw(spark, d, pipeline), pipeline, faults.catalog(pipeline)))


def _run(spark, d, contract: Contract, *scenarios: str, pipeline="web_analytics", base=True, segmented=True) -> DataFrame:
    """Results of a (narrowed) contract over some fault scenarios of a pipeline."""
    p = ev.PIPELINES[pipeline]
    found = _frames(spark, d, pipeline)
    frames = {cp.name: found[cp.name].where(F.col("scenario").isin(*scenarios)) for cp in contract.checkpoints if cp.checks_anything}
    return checks.run_contract(frames, contract, p.orders, ev.RUN, _base(spark, d, pipeline) if base else None)


def _shape(results: DataFrame, *extra: str) -> DataFrame:
    return results.select("scenario", "batch_no", *extra, "checkpoint", F.col("check").alias("check_name"), "field", "segment",
                          "status", "message", F.round("metric", 6).alias("metric"), F.col("rows").alias("n_rows"))


def _evaluation(spark, d, pipeline="web_analytics"):
    """(results of all three systems, scenario scores)."""
    return _once(spark, d, f"eval-{pipeline}", lambda: tuple(
        cut(x) for x in ev.evaluate(spark, _raw(spark, d, pipeline), pipeline, base=_base(spark, d, pipeline))))


def _ours(spark, d, pipeline="web_analytics"):
    return _evaluation(spark, d, pipeline)[0].where(F.col("system") == "ours")


def _web_alerts(spark, d):
    """Alerts of every scenario run, each scenario registered as its own pipeline run."""
    return _once(spark, d, "alerts", lambda: cut(alerts.latest(_ours(spark, d), ["scenario"])))


# --- sources and sinks ---

@query
def src_web_jsonl(spark, d):
    folder = jsonl.write_batches(raw := views.web_raw(spark, d), jsonl.web_documents(raw), scratch_path(spark, "web-jsonl"))
    return jsonl.web_events(spark, folder).withColumn("event_ts", F.unix_millis("event_ts"))


@query
def src_behavior_jsonl(spark, d):
    folder = jsonl.write_batches(raw := views.web_raw(spark, d), jsonl.web_documents(raw), scratch_path(spark, "beh-jsonl"))
    return jsonl.behavior_sessions(spark, folder).withColumn("session_start", F.unix_millis("session_start"))


@query
def src_payments_jsonl(spark, d):
    folder = jsonl.write_batches(raw := views.payments_raw(spark, d), jsonl.payment_documents(raw), scratch_path(spark, "pay-jsonl"))
    return jsonl.payments(spark, folder)


@query
def src_sql_table(spark, d):
    views.payments_raw(spark, d).createOrReplaceTempView("raw_transactions")
    return spark.sql("""
        SELECT transaction_id, user_id, amount_cents, amount_cents / CAST(100 AS DOUBLE) AS amount_usd, status
        FROM raw_transactions WHERE user_id IS NOT NULL AND amount_cents > 0 AND amount_cents < 99999999""")


@query
def src_batch_stream(spark, d):
    """Per arriving file additive counts, summed per batch and segment: a batch spread over several
    files gives the same totals."""
    folder = jsonl.write_batches(raw := views.web_raw(spark, d), jsonl.web_documents(raw), scratch_path(spark, "stream-in"))
    out = scratch_path(spark, "stream-out")

    def counts(lines: DataFrame) -> DataFrame:
        return jsonl.flatten_web(lines).groupBy("batch_no", "client_version").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("user_id").isNull()).alias("null_users"),
            F.count_if(F.col("duration_ms_kind") == "number").alias("numbers"))

    batch_stream.check_on_arrival(batch_stream.stream_lines(spark, folder), counts, out, scratch_path(spark, "stream-cp"))
    return spark.read.parquet(out).groupBy("batch_no", "client_version").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("null_users").alias("null_users"), F.sum("numbers").alias("numbers"))


@query
def src_batch_contract(spark, d):
    """Arriving batches meet the contract of the first checkpoint; the results are read back from the results table."""
    folder = jsonl.write_batches(raw := views.web_raw(spark, d), jsonl.web_documents(raw), scratch_path(spark, "contract-in"))
    out, cp = scratch_path(spark, "contract-out"), contracts.WEB.only("schema", "nulls", "range", volume=True).at("after_ingest")

    def judged(lines: DataFrame) -> DataFrame:
        rows = jsonl.flatten_web(lines).withColumn("scenario", F.lit("clean"))
        return checks.run_checkpoint(rows, "web_analytics", cp, 1, ev.RUN)

    # whole batches only: all that has arrived is one micro-batch
    batch_stream.check_on_arrival(batch_stream.stream_lines(spark, folder, files_per_trigger=1 << 30), judged, out, scratch_path(spark, "contract-cp"))
    return _shape(spark.read.parquet(out).drop("epoch"))


@query
def src_batch_chain(spark, d):
    """Files arrive a few at a time, batches in pieces: each is judged once when it is whole, by contract, guard and alerts. What is
    returned are the recorded results, as of one run over all batches."""
    return _shape(_chain(spark, d)[0].withColumn("scenario", F.lit("feed_stops_ios")))


@query
def src_batch_chain_alerts(spark, d):
    return _chain(spark, d)[1].select("checkpoint", "alert_id", "batch_no", "first_batch", "severity", "message", "event")


def _chain(spark, d):
    def make():
        p, base = ev.PIPELINES["web_analytics"], _base(spark, d)
        raw = faults.apply_scenarios(views.web_raw(spark, d), _fault("feed_stops_ios"), p.row_id).drop("scenario")
        folder, out, cp = (scratch_path(spark, f"chain-{x}") for x in ("in", "out", "cp"))
        pieces = raw.repartition(2)  # two files a batch
        jsonl.write_batches(pieces, jsonl.web_documents(pieces), folder)
        files = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("_path"))
        manifest = staged(arrival.manifest_of(files.distinct()), "manifest")
        few = max(1, manifest.agg(F.sum("files")).first()[0] // 2 + 1)  # two arrivals, and batches in pieces

        def judge(lines, expected):
            rows, keys = staged(jsonl.flatten_web(lines), "arrived"), ["batch_no"]
            results = checks.run_contract(p.frames(rows, tuple(keys)), contracts.WEB, p.orders, keys, base, expected)
            return results, rows

        chain = arrival.Chain(judge, manifest, out, cp)
        chain.follow(batch_stream.stream_text(spark, folder, few))
        chain.follow(batch_stream.stream_text(spark, folder, few))  # a restart finds nothing new
        return chain.table(spark, "results"), chain.table(spark, "events")
    return _once(spark, d, "chain", make)


@query
def sink_batch_jsonl(spark, d):
    """Lines and distinct keys per written batch file."""
    folder = jsonl.write_batches(raw := views.web_raw(spark, d), jsonl.web_documents(raw), scratch_path(spark, "sink-jsonl"))
    return jsonl.read_lines(spark, folder).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(jsonl.text("$.event_id")).alias("events"))


@query
def sink_results_append(spark, d):
    path = scratch_path(spark, "results")
    results = _ours(spark, d)
    sinks.append_results(results.where(F.col("cp_order") == 1), path)
    sinks.append_results(results.where(F.col("cp_order") > 1), path)
    return sinks.read_results(spark, path).groupBy("scenario", "checkpoint", F.col("check").alias("check_name"), "status").agg(
        F.count(F.lit(1)).alias("n"))


@query
def sink_drift_rows(spark, d):
    return _r(sinks.drift_rows(_ours(spark, d)), "baseline_value", "current_value")


@query
def sink_alerts_upsert(spark, d):
    """Alert changes applied batch by batch, the last half twice: re-applying changes nothing."""
    ch = alerts.changes(_ours(spark, d), ["scenario"]).select(
        F.col("scenario").alias("pipeline"), "alert_id", "severity", "message", "root_field", "segment",
        F.col("batch_no"), "cp_order", "check_seq")
    at = ["batch_no", "cp_order", "check_seq"]
    path = scratch_path(spark, "alert-table")
    for epoch, part in ((0, ch), (1, ch.where(F.col("batch_no") > 5)), (1, ch.where(F.col("batch_no") > 5))):
        sinks.write_alerts(part, path, epoch, at)
    return sinks.read_table(spark, path, 1).select(
        "pipeline", "alert_id", "severity", "message", "root_field", "segment", F.col("batch_no").alias("first_batch"))


@query
def sink_baseline_profiles(spark, d):
    """Profiles written as a table, replaced by a second version that arrives twice, and read back."""
    path, rows = scratch_path(spark, "profile-table"), baseline.profiles(_base(spark, d))
    for epoch, version in ((0, 1), (1, 2), (1, 2)):
        sinks.write_rows(rows.withColumn("version", F.lit(version)), path, epoch, baseline.KEY, "version")
    out = sinks.read_table(spark, path, 1).drop("version", "top_values")
    return _r(out, "p0", "p25", "p50", "p75", "p95", "p100", "mean", "stddev")


@query
def baseline_top_templates(spark, d):
    """The most frequent templates of the exported profiles, one row per template."""
    top = baseline.profiles(_base(spark, d)).where(F.col("top_values").isNotNull())
    return top.select("segment", F.explode(F.from_json("top_values", "map<string,bigint>")).alias("template", "n"))


@query
def baseline_save_load(spark, d):
    path = scratch_path(spark, "baselines")
    _base(spark, d).save(path)
    b = baseline.Baselines.load(spark, path)
    return _r(b.numeric.join(b.volume.select("segment", F.col("median").alias("volume_median")), "segment", "left")
              .select("segment", "sample_count", "mean", "median", "std", "volume_median"), "mean", "median", "std")


@query
def sink_eval_report(spark, d):
    scored = _evaluation(spark, d)[1]
    return _r(scoring.report(scored), "precision", "recall", "mean_lag_batches").select(
        "system", "scenario", "fault_type", "detected", "lag_batches", "true_positives", "false_positives", "precision", "recall", "mean_lag_batches")


# --- pipeline operators ---

@query
def dedup_keep_first(spark, d):
    out = stages.dedup_keep_first(views.web_raw(spark, d), ["event_id"], ["batch_no", "line_no"])
    return out.select("event_id", "line_no", "duration_ms")


@query
def dedup_keep_earliest(spark, d):
    out = stages.dedup_keep_earliest(views.payments_raw(spark, d), ["transaction_id"], "event_ts", ["batch_no", "line_no"])
    return out.select("transaction_id", "event_ts", "amount_cents")


@query
def filter_required(spark, d):
    return stages.filter_required(views.web_raw(spark, d), "user_id").groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query
def filter_range(spark, d):
    raw = views.payments_raw(spark, d)
    return stages.filter_range(raw, "amount_cents", 0.0, 99_999_999.0).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("n"), F.max("amount_cents").alias("max_cents"))


@query
def filter_allowed(spark, d):
    return stages.filter_allowed(views.payments_raw(spark, d), "status", payments.ALLOWED_STATUS).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


@query
def filter_action(spark, d):
    return stages.filter_equal(views.web_raw(spark, d), "action", "page_view").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query
def unit_convert(spark, d):
    return views.web_raw(spark, d).select("event_id", "line_no", S.scaled_down("duration_ms", 1000.0).alias("duration_s"))


@query
def flag_error(spark, d):
    return views.payments_raw(spark, d).select(
        "line_no", F.col("error_message").isNotNull().alias("has_message"), S.contains_ci("error_message", "error").alias("is_error"))


@query
def flag_keyword(spark, d):
    return views.web_raw(spark, d).select("line_no", S.contains_ci("error_message", "timeout").alias("is_timeout"))


@query
def split_version(spark, d):
    return views.payments_raw(spark, d).select(
        "line_no", S.major_version("client_version").alias("major_version"),
        S.major_version_before_dot("client_version").alias("major_before_dot"))


@query
def map_lookup_default(spark, d):
    return views.web_raw(spark, d).groupBy("session_id", S.country_of("session_id").alias("country")).agg(F.count(F.lit(1)).alias("n"))


@query
def prefix_case(spark, d):
    return views.payments_raw(spark, d).groupBy("merchant_id", S.merchant_region("merchant_id").alias("merchant_region")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def date_extract(spark, d):
    return views.payments_raw(spark, d).groupBy(
        S.epoch_date("event_ts", "ns").alias("date_ns"), S.epoch_date("event_ts", "ms").alias("date_ms")).agg(F.count(F.lit(1)).alias("n"))


@query
def web_daily_metrics(spark, d):
    return _r(_r(web.run(views.web_raw(spark, d)), "error_rate", "timeout_rate", "p95_duration_s"), "avg_duration_s", digits=9)


@query
def behavior_user_rollup(spark, d):
    return _r(behavior.run(views.web_raw(spark, d)), "avg_session_duration_s", digits=9)


_PAY_MONEY = ("avg_transaction_usd", "error_rate", "decline_rate")


@query
def payments_reconcile(spark, d):
    return _r(_r(payments.run(views.payments_raw(spark, d)), *_PAY_MONEY), "total_volume_usd", digits=2)


@query
def payments_reconcile_true_dates(spark, d):
    return _r(_r(payments.run(views.payments_raw(spark, d), "ms"), *_PAY_MONEY), "total_volume_usd", digits=2)


@query
def payments_sql_feed(spark, d):
    return _r(_r(payments.run_sql_feed(views.payments_raw(spark, d)), *_PAY_MONEY), "total_volume_usd", digits=2)


# --- checks ---

@query
def segment_split(spark, d):
    """Rows per batch and segment, a missing segment kept as its own group."""
    return views.web_raw(spark, d).groupBy("batch_no", S.segment_of("user_id").alias("segment")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def chk_schema(spark, d):
    c = Contract("web_analytics", (Checkpoint("after_ingest", "client_version", fields=(
        ("event_id", (Spec("schema", dtype="object"),)), ("duration_ms", (Spec("schema", dtype="numeric"),)),
        ("trace_id", (Spec("schema", dtype="object"), Spec("nulls", max_null_rate=0.1))))),))
    return _shape(_run(spark, d, c, "clean", "type_change_android", "unit_change_android", base=False))


@query
def chk_null_rate(spark, d):
    return _shape(_run(spark, d, contracts.WEB.only("nulls"), "clean", "new_nullable_web", base=False))


@query
def chk_range(spark, d):
    c = Contract("web_analytics", (Checkpoint("after_ingest", "client_version", fields=(
        ("duration_ms", (Spec("range", min=0.0, max=200_000.0),)),)),))
    return _shape(_run(spark, d, c, "clean", "type_change_android", "gradual_drift_ios", base=False))


@query
def chk_volume(spark, d):
    c = Contract("payment_processing", (Checkpoint("after_ingest", "payment_method", min_rows=1300, max_rows=1_000_000_000),))
    return _shape(_run(spark, d, c, "clean", "feed_stops_wallet", pipeline="payment_processing", base=False))


@query
def chk_key_set(spark, d):
    c = Contract("payment_processing", (Checkpoint("after_ingest", "payment_method", fields=(
        ("status", (Spec("schema", allowed=payments.ALLOWED_STATUS),)),)),))
    return _shape(_run(spark, d, c, "clean", "invalid_status_ach", pipeline="payment_processing", base=False))


@query
def chk_key_set_values(spark, d):
    """The whole set of unexpected values, which the check's message only begins to show."""
    frame = _frames(spark, d, "payment_processing")["after_ingest"].where(F.col("scenario").isin("clean", "invalid_status_ach"))
    return checks.unexpected_values(frame, ev.RUN, "status", payments.ALLOWED_STATUS)


@query
def chk_range_text(spark, d):
    """A range check on a text column costs one `error` row a batch; the other checks still report."""
    cp = Checkpoint("after_ingest", "client_version", fields=(
        ("error_message", (Spec("range", min=0.0, max=1.0),)), ("user_id", (Spec("nulls", max_null_rate=0.1),))))
    out = checks.run_checkpoint(views.web_raw(spark, d), "web_analytics", cp, 1, ["batch_no"])
    return out.groupBy("batch_no", F.col("check").alias("check_name"), F.when(F.col("status") == "error", F.col("message")).alias("error")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def chk_cardinality(spark, d):
    c = Contract("web_analytics", (Checkpoint("after_ingest", "client_version", fields=(
        ("client_version", (Spec("schema", max_distinct=5),)), ("platform", (Spec("schema", max_distinct=3),)))),))
    return _shape(_run(spark, d, c, "clean", "feed_stops_ios", base=False))


@query
def chk_unit(spark, d):
    return _shape(_run(spark, d, contracts.WEB.only("unit"), "clean", "unit_change_android"))


@query
def chk_segment_volume(spark, d):
    return _shape(_run(spark, d, contracts.WEB.only(segment_volume=True), "clean", "feed_stops_ios", "volume_drop_android"))


@query
def drift_psi(spark, d):
    out = _run(spark, d, contracts.WEB.only("numeric_drift"), "clean", "gradual_drift_ios", "unit_change_android")
    return _shape(out.where(F.col("check").startswith("psi:")))


@query
def drift_ks(spark, d):
    out = _run(spark, d, contracts.WEB.only("numeric_drift"), "clean", "gradual_drift_ios", "unit_change_android")
    return _shape(out.where(F.col("check").startswith("ks:")))


@query
def drift_numeric_run(spark, d):
    """PSI and KS with their no-baseline and small-sample cases on payments."""
    return _shape(_run(spark, d, contracts.PAYMENTS.only("numeric_drift"), "clean", "unit_change_card", "feed_stops_wallet",
                       pipeline="payment_processing"))


@query
def drift_oov(spark, d):
    out = _run(spark, d, contracts.WEB.only("text_drift"), "clean", "text_change_web")
    return _shape(out.where(F.col("check").startswith("oov_rate:")))


@query
def drift_template(spark, d):
    out = _run(spark, d, contracts.WEB.only("text_drift"), "clean", "text_change_web")
    return _shape(out.where(F.col("check").startswith("template_drift:")))


MESSAGES = Checkpoint("after_ingest", "lang", fields=(("text", (Spec("text_drift"),)),))


def _messages(spark, d):
    """Whole documents as log messages; the first three feeds are the baseline."""
    msgs = spread(views.messages(spark, d)).withColumn("scenario", F.lit("documents"))
    learned = msgs.where(F.col("batch_no").isin(*ev.BASELINE_BATCHES))
    base = _once(spark, d, "base-messages", lambda: baseline.build(
        {"after_ingest": learned}, Contract("documents", (MESSAGES,)), learned.select("batch_no")).freeze())
    return msgs, base


@query
def drift_text_documents(spark, d):
    msgs, base = _messages(spark, d)
    return _shape(checks.run_checkpoint(msgs, "documents", MESSAGES, 1, ev.RUN, base)).drop("message")


@query
def chk_contract(spark, d):
    return _shape(_run(spark, d, contracts.WEB, "clean", "gradual_drift_ios", "type_change_android"), "cp_order", "check_seq", "check_type")


@query
def chk_contract_payments(spark, d):
    return _shape(_run(spark, d, contracts.PAYMENTS, "clean", "invalid_status_ach", "unit_change_card", pipeline="payment_processing"),
                  "cp_order", "check_seq", "check_type")


@query
def chk_contract_behavior(spark, d):
    return _shape(_run(spark, d, contracts.BEHAVIOR, "clean", "action_flood_ios", pipeline="user_behavior"),
                  "cp_order", "check_seq", "check_type")


@query
def chk_contract_naive(spark, d):
    return _shape(_run(spark, d, contracts.NAIVE, "clean", "type_change_android", base=False))


@query
def contract_for_decisions(spark, d):
    reviewed = reports.review(registry.findings(spark, d), registry.decisions(spark, d))
    return reports.contract_for_decisions(registry.contract_catalog(spark, reviewed), reviewed)


@query
def contract_counts(spark, d):
    return reports.contract_counts(contract_for_decisions(spark, d))


def _unguarded(spark, d):
    return _once(spark, d, "unguarded", lambda: tuple(cut(x) for x in ev.scenario_results(
        views.web_raw(spark, d), "web_analytics", faults.catalog("web_analytics"), _base(spark, d))))


def _status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario", "batch_no", "checkpoint", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def guard_observe(spark, d):
    results, crashed = _unguarded(spark, d)
    return _status_counts(guard.guard(results, "observe", ev.RUN, crashed))


@query
def guard_enforce(spark, d):
    results, crashed = _unguarded(spark, d)
    return _status_counts(guard.guard(results, "enforce", ev.RUN, crashed))


@query
def guard_off(spark, d):
    """No checks run; the data passes unchanged."""
    assert guard.guard(None, "off", ev.RUN) is None
    return _frames(spark, d)["after_clean"].groupBy("scenario", "batch_no").agg(F.count(F.lit(1)).alias("n_rows"))


def _stops(spark, d):
    results, crashed = _unguarded(spark, d)
    return guard.blocked_at(results, ev.RUN, crashed)


@query
def guard_passed(spark, d):
    out = guard.passed_data(_frames(spark, d)["after_clean"], _stops(spark, d), ev.RUN, 2)
    return out.groupBy("scenario", "batch_no").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def guard_quarantine(spark, d):
    out = guard.quarantined_data(_frames(spark, d)["after_clean"], _stops(spark, d), ev.RUN, 2)
    return out.groupBy("scenario", "batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("duration_s"), 6).alias("seconds"))


@query
def batch_outcome(spark, d):
    results, crashed = _unguarded(spark, d)
    return guard.batch_outcome(results, ev.RUN, crashed, "clean")


@query
def batch_summary(spark, d):
    return guard.batch_summary(_ours(spark, d), ev.RUN)


# --- baselines ---

@query
def bl_numeric(spark, d):
    return _r(_base(spark, d).numeric.select("checkpoint", "field", "segment", "sample_count", "mean", "median", "std"),
              "mean", "median", "std")


@query
def bl_sample(spark, d):
    """Which values the bounded sample keeps, at a bound that bites."""
    clean = web.clean(views.web_raw(spark, d), ("batch_no",))
    return baseline.numeric_sample(clean, "after_clean", "duration_s", "client_version", "event_id", 500).select("segment", "x")


@query
def bl_bins(spark, d):
    n = _base(spark, d).numeric
    edges = n.select("segment", F.posexplode("edges").alias("pos", "edge"), "bin_counts")
    return edges.select("segment", F.col("pos").cast("bigint").alias("pos"), "edge", F.get("bin_counts", "pos").alias("bin_count"))


@query
def bl_vocab(spark, d):
    return _messages(spark, d)[1].vocab.select("segment", "token")


@query
def bl_templates(spark, d):
    return _base(spark, d).templates.select("segment", "template", "n")


@query
def bl_segment_volume(spark, d):
    return _base(spark, d).volume.select("checkpoint", "segment", F.array_join(F.col("batch_counts").cast("array<string>"), ",")
                                         .alias("batch_counts"), "median")


@query
def bl_build_plan(spark, d):
    """Baseline keys of all three pipelines."""
    out = []
    for name in ev.PIPELINES:
        b = _base(spark, d, name)
        out.append(b.numeric.select(F.lit(name).alias("pipeline"), F.lit("numeric").alias("kind"), "checkpoint", "field", "segment", "sample_count"))
        if b.text is not None:
            out.append(b.text.select(F.lit(name).alias("pipeline"), F.lit("text").alias("kind"), "checkpoint", "field", "segment", "sample_count"))
    import functools
    return functools.reduce(DataFrame.unionByName, out)


@query
def bl_merge(spark, d):
    """The baseline of the first two batches, frozen, takes the third without reading the others again."""
    raw = _raw(spark, d, "web_analytics")
    *before, last = ev.BASELINE_BATCHES
    b = ev.learn(raw, "web_analytics", before).freeze().merge(ev.learn(raw, "web_analytics", [last]).freeze())
    usual = b.volume.select("segment", F.array_join(F.col("batch_counts").cast("array<string>"), ",").alias("batch_counts"), F.col("median").alias("usual"))
    words = b.vocab.groupBy("segment").agg(F.count(F.lit(1)).alias("words"))
    shapes = b.templates.groupBy("segment").agg(F.count(F.lit(1)).alias("templates"), F.sum("n").alias("records"))
    out = b.numeric.select("segment", "sample_count", "mean", "median", "std", F.array_join(F.transform(
        "bin_counts", lambda n: n.cast("string")), ",").alias("bin_counts"))
    return _r(out.join(usual, "segment", "left").join(words, "segment", "left").join(shapes, "segment", "left"), "mean", "median", "std")


@query
def bl_lookup(spark, d):
    """Exact-key baseline lookup: platforms are no known segments, so nothing is found for them."""
    cp = lambda seg: Checkpoint("after_clean", seg, fields=(("duration_s", (Spec("unit"),)),))
    frame = _frames(spark, d)["after_clean"].where(F.col("scenario") == "clean")
    base = _base(spark, d)
    return _shape(checks.run_checkpoint(frame, "w", cp("platform"), 1, ev.RUN, base).unionByName(
        checks.run_checkpoint(frame, "w", cp("client_version"), 1, ev.RUN, base)))


# --- alerts ---

@query
def alert_severity(spark, d):
    return alerts.with_severity(_unguarded(spark, d)[0]).groupBy("scenario", "status", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def alert_problem_key(spark, d):
    return alerts.problems(_unguarded(spark, d)[0]).groupBy("scenario", "alert_id", "root").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("checkpoint").alias("checkpoints"))


@query
def alert_message(spark, d):
    return alerts.problems(_unguarded(spark, d)[0]).select("scenario", "batch_no", "checkpoint", "check_seq", "segment", "alert_message")


@query
def alert_episodes(spark, d):
    return alerts.episodes(_unguarded(spark, d)[0], ["scenario"]).select(
        "scenario", "checkpoint", "alert_id", "segment", "first_batch", "last_batch", "batches", "closed_batch")


@query
def alert_changes(spark, d):
    return alerts.changes(_unguarded(spark, d)[0], ["scenario"]).select(
        "scenario", "alert_id", "checkpoint", "batch_no", "check_seq", "first_batch", "severity", "message")


@query
def alert_latest(spark, d):
    return _web_alerts(spark, d).select("scenario", "alert_id", "severity", "message", "root_field", "segment", "first_batch")


@query
def alert_open(spark, d):
    return alerts.open_alerts(_unguarded(spark, d)[0], ["scenario"]).select("scenario", "checkpoint", "alert_id", "first_batch", "last_batch")


def _alerts_as_pipelines(spark, d):
    return _web_alerts(spark, d).withColumn("pipeline", F.col("scenario"))


def _graph(spark):
    return graphs.web_graph(spark, [f.scenario for f in faults.catalog("web_analytics")])


@query
def alert_lineage(spark, d):
    nodes, edges = _graph(spark)
    out = lineage.alerts_with_outputs(_alerts_as_pipelines(spark, d), nodes, edges)
    steps = F.transform("lineage", lambda s: F.concat(s["node_type"], F.lit(" "), s["label"]))
    return out.select("pipeline", "alert_id", "root_field", "affected_outputs", F.array_join(steps, " < ").alias("lineage"))


@query
def alert_lineage_2hop(spark, d):
    return lineage.alerts_two_hops(_alerts_as_pipelines(spark, d), _graph(spark)[1]).select(
        "pipeline", "alert_id", "root_field", "affected_outputs")


@query
def alert_stream_events(spark, d):
    """The streamed lifecycle over every batch there is, in several arrivals and out of order: what is open after one goes on in the next."""
    folder, out, cp = (scratch_path(spark, f"alerts-{x}") for x in ("in", "out", "cp"))
    rows = _unguarded(spark, d)[0].withColumn("pipeline", F.col("scenario"))
    # every third batch comes up to two numbers late; four batches arrive at a time, and some of them again with the next
    arrival = F.expr("(batch_no + if(batch_no % 3 = 0, 2, 0)) div 4")
    rows = rows.withColumn("arrival", arrival)
    for k in range(rows.agg(F.max("arrival")).first()[0] + 1):
        again = (F.col("arrival") == k - 1) & (F.col("batch_no") % 4 == 0)
        rows.where((F.col("arrival") == k) | again).write.mode("append").parquet(folder)
        alert_stream.follow(spark.readStream.schema(rows.schema).parquet(folder), out, cp, lateness=2)
    alert_stream.finish(spark, out)
    return alert_stream.events(spark, out).select("pipeline", "checkpoint", "alert_id", "batch_no", "first_batch", "severity", "message", "event")


# --- faults ---

def _fault(name: str, pipeline: str = "web_analytics"):
    return [f for f in faults.catalog(pipeline) if f.scenario == name]


def _inject(spark, d, name, *cols, pipeline="web_analytics"):
    raw = _raw(spark, d, pipeline)
    return faults.apply_scenarios(raw, _fault(name, pipeline), ev.PIPELINES[pipeline].row_id).select("batch_no", "line_no", *cols)


@query
def inj_unit_change(spark, d):
    return _inject(spark, d, "unit_change_android", "duration_ms")


@query
def inj_feed_stops(spark, d):
    return _inject(spark, d, "feed_stops_ios", "client_version")


@query
def inj_new_nullable(spark, d):
    return _inject(spark, d, "new_nullable_web", "user_id")


@query
def inj_type_change(spark, d):
    return _inject(spark, d, "type_change_android", "duration_ms", "duration_ms_text", "duration_ms_kind")


@query
def inj_gradual_drift(spark, d):
    return _r(_inject(spark, d, "gradual_drift_ios", "duration_ms"), "duration_ms", digits=4)


@query
def inj_text_change(spark, d):
    return _inject(spark, d, "text_change_web", "error_message")


@query
def inj_volume_drop(spark, d):
    return _inject(spark, d, "volume_drop_android", "client_version")


@query
def inj_invalid_enum(spark, d):
    return _inject(spark, d, "invalid_status_ach", "status", pipeline="payment_processing")


@query
def inj_clean(spark, d):
    return _inject(spark, d, "clean", "duration_ms", "user_id")


_ORDER = ["batch_no", "line_no"]


@query
def inj_scale(spark, d):
    return faults.scale(views.web_raw(spark, d), "duration_ms").select("line_no", "duration_ms")


@query
def inj_drop_column(spark, d):
    """A dropped required field: every field check reports it, the schema check as a failure."""
    raw = faults.drop_column(views.web_raw(spark, d), "user_id")
    cp = Checkpoint("after_ingest", "client_version", fields=(
        ("user_id", (Spec("schema", dtype="object"), Spec("nulls", max_null_rate=0.1))),))
    return checks.run_checkpoint(raw, "w", cp, 1, ["batch_no"]).select(
        "batch_no", F.col("check").alias("check_name"), "field", "status", "message")


@query
def inj_null_half(spark, d):
    return faults.null_half(views.web_raw(spark, d), "session_id", _ORDER).select("batch_no", "line_no", "session_id")


@query
def inj_cut_80(spark, d):
    return faults.cut_80(views.web_raw(spark, d), _ORDER).select("batch_no", "line_no")


@query
def inj_duplicate_rows(spark, d):
    out = faults.duplicate_rows(views.web_raw(spark, d), _ORDER)
    return out.groupBy("batch_no", "event_id").agg(F.count(F.lit(1)).alias("copies"))


@query
def inj_cast_text(spark, d):
    out = faults.cast_text(views.web_raw(spark, d).withColumn("duration_ms", F.col("duration_ms").cast("bigint")), "duration_ms")
    return out.select("line_no", "duration_ms")


@query
def fault_cases_for_findings(spark, d):
    reviewed = reports.review(registry.findings(spark, d), registry.decisions(spark, d))
    return faults.cases_for_findings(reviewed).select("finding_id", "pipeline", "case_name", "fault")


@query
def scenario_catalog(spark, d):
    """What each web scenario does to each segment, in one pass."""
    raw = views.web_raw(spark, d)
    scen = faults.apply_scenarios(raw, faults.catalog("web_analytics"), "event_id")
    return scen.groupBy("scenario", "client_version", (F.col("batch_no") >= 4).alias("after_onset")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("user_id").alias("users"), F.count("error_message").alias("messages"),
        F.count_if(F.col("duration_ms_kind") == "text").alias("texts"), F.round(F.sum("duration_ms") / 1e6, 4).alias("mega_ms"))


# --- scoring ---

def _truth(spark, pipeline="web_analytics"):
    return faults.ground_truth(spark, faults.catalog(pipeline), ev.N_BATCHES)


@query
def score_match(spark, d):
    return scoring.match(_web_alerts(spark, d), _truth(spark), ["scenario"]).select(
        "scenario", "alert_id", "first_batch", "injection_id", "is_match")


@query
def score_scenario(spark, d):
    return _evaluation(spark, d)[1].where(F.col("system") == "ours").drop("system")


def _score_system(spark, d, pipeline):
    return _r(scoring.system_scores(_evaluation(spark, d, pipeline)[1], ["system"]), "precision", "recall", "mean_lag_batches")


@query
def score_system(spark, d):
    return _score_system(spark, d, "web_analytics")


@query
def score_system_behavior(spark, d):
    return _score_system(spark, d, "user_behavior")


@query
def score_system_payments(spark, d):
    return _score_system(spark, d, "payment_processing")


@query
def score_matrix(spark, d):
    return scoring.matrix(_evaluation(spark, d)[1], ["B0", "B1", "ours"])


@query
def score_gate(spark, d):
    return _r(scoring.gate(_score_system(spark, d, "web_analytics").where(F.col("system") == "ours")), "value")


@query
def score_by_check(spark, d):
    problems = alerts.problems(_ours(spark, d))
    return scoring.by_check(problems, _truth(spark)).withColumnRenamed("check", "check_name")


@query
def score_first_crash(spark, d):
    """First batch per scenario that sends text where a number is expected, and how many such values come in all."""
    crashed = ev.scenario_crashes(views.web_raw(spark, d), "web_analytics", faults.catalog("web_analytics"))
    return crashed.groupBy("scenario").agg(F.min("batch_no").alias("crashed_at_batch"), F.sum("uncastable").alias("uncastable"))


# --- lineage ---

def _sales(spark, d):
    def make():
        nodes, edges = graphs.sales_graph(spark, d)
        return staged(nodes, "nodes"), staged(edges, "edges")
    return _once(spark, d, "sales", make)


def _sales_cover(spark, d):
    """The numbered nodes, and one index for both directions."""
    def make():
        nodes, links = graphs.sales_links(spark, d)
        return reachability.cover(links, collapse=False), nodes
    return _once(spark, d, "sales_cover", make)


@query
def graph_dedup(spark, d):
    nodes, edges = _sales(spark, d)
    kept = lineage.dedup_edges(edges).groupBy("pipeline", "type").agg(F.count(F.lit(1)).alias("n"))
    first = lineage.dedup_nodes(nodes, ["type", "label"]).groupBy("pipeline", "type").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(first)


@query
def lineage_edges(spark, d):
    return lineage.lineage_edges(_sales(spark, d)[1]).groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


@query
def lineage_downstream(spark, d):
    return graphs.sales_names(reachability.count_all(*_sales_cover(spark, d), outputs=F.col("type") == "output"), "start")


@query
def lineage_upstream(spark, d):
    return graphs.sales_names(reachability.count_all(*_sales_cover(spark, d), back=True), "start")


@query
def lineage_affected_outputs(spark, d):
    """Outputs every part field can reach."""
    nodes, edges = _sales(spark, d)
    parts = nodes.where(F.col("label").startswith("part_")).select("pipeline", F.col("label").alias("field"))
    return lineage.affected_outputs(nodes, edges, parts)


@query
def lineage_unused_fields(spark, d):
    """Parts that a pipeline's loader writes and nothing there reads or derives from, over the whole graph."""
    nodes, edges = graphs.loaded_parts(spark, d, *_sales(spark, d))
    return lineage.unused_fields(nodes, edges).select("pipeline", "field").distinct()


@query
def lineage_stage_summary(spark, d):
    nodes, edges = _sales(spark, d)
    return lineage.stage_summary(nodes, edges).groupBy("pipeline", "stage", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))


def _observed(spark, d):
    li = views.table(spark, d, "lineitem")
    p = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("pipeline")
    labels = F.array(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")),
                     F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")), F.concat(F.lit("status_"), "l_linestatus"))
    return li.select(p, F.explode(labels).alias("label")).distinct()


@query
def lineage_merge_origin(spark, d):
    return lineage.merge_origin(_sales(spark, d)[0], _observed(spark, d)).groupBy("pipeline", "type", "origin").agg(F.count(F.lit(1)).alias("n"))


@query
def lineage_merge_report(spark, d):
    return _r(lineage.merge_report(*_sales(spark, d), _observed(spark, d)), "field_agreement", "edge_agreement")


# --- profile, equivalence, review, reports ---

@query
def profile_stage(spark, d):
    raw = views.web_raw(spark, d)
    cleaned = web.clean(raw)
    return reports.profile_stages([("ingest", raw), ("clean", cleaned), ("enrich", web.enrich(cleaned)),
                                   ("aggregate", web.aggregate(web.enrich(cleaned)))])


def _equivalence(spark, d):
    """Golden daily metrics against the same pipeline without its dedup step."""
    golden = web.run(views.web_raw(spark, d))
    rewritten = views.web_raw(spark, d).withColumn("event_id", F.concat("event_id", F.lit("-"), F.col("line_no").cast("string")))
    return reports.equivalence_rows(_rounded(golden), _rounded(web.run(rewritten)), ["date", "platform", "country"])


def _rounded(df):
    return _r(df, "error_rate", "timeout_rate", "avg_duration_s", "p95_duration_s", digits=9)


@query
def equivalence_diff(spark, d):
    return _equivalence(spark, d)


@query
def equivalence_score(spark, d):
    return _r(reports.equivalence_score(_equivalence(spark, d)), "equivalence_score")


@query
def equivalence_set_difference(spark, d):
    a = views.web_raw(spark, d).groupBy("client_version", "page").agg(F.count(F.lit(1)).alias("n"))
    b = stages.filter_required(views.web_raw(spark, d), "user_id").groupBy("client_version", "page").agg(F.count(F.lit(1)).alias("n"))
    return reports.difference(a, b)


@query
def review_status(spark, d):
    return reports.review_counts(reports.review(registry.findings(spark, d), registry.decisions(spark, d)))


@query
def rep_failed_last_run(spark, d):
    results = _ours(spark, d).withColumn("pipeline", F.col("scenario"))
    return reports.failed_last_run(results).select("pipeline", "batch_no", "checkpoint", F.col("check").alias("check_name"), "segment", "status")


@query
def rep_alerts_by_field(spark, d):
    start = F.lit("2024-01-01").cast("date")
    made = _alerts_as_pipelines(spark, d).withColumn("created", F.date_add(start, ((F.col("first_batch") - 1) * 3).cast("int")))
    return reports.alerts_by_field(made, "created", F.lit("2024-01-07").cast("date"))


def _summary(spark, d):
    import functools
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    names = list(ev.PIPELINES)
    reviewed = reports.review(registry.findings(spark, d, by_feed=False), registry.decisions(spark, d))
    results = union([_ours(spark, d, n).select("pipeline", "status") for n in names])
    alarm = union([alerts.latest(_ours(spark, d, n), ["scenario"]).select("pipeline", "severity") for n in names])
    false = lambda n: _r(scoring.false_alarms(_evaluation(spark, d, n)[1], ["system"]), "false_positive_rate")
    scores = union([_score_system(spark, d, n).join(false(n), "system").where(F.col("system") == "ours").withColumn("pipeline", F.lit(n))
                    for n in names])
    equal = equivalence_score(spark, d).withColumn("pipeline", F.lit("web_analytics"))
    return reports.pipeline_summary(reviewed, results, alarm, scores, equal)


@query
def rep_pipeline_summary(spark, d):
    return _summary(spark, d)


@query
def rep_scorecard(spark, d):
    feeds = registry.findings(spark, d).select("pipeline").distinct()
    names = registry.findings(spark, d, by_feed=False).select("pipeline").distinct().unionByName(feeds)
    return reports.scorecard(names, _summary(spark, d))
