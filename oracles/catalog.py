"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracles import checks as c
from oracles import inputs as i

ORACLES: dict[str, str] = {}
BY = "scenario, batch_no, "


def sql(name: str, ctes: list[str], select: str) -> None:
    head = "WITH " + ",".join(ctes) + "\n" if ctes else ""
    ORACLES[name] = head + select


def union(parts: list[str]) -> str:
    return "\nUNION ALL BY NAME\n".join(f"({p})" for p in parts)


WEB, PAY = i.WEB_RAW, i.PAY_RAW
WEB_SCEN = [WEB, i.scenario_frame("scen", "web_raw", i.WEB_FAULTS, "event_id", "client_version", "duration_ms"),
            i.web_clean("clean", "scen", BY), i.web_enrich("enriched", "clean"), i.web_aggregate("agg", "enriched", BY)]
WEB_BASE = [f"\nlearn AS (SELECT * FROM web_raw WHERE batch_no IN {i.BASELINE})", i.web_clean("learn_clean", "learn", "batch_no, "),
            i.numeric_baseline("learn_clean", "duration_s", "client_version", "event_id"),
            i.text_baseline("learn", "error_message", "client_version"), i.volume_baseline("learn_clean", "client_version", "bv")]
BEH_SCEN = [WEB, i.scenario_frame("scen", "web_raw", i.BEHAVIOR_FAULTS, "event_id", "client_version", "duration_ms"),
            i.sessions("kept_sessions", "scen"), i.behavior("agg", "kept_sessions", BY)]
BEH_BASE = [f"\nlearn AS (SELECT * FROM web_raw WHERE batch_no IN {i.BASELINE})", i.sessions("learn_kept", "learn"),
            i.numeric_baseline("learn_kept", "session_duration_s", "client_version", "event_id"),
            i.volume_baseline("learn_kept", "client_version", "bv")]
PAY_SCEN = [PAY, i.scenario_frame("scen", "pay_raw", i.PAY_FAULTS, "transaction_id", "payment_method", "amount_cents"),
            i.pay_clean("clean", "scen", BY), i.pay_enrich("enriched", "clean"), i.reconcile("agg", "enriched", BY)]
PAY_BASE = [f"\nlearn AS (SELECT * FROM pay_raw WHERE batch_no IN {i.BASELINE})", i.pay_clean("learn_clean", "learn", "batch_no, "),
            i.numeric_baseline("learn_clean", "amount_usd", "payment_method", "transaction_id"),
            i.text_baseline("learn", "error_message", "payment_method"), i.volume_baseline("learn_clean", "payment_method", "bv")]

STATUS = ("settled", "declined", "pending", "refunded")
CV, PM, KIND = "client_version", "payment_method", "duration_ms_kind"
WEB_RESULTS = [
    c.volume("scen", "after_ingest", 1, 1, 50), c.schema("scen", "after_ingest", 1, 2, "event_id", "object"),
    c.null_rate("scen", "after_ingest", 1, 3, "user_id", CV, 0.10),
    c.schema("scen", "after_ingest", 1, 4, "duration_ms", "numeric", KIND),
    c.in_range("scen", "after_ingest", 1, 5, "duration_ms", CV, 0.0, 3600000.0, kind=KIND),
    c.oov("scen", "after_ingest", 1, 6, "error_message", CV, 0.20), c.template("scen", "after_ingest", 1, 7, "error_message", CV, 0.30),
    c.segment_volume("clean", "after_clean", 2, 1, CV), c.null_rate("clean", "after_clean", 2, 2, "user_id", CV, 0.02),
    c.unit("clean", "after_clean", 2, 3, "duration_s", CV), c.in_range("clean", "after_clean", 2, 4, "duration_s", CV, 0.0, 300.0),
    c.psi("clean", "after_clean", 2, 5, "duration_s", CV), c.ks("clean", "after_clean", 2, 6, "duration_s", CV),
    c.key_set("enriched", "after_enrich", 3, 1, "country", ("US", "GB", "DE", "IN", "SG", "Other")),
    c.volume("agg", "after_aggregate", 4, 1, 1), c.in_range("agg", "after_aggregate", 4, 2, "error_rate", "platform", 0.0, 1.0),
    c.in_range("agg", "after_aggregate", 4, 3, "timeout_rate", "platform", 0.0, 1.0),
    c.in_range("agg", "after_aggregate", 4, 4, "avg_duration_s", "platform", 0.0, 300.0),
]
PAY_RESULTS = [
    c.volume("scen", "after_ingest", 1, 1, 50), c.schema("scen", "after_ingest", 1, 2, "transaction_id", "object"),
    c.schema("scen", "after_ingest", 1, 3, "amount_cents", "numeric", "amount_cents_kind"),
    c.in_range("scen", "after_ingest", 1, 4, "amount_cents", PM, 0.0, 99999999.0, kind="amount_cents_kind"),
    c.null_rate("scen", "after_ingest", 1, 5, "user_id", PM, 0.15),
    c.oov("scen", "after_ingest", 1, 6, "error_message", PM, 0.25), c.template("scen", "after_ingest", 1, 7, "error_message", PM, 0.35),
    c.volume("clean", "after_clean", 2, 1, 1), c.segment_volume("clean", "after_clean", 2, 2, PM),
    c.unit("clean", "after_clean", 2, 3, "amount_usd", PM), c.in_range("clean", "after_clean", 2, 4, "amount_usd", PM, 0.0, 1000000.0),
    c.psi("clean", "after_clean", 2, 5, "amount_usd", PM), c.ks("clean", "after_clean", 2, 6, "amount_usd", PM),
    c.key_set("clean", "after_clean", 2, 7, "status", STATUS), c.null_rate("clean", "after_clean", 2, 8, "user_id", PM, 0.02),
    c.volume("enriched", "after_enrich", 3, 1, 1),
    c.key_set("enriched", "after_enrich", 3, 2, "merchant_region", ("North America", "Europe", "Asia Pacific", "Other")),
    c.volume("agg", "after_reconcile", 4, 1, 1), c.in_range("agg", "after_reconcile", 4, 2, "total_volume_usd", None, 0.0, 1000000000000.0),
]
BEH_RESULTS = [
    c.volume("scen", "after_ingest", 1, 1, 50), c.null_rate("scen", "after_ingest", 1, 2, "user_id", CV, 0.15),
    c.schema("scen", "after_ingest", 1, 3, "duration_ms", "numeric", KIND),
    c.volume("kept_sessions", "after_filter_sessions", 2, 1, 1), c.segment_volume("kept_sessions", "after_filter_sessions", 2, 2, CV),
    c.null_rate("kept_sessions", "after_filter_sessions", 2, 3, "user_id", CV, 0.02),
    c.unit("kept_sessions", "after_filter_sessions", 2, 4, "session_duration_s", CV),
    c.in_range("kept_sessions", "after_filter_sessions", 2, 5, "session_duration_s", CV, 0.0, 86400.0),
    c.psi("kept_sessions", "after_filter_sessions", 2, 6, "session_duration_s", CV),
    c.ks("kept_sessions", "after_filter_sessions", 2, 7, "session_duration_s", CV),
    c.volume("agg", "after_aggregate", 3, 1, 1), c.in_range("agg", "after_aggregate", 3, 2, "session_count", None, 0.0, 100000.0),
]
SHAPE = "scenario, batch_no, checkpoint, check_name, field, segment, status, message, round(metric, 6) AS metric, n_rows"
FULL = SHAPE.replace("checkpoint,", "cp_order, check_seq, check_type, checkpoint,", 1)


def scen_in(*names: str) -> str:
    return "scenario IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def check(name: str, ctes: list[str], parts: list[str], *scenarios: str, full: bool = False, where: str = "true") -> None:
    sql(name, ctes + [f"\nresults AS ({union(parts)})"],
        f"SELECT {FULL if full else SHAPE} FROM results WHERE {scen_in(*scenarios)} AND {where}")


# --- sources and sinks ---
_MS = "epoch_us(event_ts) // 1000"
sql("src_web_jsonl", [WEB], f"""SELECT 'batch_' || lpad(CAST(batch_no AS VARCHAR), 4, '0') AS batch_id, batch_no, line_no, event_id,
  {_MS} AS event_ts, user_id, session_id, platform, client_version, page, action, duration_ms, error_message, duration_ms_kind FROM web_raw""")
sql("src_behavior_jsonl", [WEB], f"""SELECT 'batch_' || lpad(CAST(batch_no AS VARCHAR), 4, '0') AS batch_id, batch_no, line_no, event_id,
  user_id, session_id, platform, client_version, {_MS} AS session_start_ms, duration_ms, action, duration_ms_kind, {_MS} AS session_start FROM web_raw""")
sql("src_payments_jsonl", [PAY], """SELECT 'batch_' || lpad(CAST(batch_no AS VARCHAR), 4, '0') AS batch_id, batch_no, line_no, transaction_id,
  event_ts, merchant_id, user_id, amount_cents, CAST(NULL AS VARCHAR) AS currency, payment_method, status, error_message, amount_cents_kind FROM pay_raw""")
ORACLES["src_payments_jsonl"] = ORACLES["src_payments_jsonl"].replace("CAST(NULL AS VARCHAR) AS currency", "currency")
sql("src_sql_table", [PAY], """SELECT transaction_id, user_id, amount_cents, amount_cents / CAST(100 AS DOUBLE) AS amount_usd, status FROM pay_raw
  WHERE user_id IS NOT NULL AND amount_cents > 0 AND amount_cents < 99999999""")
sql("src_batch_stream", [WEB], """SELECT batch_no, client_version, count(*) AS n_rows, count(*) - count(user_id) AS null_users, count(duration_ms) AS numbers
  FROM web_raw GROUP BY ALL""")
sql("sink_batch_jsonl", [WEB], """SELECT 'batch_' || lpad(CAST(batch_no AS VARCHAR), 4, '0') AS batch_id, count(*) AS lines,
  count(DISTINCT event_id) AS events FROM web_raw GROUP BY batch_no""")

# --- pipeline operators ---
sql("dedup_keep_first", [WEB], f"SELECT event_id, line_no, duration_ms FROM {i.first_rows('web_raw', 'event_id')}")
sql("dedup_keep_earliest", [PAY], f"SELECT transaction_id, event_ts, amount_cents FROM {i.first_rows('pay_raw', 'transaction_id', 'event_ts, batch_no, line_no')}")
sql("filter_required", [WEB], "SELECT platform, count(*) AS n FROM web_raw WHERE user_id IS NOT NULL GROUP BY platform")
sql("filter_range", [PAY], "SELECT payment_method, count(*) AS n, max(amount_cents) AS max_cents FROM pay_raw WHERE amount_cents > 0 AND amount_cents < 99999999 GROUP BY 1")
sql("filter_allowed", [PAY], f"SELECT status, count(*) AS n FROM pay_raw WHERE status IN {STATUS} GROUP BY 1")
sql("filter_action", [WEB], "SELECT page, count(*) AS n FROM web_raw WHERE action = 'page_view' GROUP BY 1")
sql("unit_convert", [WEB], "SELECT event_id, line_no, duration_ms / CAST(1000 AS DOUBLE) AS duration_s FROM web_raw")
sql("flag_error", [PAY], "SELECT line_no, error_message IS NOT NULL AS has_message, coalesce(contains(lower(error_message), 'error'), false) AS is_error FROM pay_raw")
sql("flag_keyword", [WEB], "SELECT line_no, coalesce(contains(lower(error_message), 'timeout'), false) AS is_timeout FROM web_raw")
sql("split_version", [PAY], """SELECT line_no, split_part(client_version, '.', 1) AS major_version,
  CASE WHEN contains(client_version, '.') THEN split_part(client_version, '.', 1) ELSE '' END AS major_before_dot FROM pay_raw""")
sql("map_lookup_default", [WEB, i.web_enrich("e", "web_raw")], "SELECT session_id, country, count(*) AS n FROM e GROUP BY ALL")
sql("prefix_case", [PAY, i.pay_enrich("e", "pay_raw")], "SELECT merchant_id, merchant_region, count(*) AS n FROM e GROUP BY ALL")
sql("date_extract", [PAY, i.pay_enrich("a", "pay_raw", "ns"), i.pay_enrich("b", "a", "ms").replace("SELECT *", "SELECT * EXCLUDE (transaction_date, merchant_region), transaction_date AS date_ns")],
    "SELECT date_ns, transaction_date AS date_ms, count(*) AS n FROM b GROUP BY ALL")
sql("web_daily_metrics", [WEB, i.web_clean("cl", "web_raw"), i.web_enrich("en", "cl"), i.web_aggregate("ag", "en")],
    """SELECT * REPLACE (round(error_rate, 6) AS error_rate, round(timeout_rate, 6) AS timeout_rate, round(avg_duration_s, 9) AS avg_duration_s,
  round(p95_duration_s, 6) AS p95_duration_s) FROM ag""")
sql("behavior_user_rollup", [WEB, i.sessions("se", "web_raw"), i.behavior("ag", "se")],
    "SELECT * REPLACE (round(avg_session_duration_s, 9) AS avg_session_duration_s) FROM ag")
_PAY = """SELECT * REPLACE (round(total_volume_usd, 2) AS total_volume_usd, round(avg_transaction_usd, 6) AS avg_transaction_usd,
  round(error_rate, 6) AS error_rate, round(decline_rate, 6) AS decline_rate) FROM ag"""
sql("payments_reconcile", [PAY, i.pay_clean("cl", "pay_raw"), i.pay_enrich("en", "cl"), i.reconcile("ag", "en")], _PAY)
sql("payments_reconcile_true_dates", [PAY, i.pay_clean("cl", "pay_raw"), i.pay_enrich("en", "cl", "ms"), i.reconcile("ag", "en")], _PAY)
sql("payments_sql_feed", [PAY, i.pay_clean_sql("cl", "pay_raw"), i.pay_enrich("en", "cl", "ms"), i.reconcile("ag", "en")], _PAY)

# --- checks ---
sql("segment_split", [WEB], "SELECT batch_no, coalesce(user_id, 'nan') AS segment, count(*) AS n_rows FROM web_raw GROUP BY ALL")
_missing = [c.row("after_ingest", 1, s, n, t, "trace_id", c.NOSEG, f"'{st}'", "'''trace_id'' is missing from this batch'", "NULL", "NULL",
                  "(SELECT DISTINCT scenario, batch_no FROM scen)") for s, n, t, st in
            ((3, "schema:trace_id", "schema", "fail"), (4, "null_rate:trace_id", "nulls", "error"))]
check("chk_schema", WEB_SCEN, [WEB_RESULTS[1], WEB_RESULTS[3], *_missing], "clean", "type_change_android", "unit_change_android")
check("src_batch_contract", WEB_SCEN, WEB_RESULTS[:5], "clean")
check("chk_null_rate", WEB_SCEN, [WEB_RESULTS[2], WEB_RESULTS[8]], "clean", "new_nullable_web")
check("chk_range", WEB_SCEN, [c.in_range("scen", "after_ingest", 1, 1, "duration_ms", CV, 0.0, 200000.0, kind=KIND)],
      "clean", "type_change_android", "gradual_drift_ios")
check("chk_volume", PAY_SCEN, [c.volume("scen", "after_ingest", 1, 1, 1300, 1000000000)], "clean", "feed_stops_wallet")
check("chk_key_set", PAY_SCEN, [c.key_set("scen", "after_ingest", 1, 1, "status", STATUS)], "clean", "invalid_status_ach")
sql("chk_key_set_values", PAY_SCEN, f"""SELECT scenario, batch_no, status AS value, count(*) AS n FROM scen
  WHERE scenario IN ('clean', 'invalid_status_ach') AND status IS NOT NULL AND status NOT IN {STATUS} GROUP BY ALL""")
sql("chk_range_text", [WEB, """
b AS (SELECT batch_no, count(DISTINCT coalesce(client_version, 'nan')) AS segs,
  count(*) FILTER (WHERE error_message IS NOT NULL AND try_cast(error_message AS DOUBLE) IS NULL) AS k FROM web_raw GROUP BY 1)"""],
    """SELECT batch_no, 'range:error_message' AS check_name, CASE WHEN k > 0 THEN 'check cannot run: ' || k || ' values are no numbers' END AS error,
  CASE WHEN k > 0 THEN CAST(1 AS BIGINT) ELSE segs END AS n FROM b UNION ALL SELECT batch_no, 'null_rate:user_id', NULL, segs FROM b""")
check("chk_cardinality", WEB_SCEN, [c.cardinality("scen", "after_ingest", 1, 1, "client_version", 5), c.cardinality("scen", "after_ingest", 1, 2, "platform", 3)],
      "clean", "feed_stops_ios")
check("chk_unit", WEB_SCEN + WEB_BASE, [WEB_RESULTS[9]], "clean", "unit_change_android")
check("chk_segment_volume", WEB_SCEN + WEB_BASE, [WEB_RESULTS[7]], "clean", "feed_stops_ios", "volume_drop_android")
check("drift_psi", WEB_SCEN + WEB_BASE, [WEB_RESULTS[11]], "clean", "gradual_drift_ios", "unit_change_android")
check("drift_ks", WEB_SCEN + WEB_BASE, [WEB_RESULTS[12]], "clean", "gradual_drift_ios", "unit_change_android")
check("drift_numeric_run", PAY_SCEN + PAY_BASE, [PAY_RESULTS[11], PAY_RESULTS[12]], "clean", "unit_change_card", "feed_stops_wallet")
check("drift_oov", WEB_SCEN + WEB_BASE, [WEB_RESULTS[5]], "clean", "text_change_web")
check("drift_template", WEB_SCEN + WEB_BASE, [WEB_RESULTS[6]], "clean", "text_change_web")
MSG = [i.MSG_RAW, "\nmsgs AS (SELECT *, 'documents' AS scenario FROM msg)",
       f"\nlearn AS (SELECT * FROM msg WHERE batch_no IN {i.BASELINE})", i.text_baseline("learn", "text", "lang")]
sql("drift_text_documents", MSG + [f"\nresults AS ({union([c.oov('msgs', 'after_ingest', 1, 1, 'text', 'lang', 0.15), c.template('msgs', 'after_ingest', 1, 2, 'text', 'lang', 0.30)])})"],
    f"SELECT {SHAPE.replace(' message,', '')} FROM results")
check("chk_contract", WEB_SCEN + WEB_BASE, WEB_RESULTS, "clean", "gradual_drift_ios", "type_change_android", full=True)
check("chk_contract_payments", PAY_SCEN + PAY_BASE, PAY_RESULTS, "clean", "invalid_status_ach", "unit_change_card", full=True)
check("chk_contract_behavior", BEH_SCEN + BEH_BASE, BEH_RESULTS, "clean", "action_flood_ios", full=True)
check("chk_contract_naive", WEB_SCEN, [WEB_RESULTS[3]], "clean", "type_change_android")

# --- registry ---
_KINDS = ["unit_conversion", "required_field", "row_filter", "dedup_key", "unmapped_to_null", "default_fill", "keyword_match", "string_format",
          "timestamp_unit", "timezone", "group_key_drops_nulls", "null_lookalike_value", "runtime_columns", "unused_field"]
_FIELDS = ["duration_ms", "user_id", "error_message", "event_id", "country_id", "avg_duration_s", "status"]


def reviewed(pipeline: str = "source") -> str:
    return f"""
findings AS (SELECT 'finding_' || doc_id AS finding_id, {pipeline} AS pipeline, ({_KINDS})[doc_id % 14 + 1] AS kind,
    ({_FIELDS})[(doc_id // 14) % 7 + 1] AS field, doc_id FROM documents),
reviewed AS (SELECT f.*, coalesce(CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'confirmed' ELSE 'pending' END, 'pending') AS status
  FROM findings f LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id AS d, quality, toxic FROM labels) l ON l.d = f.doc_id)"""


_BY_NAME = "(['web_analytics', 'user_behavior', 'payment_processing'])[CAST(substr(source, 4) AS INTEGER) % 3 + 1]"
_ROWS = [(1, "after_ingest", None, "volume", "volume"), (1, "after_ingest", "event_id", "schema", "schema"),
         (1, "after_ingest", "user_id", "nulls", "nulls"), (1, "after_ingest", "duration_ms", "schema", "schema"),
         (1, "after_ingest", "duration_ms", "range", "range"), (1, "after_ingest", "error_message", "text_drift", "text_drift"),
         (2, "after_clean", None, "volume", "segment_volume"), (2, "after_clean", "user_id", "nulls", "nulls"),
         (2, "after_clean", "duration_s", "unit", "unit"), (2, "after_clean", "duration_s", "range", "range"),
         (2, "after_clean", "duration_s", "numeric_drift", "numeric_drift"), (3, "after_enrich", "country", "schema", "schema"),
         (4, "after_aggregate", None, "volume", "volume"), (4, "after_aggregate", "error_rate", "range", "range"),
         (4, "after_aggregate", "timeout_rate", "range", "range"), (4, "after_aggregate", "avg_duration_s", "range", "range")]
_VALUES = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else ("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'") for v in r) + ")" for r in _ROWS)
_ALLOW = [("unit_conversion", t) for t in ("unit", "range", "numeric_drift")] + [
    ("required_field", "nulls"), ("dedup_key", "schema"), ("unmapped_to_null", "schema"), ("default_fill", "schema"), ("default_fill", "nulls"),
    ("keyword_match", "text_drift"), ("string_format", "text_drift"), ("timestamp_unit", "schema"), ("timestamp_unit", "unit"),
    ("timezone", "schema"), ("group_key_drops_nulls", "nulls"), ("null_lookalike_value", "nulls")]


def stem(f: str) -> str:
    return f"CASE WHEN regexp_matches({f}, '^..+(_ms|_s|_usd|_cents|_id|_rate|_count)$') THEN regexp_replace({f}, '(_ms|_s|_usd|_cents|_id|_rate|_count)$', '') ELSE {f} END"


DECIDED = [reviewed(), f"""
kept AS (
  SELECT DISTINCT p.pipeline, c.* FROM (SELECT DISTINCT source AS pipeline FROM documents) p,
    (VALUES {_VALUES}) AS c(cp_order, checkpoint, field, check_type, kind)
  WHERE CASE WHEN c.field IS NULL THEN EXISTS (SELECT 1 FROM reviewed r WHERE r.pipeline = p.pipeline AND r.status = 'confirmed' AND r.kind = 'row_filter')
    ELSE EXISTS (SELECT 1 FROM reviewed r JOIN (VALUES {', '.join(str(a) for a in _ALLOW)}) AS k(kind, check_type) ON k.kind = r.kind
      WHERE r.pipeline = p.pipeline AND r.status = 'confirmed' AND k.check_type = c.check_type AND {stem('r.field')} = {stem('c.field')}) END)"""]
sql("contract_for_decisions", DECIDED, "SELECT * FROM kept")
sql("contract_counts", DECIDED, """SELECT pipeline, count(*) AS enforced_checks,
  bool_or(kind IN ('segment_volume', 'unit', 'numeric_drift', 'text_drift')) AS needs_baselines FROM kept GROUP BY pipeline""")
sql("review_status", [reviewed()], """SELECT pipeline, count(*) AS total, count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
  count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'pending') AS pending FROM reviewed GROUP BY pipeline""")
sql("fault_cases_for_findings", [reviewed()], """SELECT finding_id, pipeline, CASE kind WHEN 'unit_conversion' THEN 'test_unit_conversion_' || field
  WHEN 'required_field' THEN 'test_missing_field_' || field WHEN 'row_filter' THEN 'test_row_filter'
  WHEN 'group_key_drops_nulls' THEN 'test_null_in_key_' || field ELSE 'test_duplicate_key_' || field END AS case_name,
  CASE kind WHEN 'unit_conversion' THEN 'inj_scale' WHEN 'required_field' THEN 'inj_drop_column' WHEN 'row_filter' THEN 'inj_cut_80'
  WHEN 'group_key_drops_nulls' THEN 'inj_null_half' ELSE 'inj_duplicate_rows' END AS fault
  FROM reviewed WHERE status = 'confirmed' AND kind IN ('unit_conversion', 'required_field', 'row_filter', 'group_key_drops_nulls', 'dedup_key')""")

# --- guard ---
CRASHED = "\ncrashed AS (SELECT scenario, batch_no, count(*) AS uncastable FROM scen WHERE duration_ms_kind = 'text' GROUP BY ALL)"
ALL_WEB = WEB_SCEN + WEB_BASE + [f"\nresults AS ({union(WEB_RESULTS)})", CRASHED]
OURS = ALL_WEB + [c.guarded("results", "crashed")]
_COUNTS = "SELECT scenario, batch_no, checkpoint, status, count(*) AS n FROM {} GROUP BY ALL"
sql("guard_observe", ALL_WEB, _COUNTS.format("(SELECT r.* FROM results r LEFT JOIN crashed USING (scenario, batch_no) WHERE uncastable IS NULL OR cp_order <= 1)"))
sql("guard_enforce", OURS, _COUNTS.format("kept"))
sql("guard_off", WEB_SCEN, "SELECT scenario, batch_no, count(*) AS n_rows FROM clean GROUP BY ALL")
BLOCK = ["\nblocked AS (SELECT scenario, batch_no, min(cp_order) FILTER (WHERE status = 'fail') AS b FROM results GROUP BY ALL)"]
sql("guard_passed", ALL_WEB + BLOCK, """SELECT scenario, batch_no, count(*) AS n_rows FROM clean LEFT JOIN blocked USING (scenario, batch_no)
  WHERE b IS NULL OR b > 2 GROUP BY ALL""")
sql("guard_quarantine", ALL_WEB + BLOCK, """SELECT scenario, batch_no, count(*) AS n_rows, round(sum(duration_s), 6) AS seconds
  FROM clean JOIN blocked USING (scenario, batch_no) WHERE b <= 2 GROUP BY ALL""")
sql("batch_outcome", ALL_WEB + BLOCK, """SELECT scenario, batch_no,
  CASE WHEN NOT crash THEN (['after_ingest', 'after_clean', 'after_enrich', 'after_aggregate'])[b] END AS blocked_at,
  CASE WHEN crash THEN 'clean' END AS crashed_at, NOT crash AND b IS NULL AS ok
  FROM (SELECT *, uncastable IS NOT NULL AND (b IS NULL OR b > 1) AS crash FROM blocked LEFT JOIN crashed USING (scenario, batch_no))""")
sql("batch_summary", OURS, """SELECT scenario, batch_no, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warn') AS warned,
  count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'fail') > 0 AS blocked,
  coalesce(array_to_string(list_sort(list(DISTINCT check_name) FILTER (WHERE status = 'fail')), ','), '') AS failing_checks FROM kept GROUP BY ALL""")
sql("sink_results_append", OURS, "SELECT scenario, checkpoint, check_name, status, count(*) AS n FROM kept GROUP BY ALL")
sql("sink_drift_rows", OURS, """SELECT scenario, batch_no, 'web_analytics' AS pipeline, checkpoint, field AS field_name, coalesce(segment, 'all') AS segment,
  CASE split_part(check_name, ':', 1) WHEN 'psi' THEN 'psi' WHEN 'ks' THEN 'ks_test' WHEN 'oov_rate' THEN 'oov' ELSE 'template_change' END AS drift_type,
  CASE status WHEN 'fail' THEN 'high' WHEN 'pass' THEN 'low' ELSE 'medium' END AS severity,
  CASE WHEN check_type = 'numeric_drift' THEN round(metric, 6) END AS baseline_value, CASE WHEN check_type = 'numeric_drift' THEN round(metric, 6) END AS current_value,
  CASE WHEN check_name LIKE 'oov%' THEN CAST(0.20 AS DOUBLE) WHEN check_name LIKE 'template%' THEN CAST(0.30 AS DOUBLE) END AS threshold, message
  FROM kept WHERE check_type IN ('numeric_drift', 'text_drift') AND status <> 'insufficient_data'""")

# --- baselines ---
sql("bl_numeric", [WEB, *WEB_BASE], """SELECT 'after_clean' AS checkpoint, 'duration_s' AS field, seg AS segment, sample_count, round(mean, 6) AS mean,
  round(median, 6) AS median, round(std, 6) AS std FROM bn_stats""")
sql("baseline_save_load", [WEB, *WEB_BASE], """SELECT seg AS segment, sample_count, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
  usual AS volume_median FROM bn_stats LEFT JOIN bv USING (seg)""")
sql("bl_sample", [WEB, i.web_clean("cl", "web_raw", "batch_no, "), i.numeric_baseline("cl", "duration_s", CV, "event_id", limit=500)],
    "SELECT seg AS segment, x FROM bn_sample")
sql("bl_bins", [WEB, *WEB_BASE], """SELECT seg AS segment, CAST(pos AS BIGINT) AS pos, edges[pos + 1] AS edge,
  CASE WHEN pos < 10 THEN coalesce(n, 0) END AS bin_count
  FROM (SELECT seg, edges, unnest(range(0, len(edges))) AS pos FROM bn_edges) e LEFT JOIN bn_bins b ON b.seg = e.seg AND b.bin = e.pos""".replace("SELECT seg AS segment", "SELECT e.seg AS segment"))
sql("bl_vocab", MSG, "SELECT seg AS segment, token FROM bt_vocab")
sql("bl_templates", [WEB, *WEB_BASE], "SELECT seg AS segment, template, n FROM bt_templates")
sql("baseline_top_templates", [WEB, *WEB_BASE], """SELECT seg AS segment, template, n FROM bt_templates
  QUALIFY row_number() OVER (PARTITION BY seg ORDER BY n DESC, template) <= 20""")
sql("bl_segment_volume", [WEB, *WEB_BASE], "SELECT 'after_clean' AS checkpoint, seg AS segment, array_to_string(batch_counts, ',') AS batch_counts, usual AS median FROM bv")
sql("sink_baseline_profiles", [WEB, *WEB_BASE], """
  SELECT 'after_clean' AS checkpoint, 'duration_s' AS field, seg AS segment, round(q[1], 6) AS p0, round(q[2], 6) AS p25, round(q[3], 6) AS p50,
    round(q[4], 6) AS p75, round(q[5], 6) AS p95, round(q[6], 6) AS p100, round(mean, 6) AS mean, round(std, 6) AS stddev,
    CAST(NULL AS BIGINT) AS cardinality, sample_count
  FROM bn_stats JOIN (SELECT seg, quantile_cont(x, [0, 0.25, 0.5, 0.75, 0.95, 1]) AS q FROM bn_sample GROUP BY seg) USING (seg)
  UNION ALL SELECT 'after_ingest', 'error_message', seg, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, coalesce(v.n, 0), sample_count
  FROM bt_count LEFT JOIN (SELECT seg, count(*) AS n FROM bt_vocab GROUP BY seg) v USING (seg)""")
_W3 = [f"\nlearn AS (SELECT * FROM web_raw WHERE batch_no IN {i.BASELINE})", i.web_clean("learn_clean", "learn", "batch_no, "), i.sessions("learn_kept", "learn"),
       f"\nplearn AS (SELECT * FROM pay_raw WHERE batch_no IN {i.BASELINE})", i.pay_clean("plearn_clean", "plearn", "batch_no, ")]
sql("bl_build_plan", [WEB, PAY, *_W3], " UNION ALL ".join(
    f"SELECT '{p}' AS pipeline, '{k}' AS kind, '{cp}' AS checkpoint, '{f}' AS field, {seg} AS segment, count({f}) AS sample_count FROM {t} GROUP BY {seg}"
    for p, k, cp, f, seg, t in (
        ("web_analytics", "numeric", "after_clean", "duration_s", CV, "learn_clean"), ("web_analytics", "text", "after_ingest", "error_message", CV, "learn"),
        ("user_behavior", "numeric", "after_filter_sessions", "session_duration_s", CV, "learn_kept"),
        ("payment_processing", "numeric", "after_clean", "amount_usd", PM, "plearn_clean"), ("payment_processing", "text", "after_ingest", "error_message", PM, "plearn"))))
sql("bl_merge", [WEB, *WEB_BASE], """SELECT s.seg AS segment, s.sample_count, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
  (SELECT string_agg(CAST(coalesce(b.n, 0) AS VARCHAR), ',' ORDER BY pos) FROM (SELECT unnest(range(0, len(e.edges) - 1)) AS pos FROM bn_edges e WHERE e.seg = s.seg) q
    LEFT JOIN bn_bins b ON b.seg = s.seg AND b.bin = q.pos) AS bin_counts, array_to_string(bv.batch_counts, ',') AS batch_counts, bv.usual, v.words, t.templates, t.records
  FROM bn_stats s LEFT JOIN bv ON bv.seg = s.seg LEFT JOIN (SELECT seg, count(*) AS words FROM bt_vocab GROUP BY seg) v ON v.seg = s.seg
  LEFT JOIN (SELECT seg, count(*) AS templates, CAST(sum(n) AS BIGINT) AS records FROM bt_templates GROUP BY seg) t ON t.seg = s.seg""")
check("bl_lookup", WEB_SCEN + WEB_BASE, [c.unit("clean", "after_clean", 1, 1, "duration_s", "platform"), c.unit("clean", "after_clean", 1, 1, "duration_s", CV)], "clean")

# --- alerts ---
UNGUARDED = ALL_WEB + [c.alert_ctes("results", "web_analytics")]
GUARDED = OURS + [c.alert_ctes("kept", "web_analytics")]
sql("alert_severity", ALL_WEB, """SELECT scenario, status, CASE status WHEN 'fail' THEN 'high' WHEN 'warn' THEN 'medium' WHEN 'error' THEN 'medium' ELSE 'low' END AS severity,
  count(*) AS n FROM results GROUP BY ALL""")
sql("alert_problem_key", UNGUARDED, "SELECT scenario, alert_id, root, count(*) AS n, count(DISTINCT checkpoint) AS checkpoints FROM prob GROUP BY ALL")
sql("alert_message", UNGUARDED, "SELECT scenario, batch_no, checkpoint, check_seq, segment, alert_message FROM prob")
sql("alert_episodes", UNGUARDED, "SELECT scenario, checkpoint, alert_id, segment, first_batch, last_batch, batches, nullif(nb, -1) AS closed_batch FROM epi")
sql("alert_open", UNGUARDED, "SELECT scenario, checkpoint, alert_id, first_batch, last_batch FROM epi WHERE nb = -1")
_SEV = "CASE greatest(rnk, coalesce(worst, 0)) WHEN 3 THEN 'high' ELSE 'medium' END"
sql("alert_changes", UNGUARDED, f"SELECT scenario, alert_id, checkpoint, batch_no, check_seq, first_batch, {_SEV} AS severity, alert_message AS message FROM chg")
_LATEST = "scenario, alert_id, severity, message, nullif(root_field, '') AS root_field, nullif(segment, '') AS segment, first_batch"
sql("alert_latest", GUARDED, f"SELECT {_LATEST} FROM latest")
sql("sink_alerts_upsert", GUARDED, f"SELECT {_LATEST.replace('scenario,', 'scenario AS pipeline,')} FROM latest")
_DER = [("duration_s", "duration_ms"), ("is_error", "error_message"), ("is_timeout", "error_message"), ("major_version", "client_version"),
        ("country", "session_id"), ("date", "event_ts")]
_PRO = [("events", "event_id"), ("active_users", "user_id"), ("error_rate", "is_error"), ("timeout_rate", "is_timeout"), ("avg_duration_s", "duration_s"),
        ("p95_duration_s", "duration_s"), ("date", "date"), ("platform", "platform"), ("country", "country")]
_EDGES = ", ".join([f"('field:{s}', 'field:{t}', 'derives')" for t, s in _DER] + [f"('field:{s}', 'out:{o}', 'produces')" for o, s in _PRO])
GRAPH = f"\nlinks AS (SELECT * FROM (VALUES {_EDGES}) AS e(source, target, type))"
REACH = """
reach AS (SELECT source AS start, target AS node FROM links UNION SELECT r.start, l.target FROM reach r JOIN links l ON l.source = r.node)"""


def recursive(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


recursive("alert_lineage", GUARDED + [GRAPH, REACH, """
prior AS (SELECT target, min(source) AS source FROM links GROUP BY target),
way AS (SELECT n AS start, n AS here, 1 AS k FROM (SELECT source AS n FROM links UNION SELECT target FROM links WHERE target LIKE 'field:%')
  UNION SELECT w.start, p.source, w.k + 1 FROM way w JOIN prior p ON p.target = w.here WHERE w.k < 9),
told AS (SELECT start, string_agg('field ' || substr(here, 7), ' < ' ORDER BY k) AS lineage FROM way GROUP BY start)"""],
    """SELECT scenario AS pipeline, alert_id, nullif(root_field, '') AS root_field, coalesce(o, '') AS affected_outputs,
    coalesce(lineage, '') AS lineage
  FROM latest LEFT JOIN told ON told.start = 'field:' || root_field LEFT JOIN (SELECT start, string_agg(DISTINCT substr(node, 5), ', ' ORDER BY substr(node, 5)) AS o FROM reach WHERE node LIKE 'out:%' GROUP BY start) r
  ON r.start = 'field:' || root_field""")
sql("alert_lineage_2hop", GUARDED + [GRAPH], """SELECT scenario AS pipeline, alert_id, nullif(root_field, '') AS root_field, o AS affected_outputs
  FROM latest LEFT JOIN (SELECT a.source, string_agg(DISTINCT b.target, ', ' ORDER BY b.target) AS o FROM links a JOIN links b ON b.source = a.target
    WHERE b.type = 'produces' GROUP BY a.source) r ON r.source = 'field:' || root_field""")
sql("alert_stream_events", UNGUARDED, f"""SELECT * REPLACE (replace(alert_id, 'web_analytics:', pipeline || ':') AS alert_id) FROM (SELECT scenario AS pipeline, checkpoint, alert_id, batch_no, first_batch, {_SEV} AS severity, alert_message AS message,
    CASE WHEN worst IS NULL THEN 'opened' ELSE 'changed' END AS event FROM chg
  UNION ALL SELECT e.scenario, e.checkpoint, e.alert_id, e.nb, e.first_batch, f.severity, f.message, 'closed' FROM epi e JOIN (
    SELECT scenario, checkpoint, root, segment, island, arg_max({_SEV}, batch_no * 1000 + check_seq) AS severity,
      arg_max(alert_message, batch_no * 1000 + check_seq) AS message FROM chg GROUP BY ALL) f
    ON f.scenario = e.scenario AND f.checkpoint = e.checkpoint AND f.root = e.root AND f.segment IS NOT DISTINCT FROM e.segment AND f.island = e.island
  WHERE e.nb <> -1)""")

sql("src_batch_chain", OURS, f"SELECT {SHAPE} FROM kept WHERE scenario = 'feed_stops_ios'")
sql("src_batch_chain_alerts", OURS + [c.alert_ctes("kept", "web_analytics")], f"""SELECT checkpoint, alert_id, batch_no, first_batch, severity, message, event FROM (
  SELECT scenario, checkpoint, alert_id, batch_no, first_batch, {_SEV} AS severity, alert_message AS message,
    CASE WHEN worst IS NULL THEN 'opened' ELSE 'changed' END AS event FROM chg
  UNION ALL SELECT e.scenario, e.checkpoint, e.alert_id, e.nb, e.first_batch, f.severity, f.message, 'closed' FROM epi e JOIN (
    SELECT scenario, checkpoint, root, segment, island, arg_max({_SEV}, batch_no * 1000 + check_seq) AS severity,
      arg_max(alert_message, batch_no * 1000 + check_seq) AS message FROM chg GROUP BY ALL) f
    ON f.scenario = e.scenario AND f.checkpoint = e.checkpoint AND f.root = e.root AND f.segment IS NOT DISTINCT FROM e.segment AND f.island = e.island
  WHERE e.nb <> -1) WHERE scenario = 'feed_stops_ios'""")

# --- faults ---
PAY_ONE = [PAY, i.scenario_frame("scen", "pay_raw", i.PAY_FAULTS, "transaction_id", PM, "amount_cents")]
WEB_ONE = WEB_SCEN[:2]
for _q, _s, _cols in (
        ("inj_unit_change", "unit_change_android", "duration_ms"), ("inj_feed_stops", "feed_stops_ios", "client_version"),
        ("inj_new_nullable", "new_nullable_web", "user_id"), ("inj_type_change", "type_change_android", "duration_ms, duration_ms_text, duration_ms_kind"),
        ("inj_gradual_drift", "gradual_drift_ios", "round(duration_ms, 4) AS duration_ms"), ("inj_text_change", "text_change_web", "error_message"),
        ("inj_volume_drop", "volume_drop_android", "client_version"), ("inj_clean", "clean", "duration_ms, user_id")):
    sql(_q, WEB_ONE, f"SELECT batch_no, line_no, {_cols} FROM scen WHERE scenario = '{_s}'")
sql("inj_invalid_enum", PAY_ONE, "SELECT batch_no, line_no, status FROM scen WHERE scenario = 'invalid_status_ach'")
sql("inj_scale", [WEB], "SELECT line_no, duration_ms * 1000 AS duration_ms FROM web_raw")
sql("inj_drop_column", [WEB], """SELECT batch_no, check_name, 'user_id' AS field, status, '''user_id'' is missing from this batch' AS message
  FROM (SELECT DISTINCT batch_no FROM web_raw), (VALUES ('schema:user_id', 'fail'), ('null_rate:user_id', 'error')) AS v(check_name, status)""")
_POS = "\npos AS (SELECT *, row_number() OVER (ORDER BY batch_no, line_no) - 1 AS p, count(*) OVER () AS total FROM web_raw)"
sql("inj_null_half", [WEB, _POS], "SELECT batch_no, line_no, CASE WHEN p % 2 = 1 THEN session_id END AS session_id FROM pos")
sql("inj_cut_80", [WEB, _POS], "SELECT batch_no, line_no FROM pos WHERE p < greatest(1, total // 5)")
sql("inj_duplicate_rows", [WEB, _POS], "SELECT batch_no, event_id, count(*) + 100 * count(*) FILTER (WHERE p = 0) AS copies FROM pos GROUP BY ALL")
sql("inj_cast_text", [WEB], "SELECT line_no, CAST(CAST(duration_ms AS BIGINT) AS VARCHAR) AS duration_ms FROM web_raw")
sql("scenario_catalog", WEB_ONE, """SELECT scenario, client_version, batch_no >= 4 AS after_onset, count(*) AS n_rows, count(user_id) AS users,
  count(error_message) AS messages, count(*) FILTER (WHERE duration_ms_kind = 'text') AS texts, round(sum(duration_ms) / 1000000, 4) AS mega_ms FROM scen GROUP BY ALL""")

# --- scoring ---
TRUTH = "\n" + i.truth(i.WEB_FAULTS)
sql("score_match", GUARDED + [TRUTH, c.score_ctes().format(base="truth")], "SELECT scenario, alert_id, first_batch, injection_id, is_match FROM matched")
sql("score_scenario", GUARDED + [TRUTH, c.score_ctes().format(base="truth")], "SELECT * FROM scored")
RUN2 = "system, scenario"


def systems(scen: list[str], base: list[str], results: list[str], faults: list[tuple], pipeline: str, number: str) -> list[str]:
    return scen + base + [
        f"\nresults AS ({union(results)})",
        f"\ncrashed AS (SELECT DISTINCT scenario, batch_no FROM scen WHERE {number}_kind = 'text')",
        c.guarded("results", "crashed"),
        f"\nrecorded AS (SELECT 'ours' AS system, * FROM kept UNION ALL BY NAME SELECT 'B1' AS system, * FROM results WHERE cp_order = 1 AND check_name = 'schema:{number}')",
        c.alert_ctes("recorded", pipeline, RUN2), "\n" + i.truth(faults),
        "\nbase AS (SELECT * FROM truth, (VALUES ('B0'), ('B1'), ('ours')) AS s(system))", c.score_ctes(RUN2).format(base="base")]


WEB_SYS = systems(WEB_SCEN, WEB_BASE, WEB_RESULTS, i.WEB_FAULTS, "web_analytics", "duration_ms")
BEH_SYS = systems(BEH_SCEN, BEH_BASE, BEH_RESULTS, i.BEHAVIOR_FAULTS, "user_behavior", "duration_ms")
PAY_SYS = systems(PAY_SCEN, PAY_BASE, PAY_RESULTS, i.PAY_FAULTS, "payment_processing", "amount_cents")
SCORES = """SELECT system, CASE WHEN sum(true_positives + false_positives) > 0 THEN round(sum(true_positives) / sum(true_positives + false_positives), 6) ELSE 1 END AS precision,
  round(count(*) FILTER (WHERE fault_type <> 'clean' AND detected) / count(*) FILTER (WHERE fault_type <> 'clean'), 6) AS recall,
  round(avg(lag_batches) FILTER (WHERE fault_type <> 'clean'), 6) AS mean_lag_batches FROM scored GROUP BY system"""
sql("sink_eval_report", WEB_SYS + [f"\nsc AS ({SCORES})"], """SELECT system, scenario, fault_type, detected, lag_batches, true_positives, false_positives,
  precision, recall, mean_lag_batches FROM scored JOIN sc USING (system)""")
sql("score_system", WEB_SYS, SCORES)
sql("score_system_behavior", BEH_SYS, SCORES)
sql("score_system_payments", PAY_SYS, SCORES)
_CAUGHT = "CASE WHEN bool_or(detected) FILTER (WHERE system = '{0}') THEN 'caught' ELSE 'missed' END AS \"{0}\""
sql("score_matrix", WEB_SYS, f"SELECT scenario, {', '.join(_CAUGHT.format(s) for s in ('B0', 'B1', 'ours'))} FROM scored GROUP BY scenario")
sql("score_gate", WEB_SYS + [f"\nsc AS ({SCORES})"], """SELECT system, metric, value, bound, CASE WHEN metric = 'mean_lag_batches' THEN coalesce(value <= bound, true) ELSE value >= bound END AS passed
  FROM (SELECT system, 'precision' AS metric, precision AS value, CAST(0.9 AS DOUBLE) AS bound FROM sc UNION ALL SELECT system, 'recall', recall, 0.7 FROM sc
    UNION ALL SELECT system, 'mean_lag_batches', mean_lag_batches, 2.0 FROM sc) WHERE system = 'ours'""")
sql("score_by_check", GUARDED + [TRUTH], """SELECT p.scenario, p.check_name, h.lag IS NOT NULL AS caught, h.lag AS lag_batches,
    p.check_name IN (SELECT check_name FROM prob WHERE scenario = 'clean') AS false_positive_on_clean
  FROM (SELECT DISTINCT scenario, check_name FROM prob WHERE scenario <> 'clean') p LEFT JOIN (
    SELECT scenario, check_name, min(batch_no) - min(onset_batch) AS lag FROM prob JOIN truth USING (scenario)
    WHERE fault_type <> 'clean' AND (segment IS NULL OR segment = inj_segment) AND batch_no BETWEEN onset_batch AND onset_batch + 4 GROUP BY ALL) h
  ON h.scenario = p.scenario AND h.check_name = p.check_name""")
sql("score_first_crash", WEB_SCEN[:2] + [CRASHED], "SELECT scenario, min(batch_no) AS crashed_at_batch, CAST(sum(uncastable) AS BIGINT) AS uncastable FROM crashed GROUP BY scenario")

# --- lineage ---
SALES = """
sales AS (SELECT 'line_' || l_linenumber AS pipeline, 'part_' || l_partkey AS part, 'supp_' || l_suppkey AS supp, 'nation_' || n_nationkey AS nation,
    'region_' || n_regionkey AS region, 'stage_' || l_returnflag AS stage, l_linenumber AS line
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nodes AS (SELECT DISTINCT pipeline, unnest(['field:' || part, 'field:' || supp, 'field:' || nation, 'out:' || region, 'fn:' || stage, 'stage:' || stage]) AS id,
    unnest(['field', 'field', 'field', 'output', 'function', 'stage']) AS type, unnest([part, supp, nation, region, stage, stage]) AS label FROM sales),
edges AS (SELECT pipeline, unnest(['field:' || part, 'field:' || supp, 'field:' || nation, 'field:' || part, 'fn:' || stage]) AS source,
    unnest(['field:' || supp, 'field:' || nation, 'out:' || region, 'fn:' || stage, 'field:' || supp]) AS target,
    unnest(['derives', 'derives', 'produces', 'reads', 'writes']) AS type, 'sales' AS file, line FROM sales),
dlinks AS (SELECT DISTINCT pipeline, source, target FROM edges WHERE type IN ('derives', 'produces'))"""
WALK = """
reach AS (SELECT pipeline, source AS start, target AS node FROM dlinks
  UNION SELECT r.pipeline, r.start, l.target FROM reach r JOIN dlinks l ON l.pipeline = r.pipeline AND l.source = r.node)"""
sql("graph_dedup", [SALES], """SELECT pipeline, type, count(*) AS n FROM (SELECT DISTINCT pipeline, source, target, type, file, line FROM edges) GROUP BY ALL
  UNION ALL SELECT pipeline, type, count(DISTINCT id) FROM nodes GROUP BY ALL""")
sql("lineage_edges", [SALES], "SELECT pipeline, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM dlinks GROUP BY pipeline")
recursive("lineage_downstream", [SALES, WALK], """SELECT pipeline, start, count(*) AS nodes, count(*) FILTER (WHERE node LIKE 'out:%') AS outputs
  FROM reach WHERE start <> node GROUP BY ALL""")
recursive("lineage_upstream", [SALES, WALK], "SELECT pipeline, node AS start, count(*) AS nodes FROM reach WHERE start <> node GROUP BY ALL")
recursive("lineage_affected_outputs", [SALES, WALK], """SELECT DISTINCT pipeline, substr(start, 7) AS field, substr(node, 5) AS output FROM reach
  WHERE start LIKE 'field:part%' AND node LIKE 'out:%'""")
sql("lineage_unused_fields", [SALES, """
written AS (SELECT pipeline, target FROM edges WHERE type = 'writes'
  UNION SELECT p.pipeline, 'field:part_' || p_partkey FROM part, (SELECT DISTINCT 'line_' || l_linenumber AS pipeline FROM lineitem) p)"""],
    """SELECT pipeline, substr(target, 7) AS field FROM written w WHERE NOT EXISTS (
    SELECT 1 FROM edges u WHERE u.pipeline = w.pipeline AND u.source = w.target AND u.type IN ('reads', 'produces', 'derives'))""")
sql("lineage_stage_summary", [SALES, """
roles AS (
  SELECT DISTINCT pipeline, 'stage:' || stage AS stage, unnest(['reads', 'writes']) AS role, unnest([part, supp]) AS label FROM sales
  UNION SELECT d.pipeline, 'stage:' || w.stage, 'transforms', d.part || '->' || d.supp
  FROM (SELECT DISTINCT pipeline, part, supp FROM sales) d JOIN (SELECT DISTINCT pipeline, supp, stage FROM sales) w
    ON w.pipeline = d.pipeline AND w.supp = d.supp
  UNION SELECT s.pipeline, 'stage:' || s.stage, 'produces', r.region
  FROM (SELECT DISTINCT pipeline, stage FROM sales) s JOIN (SELECT DISTINCT pipeline, region FROM sales) r ON r.pipeline = s.pipeline)"""],
    "SELECT pipeline, stage, role, count(*) AS n, min(label) AS first_label, max(label) AS last_label FROM roles GROUP BY ALL")
OBS = """
observed AS (SELECT DISTINCT 'line_' || l_linenumber AS pipeline, unnest(['part_' || l_partkey, 'supp_' || l_suppkey, 'status_' || l_linestatus]) AS label
  FROM lineitem)"""
MERGED = OBS + """,
merged AS (SELECT coalesce(n.pipeline, o.pipeline) AS pipeline, coalesce(n.type, 'field') AS type, coalesce(n.id, 'field:' || o.label) AS id,
    CASE WHEN n.id IS NULL THEN 'runtime' WHEN o.label IS NULL THEN 'static' ELSE 'both' END AS origin
  FROM (SELECT * FROM nodes WHERE type IN ('field', 'output')) n FULL JOIN observed o ON o.pipeline = n.pipeline AND o.label = n.label)"""
sql("lineage_merge_origin", [SALES, MERGED], "SELECT pipeline, type, origin, count(*) AS n FROM merged GROUP BY ALL")
sql("lineage_merge_report", [SALES, MERGED, """
fe AS (SELECT e.pipeline, count(*) AS field_edges, count(*) FILTER (WHERE a.origin = 'both' AND b.origin = 'both') AS confirmed_field_edges
  FROM (SELECT DISTINCT pipeline, source, target, line FROM edges WHERE type = 'derives') e
  JOIN merged a ON a.pipeline = e.pipeline AND a.id = e.source JOIN merged b ON b.pipeline = e.pipeline AND b.id = e.target GROUP BY ALL)"""],
    """SELECT m.*, coalesce(field_edges, 0) AS field_edges, coalesce(confirmed_field_edges, 0) AS confirmed_field_edges,
    round(confirmed_fields / static_fields, 6) AS field_agreement, round(coalesce(confirmed_field_edges / field_edges, 0), 6) AS edge_agreement
  FROM (SELECT pipeline, count(*) FILTER (WHERE origin <> 'runtime') AS static_fields, count(*) FILTER (WHERE origin = 'both') AS confirmed_fields,
    count(*) FILTER (WHERE origin = 'runtime') AS runtime_only_fields FROM merged WHERE type = 'field' GROUP BY pipeline) m LEFT JOIN fe USING (pipeline)""")

# --- profile, equivalence, reports ---
_CHAIN = [WEB, i.web_clean("cl", "web_raw"), i.web_enrich("en", "cl"), i.web_aggregate("ag", "en")]
_RAWC = ["batch_no", "line_no", "event_id", "event_ts", "user_id", "session_id", "platform", "client_version", "page", "action", "duration_ms",
         "error_message", "duration_ms_kind"]
_CLC = _RAWC + ["duration_s", "is_error", "is_timeout", "major_version"]
_ENC = _CLC + ["country", "date"]
_AGC = ["date", "platform", "country", "events", "active_users", "error_rate", "timeout_rate", "avg_duration_s", "p95_duration_s"]


def _profile() -> str:
    parts, before = [], None
    for order, (stage, table, cols) in enumerate((("ingest", "web_raw", _RAWC), ("clean", "cl", _CLC), ("enrich", "en", _ENC), ("aggregate", "ag", _AGC)), 1):
        rin = f"(SELECT count(*) FROM {prev})" if before else "CAST(NULL AS BIGINT)"
        for col in cols:
            change = "new" if before and col not in before else "kept"
            parts.append(f"SELECT {order} AS stage_order, '{stage}' AS stage, {rin} AS rows_in, count(*) AS rows_out, '{col}' AS \"column\", count(*) - count({col}) AS null_count, '{change}' AS change FROM {table}")
        for col in sorted(set(before or []) - set(cols)):
            parts.append(f"SELECT {order}, '{stage}', {rin}, count(*), '{col}', NULL, 'dropped' FROM {table}")
        before, prev = cols, table
    return " UNION ALL ".join(parts)


sql("profile_stage", _CHAIN, _profile())
_VALS = ["events", "active_users", "error_rate", "timeout_rate", "avg_duration_s", "p95_duration_s"]
_RND = "SELECT date, platform, country, events, active_users, " + ", ".join(f"round({v}, 9) AS {v}" for v in _VALS[2:])
_DIFF = ", ".join(f"CASE WHEN NOT coalesce(" + (f"abs(g.{v} - c.{v}) <= 1e-9 * abs(g.{v})" if v in _VALS[2:] else f"g.{v} = c.{v}") +
                  f", g.{v} IS NOT DISTINCT FROM c.{v}) THEN '{v}' END" for v in _VALS)
EQ = _CHAIN + ["\nrw AS (SELECT * REPLACE (event_id || '-' || line_no AS event_id) FROM web_raw)", i.web_clean("cl2", "rw"), i.web_enrich("en2", "cl2"),
               i.web_aggregate("ag2", "en2"), f"\ng AS ({_RND} FROM ag)", f"\nc AS ({_RND} FROM ag2)", f"""
eq AS (SELECT coalesce(g.date, c.date) AS date, coalesce(g.platform, c.platform) AS platform, coalesce(g.country, c.country) AS country,
    g.date IS NULL AS no_g, c.date IS NULL AS no_c, list_filter([{_DIFF}], lambda x: x IS NOT NULL) AS diff
  FROM g FULL JOIN c ON g.date = c.date AND g.platform = c.platform AND g.country = c.country),
eqr AS (SELECT date, platform, country, CASE WHEN no_c THEN 'missing' WHEN no_g THEN 'added' WHEN len(diff) = 0 THEN 'identical' ELSE 'changed' END AS verdict,
    CASE WHEN no_c OR no_g THEN '' ELSE array_to_string(diff, ',') END AS changed_columns FROM eq)"""]
sql("equivalence_diff", EQ, "SELECT * FROM eqr")
sql("equivalence_score", EQ, """SELECT count(*) AS rows, count(*) FILTER (WHERE verdict = 'identical') AS identical, count(*) FILTER (WHERE verdict = 'changed') AS changed,
  count(*) FILTER (WHERE verdict = 'missing') AS missing, count(*) FILTER (WHERE verdict = 'added') AS added,
  round(count(*) FILTER (WHERE verdict = 'identical') / count(*), 6) AS equivalence_score FROM eqr""")
sql("equivalence_set_difference", [WEB, "\na AS (SELECT client_version, page, count(*) AS n FROM web_raw GROUP BY ALL)",
    "\nb AS (SELECT client_version, page, count(*) AS n FROM web_raw WHERE user_id IS NOT NULL GROUP BY ALL)"],
    "SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
sql("rep_failed_last_run", OURS, """SELECT scenario AS pipeline, batch_no, checkpoint, check_name, segment, status FROM kept
  WHERE status IN ('fail', 'error') AND batch_no = (SELECT max(batch_no) FROM kept k WHERE k.scenario = kept.scenario)""")
sql("rep_alerts_by_field", GUARDED, """SELECT scenario AS pipeline, nullif(root_field, '') AS field_name, count(*) AS alert_count, count(*) FILTER (WHERE severity = 'high') AS high_severity
  FROM latest WHERE DATE '2024-01-01' + CAST((first_batch - 1) * 3 AS INTEGER) > DATE '2024-01-07' GROUP BY ALL""")


def _sub(ctes: list[str], select: str) -> str:
    return "(WITH " + ",".join(ctes) + "\n" + select + ")"


def _quality(sys: list[str], pipeline: str) -> str:
    return _sub(sys + [f"\nsc AS ({SCORES})"], f"""SELECT '{pipeline}' AS pipeline, k.*, a.*, sc.precision AS detection_precision, sc.recall AS detection_recall,
      sc.mean_lag_batches AS avg_detection_lag_batches, f.* FROM sc,
      (SELECT round(count(*) FILTER (WHERE false_positives > 0) / count(*), 6) AS false_positive_rate FROM scored WHERE system = 'ours') f,
      (SELECT count(*) AS total_checks_run, count(*) FILTER (WHERE status = 'pass') AS checks_passed, count(*) FILTER (WHERE status = 'fail') AS checks_failed,
        count(*) FILTER (WHERE status = 'warn') AS checks_warned FROM recorded WHERE system = 'ours') k,
      (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'high') AS high_severity_alerts FROM latest WHERE system = 'ours') a
      WHERE sc.system = 'ours'""")


SUMMARY = [reviewed(_BY_NAME), "\nquality AS (" + " UNION ALL ".join(
    f"SELECT * FROM {_quality(s, p)}" for s, p in ((WEB_SYS, "web_analytics"), (BEH_SYS, "user_behavior"), (PAY_SYS, "payment_processing"))) + ")", """
summary AS (SELECT g.*, q.* EXCLUDE (pipeline), CASE WHEN pipeline = 'web_analytics' THEN (SELECT equal FROM equality) END AS equivalence_score FROM (SELECT pipeline, count(*) AS total_guarantees, count(*) FILTER (WHERE status = 'confirmed') AS confirmed_guarantees,
    count(*) FILTER (WHERE status = 'rejected') AS rejected_guarantees, count(*) FILTER (WHERE status = 'pending') AS pending_guarantees
  FROM reviewed GROUP BY pipeline) g JOIN quality q USING (pipeline))"""]
SUMMARY.insert(2, "\nequality AS " + _sub(EQ, "SELECT round(count(*) FILTER (WHERE verdict = 'identical') / count(*), 6) AS equal FROM eqr"))
sql("rep_pipeline_summary", SUMMARY, "SELECT * FROM summary")
sql("rep_scorecard", SUMMARY, f"""SELECT p.pipeline, confirmed_guarantees, total_alerts, high_severity_alerts, detection_precision, detection_recall, avg_detection_lag_batches,
  false_positive_rate, equivalence_score FROM (SELECT DISTINCT source AS pipeline FROM documents UNION SELECT DISTINCT {_BY_NAME} FROM documents) p LEFT JOIN summary USING (pipeline)""")
