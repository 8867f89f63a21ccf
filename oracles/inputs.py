"""SQL text of the telemetry views, stages, baselines and scenario frames (DuckDB dialect)."""

from __future__ import annotations

BASELINE = "(1, 2, 3)"

WEB_RAW = """
w_src AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events),
web_one AS (
  SELECT CAST(1 + day // 3 AS INTEGER) AS batch_no, event_id AS line_no, 'e' || event_id AS event_id,
    ts AS event_ts, CASE WHEN event_id % 50 <> 0 THEN 'u' || user_id END AS user_id,
    'session_' || lpad(CAST(user_id % 8 + 1 AS VARCHAR), 3, '0') AS session_id,
    (['web', 'ios', 'android'])[user_id % 3 + 1] AS platform,
    (['1.4.0', '1.5.2', '6.0.1', '6.1.0', '5.1.3', '5.2.0'])[(user_id % 3) * 2 + event_id % 2 + 1] AS client_version,
    (['home', 'search', 'checkout', 'profile'])[k % 4 + 1] AS page,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'scroll' ELSE 'page_view' END AS action,
    round(value * CAST(1000 AS DOUBLE)) AS duration_ms,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'Timeout while loading page ' || k
         ELSE 'invalid response ' || k END END AS error_message,
    'number' AS duration_ms_kind, event_id % 50 = 1 AS resent FROM w_src),
web_raw AS (
  SELECT * EXCLUDE (resent) FROM web_one
  UNION ALL BY NAME
  SELECT * EXCLUDE (resent) REPLACE (line_no + 1000000000000 AS line_no, duration_ms + 7 AS duration_ms)
  FROM web_one WHERE resent)"""

PAY_RAW = """
p_one AS (
  SELECT CAST(1 + ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) // 8 AS INTEGER) AS batch_no,
    o_orderkey AS line_no, 't' || o_orderkey AS transaction_id,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000
      + (o_orderkey % 86400) * 1000 AS event_ts,
    CASE r_name WHEN 'AMERICA' THEN 'MER_US_01' WHEN 'EUROPE' THEN 'MER_EU_01' WHEN 'ASIA' THEN 'MER_APAC_01'
      ELSE 'MER_OTHER_01' END AS merchant_id,
    CASE WHEN o_orderkey % 50 <> 0 THEN 'c' || o_custkey END AS user_id,
    round(o_totalprice * CAST(100 AS DOUBLE)) AS amount_cents, 'USD' AS currency,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' WHEN o_orderpriority = '5-LOW' THEN 'wallet'
      ELSE 'ach' END AS payment_method,
    CASE WHEN o_orderkey % 97 = 0 THEN 'reversed' WHEN o_orderstatus = 'O' THEN 'declined'
      WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'refunded' ELSE 'settled' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'card declined by issuer'
      WHEN 1 THEN 'Insufficient funds ERROR ' || (o_custkey % 9) END AS error_message,
    CASE WHEN o_custkey % 10 = 0 THEN 'beta' ELSE '5.2.0' END AS client_version,
    'number' AS amount_cents_kind, o_orderkey % 50 = 1 AS resent
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey),
pay_raw AS (
  SELECT * EXCLUDE (resent) FROM p_one
  UNION ALL BY NAME
  SELECT * EXCLUDE (resent) REPLACE (line_no + 1000000000000 AS line_no, event_ts + 1000 AS event_ts,
    amount_cents + 1 AS amount_cents) FROM p_one WHERE resent)"""

MSG_RAW = """
msg AS (
  SELECT CAST(substr(source, 4) AS INTEGER) + 1 AS batch_no, doc_id AS line_no, CAST(doc_id AS VARCHAR) AS event_id,
    lang, text FROM documents)"""


def first_rows(table: str, key: str, order: str = "batch_no, line_no") -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


def web_clean(name: str, table: str, by: str = "") -> str:
    return f"""
{name} AS (
  SELECT *, duration_ms / CAST(1000 AS DOUBLE) AS duration_s, error_message IS NOT NULL AS is_error,
    coalesce(error_message ILIKE '%timeout%', false) AS is_timeout, split_part(client_version, '.', 1) AS major_version
  FROM {first_rows(table, by + 'event_id')}
  WHERE user_id IS NOT NULL AND duration_ms / CAST(1000 AS DOUBLE) < 300)"""


def web_enrich(name: str, table: str) -> str:
    return f"""
{name} AS (
  SELECT *, CASE session_id WHEN 'session_001' THEN 'US' WHEN 'session_002' THEN 'GB' WHEN 'session_003' THEN 'DE'
      WHEN 'session_004' THEN 'IN' WHEN 'session_005' THEN 'SG' ELSE 'Other' END AS country,
    CAST(event_ts AS DATE) AS date FROM {table})"""


def web_aggregate(name: str, table: str, by: str = "") -> str:
    return f"""
{name} AS (
  SELECT {by} date, platform, country, count(event_id) AS events, count(DISTINCT user_id) AS active_users,
    avg(CAST(is_error AS DOUBLE)) AS error_rate, avg(CAST(is_timeout AS DOUBLE)) AS timeout_rate,
    avg(duration_s) AS avg_duration_s, quantile_cont(duration_s, 0.95) AS p95_duration_s
  FROM {table} WHERE action = 'page_view' AND date IS NOT NULL AND platform IS NOT NULL AND country IS NOT NULL
  GROUP BY {by} date, platform, country)"""


def sessions(name: str, table: str) -> str:
    return f"""
{name} AS (
  SELECT *, duration_ms / CAST(1000 AS DOUBLE) AS session_duration_s, split_part(client_version, '.', 1) AS major_version
  FROM {table} WHERE user_id IS NOT NULL AND action = 'page_view' AND duration_ms / CAST(1000 AS DOUBLE) < 3600)"""


def behavior(name: str, table: str, by: str = "") -> str:
    return f"""
{name} AS (
  SELECT *, session_count * platforms_used AS engagement_score FROM (
    SELECT {by} user_id, count(DISTINCT session_id) AS session_count, count(DISTINCT platform) AS platforms_used,
      avg(session_duration_s) AS avg_session_duration_s, count(event_id) AS events
    FROM {table} GROUP BY {by} user_id))"""


def pay_clean(name: str, table: str, by: str = "") -> str:
    return f"""
{name} AS (
  SELECT *, amount_cents / CAST(100 AS DOUBLE) AS amount_usd, coalesce(error_message ILIKE '%error%', false) AS is_error
  FROM {first_rows(table, by + 'transaction_id')}
  WHERE user_id IS NOT NULL AND amount_cents > 0 AND amount_cents < 99999999
    AND status IN ('settled', 'declined', 'pending', 'refunded'))"""


def pay_clean_sql(name: str, table: str) -> str:
    return f"""
{name}_user AS (SELECT * FROM {table} WHERE user_id IS NOT NULL),
{name} AS (
  SELECT *, amount_cents / CAST(100 AS DOUBLE) AS amount_usd, coalesce(error_message ILIKE '%error%', false) AS is_error,
    CASE WHEN strpos(client_version, '.') = 0 THEN '' ELSE substr(client_version, 1, strpos(client_version, '.') - 1) END
      AS major_version
  FROM {first_rows(name + '_user', 'transaction_id', 'event_ts, batch_no, line_no')}
  WHERE amount_cents > 0 AND amount_cents < 99999999)"""


def pay_enrich(name: str, table: str, unit: str = "ns") -> str:
    day = "event_ts // 86400000000000" if unit == "ns" else "event_ts // 86400000"
    return f"""
{name} AS (
  SELECT *, DATE '1970-01-01' + CAST({day} AS INTEGER) AS transaction_date,
    CASE WHEN starts_with(merchant_id, 'MER_US') THEN 'North America' WHEN starts_with(merchant_id, 'MER_EU') THEN 'Europe'
      WHEN starts_with(merchant_id, 'MER_APAC') THEN 'Asia Pacific' ELSE 'Other' END AS merchant_region FROM {table})"""


def reconcile(name: str, table: str, by: str = "") -> str:
    return f"""
{name} AS (
  SELECT {by} transaction_date, merchant_region, payment_method, count(transaction_id) AS transaction_count,
    count(DISTINCT user_id) AS unique_users, sum(amount_usd) AS total_volume_usd, avg(amount_usd) AS avg_transaction_usd,
    avg(CAST(is_error AS DOUBLE)) AS error_rate, avg(CASE WHEN status = 'declined' THEN 1.0 ELSE 0.0 END) AS decline_rate
  FROM {table} WHERE payment_method IS NOT NULL GROUP BY {by} transaction_date, merchant_region, payment_method)"""


def h32(seed: str, row_id: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {row_id}), 1, 8) AS BIGINT)"


def _chance(kind: str, row_id: str, rate: float) -> str:
    return f"{h32('123-' + kind, row_id)} / CAST(4294967296 AS DOUBLE) < {rate}"


NEW_TEMPLATES = "(['upstream dependency unavailable', 'rate limit exceeded, retry later', 'database connection pool exhausted'])"


def scenario_frame(name: str, table: str, faults: list[tuple], row_id: str, seg: str, number: str) -> str:
    """`faults`: (scenario, kind, segment, field, rate/factor/value) applied from batch 4 on."""
    drop, sets = [], {}
    for scenario, kind, segment, field, arg in faults:
        me = f"scenario = '{scenario}' AND batch_no >= 4 AND {seg} = '{segment}'"
        if kind == "feed_stops":
            drop.append(f"({me})")
        elif kind == "volume_drop":
            drop.append(f"({me} AND {_chance(kind, row_id, arg)})")
        elif kind == "unit_change":
            sets.setdefault(field, []).append((me, f"{field} / CAST({arg} AS DOUBLE)"))
        elif kind == "new_nullable":
            sets.setdefault(field, []).append((f"{me} AND {_chance(kind, row_id, arg)}", "NULL"))
        elif kind == "gradual_drift":
            sets.setdefault(field, []).append((me, f"{field} * pow(CAST(1.08 AS DOUBLE), batch_no - 4 + 1)"))
        elif kind == "text_change":
            pick = f"{NEW_TEMPLATES}[{h32('123-template', row_id)} % 3 + 1]"
            sets.setdefault(field, []).append((f"{me} AND {field} IS NOT NULL AND {_chance(kind, row_id, arg)}", pick))
        elif kind == "invalid_enum":
            sets.setdefault(field, []).append((me, f"'{arg}'"))
        elif kind == "type_change":
            sets.setdefault(field, []).append((me, "NULL"))
            sets.setdefault(f"{field}_kind", []).append((me, "'text'"))
            sets.setdefault(f"{field}_text", []).append((me, f"CAST(CAST({field} AS BIGINT) AS VARCHAR) || '{arg}'"))
    names = ", ".join(f"('{f[0]}')" for f in faults)
    has_text = any(f[1] == "type_change" for f in faults)
    src = f"(SELECT *, CAST(NULL AS VARCHAR) AS {number}_text FROM {table})" if has_text else table
    replace = ", ".join(f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in cases)} ELSE {col} END AS {col}"
                        for col, cases in sets.items())
    where = f"WHERE NOT coalesce({' OR '.join(drop)}, false)" if drop else ""
    star = f"* REPLACE ({replace})" if replace else "*"
    return f"\n{name} AS (SELECT {star} FROM {src}, (VALUES {names}) AS s(scenario) {where})"


WEB_FAULTS = [
    ("unit_change_android", "unit_change", "5.2.0", "duration_ms", 1000),
    ("feed_stops_ios", "feed_stops", "6.1.0", None, None),
    ("new_nullable_web", "new_nullable", "1.5.2", "user_id", 0.3),
    ("type_change_android", "type_change", "5.1.3", "duration_ms", "ms"),
    ("gradual_drift_ios", "gradual_drift", "6.0.1", "duration_ms", 0.08),
    ("text_change_web", "text_change", "1.4.0", "error_message", 0.6),
    ("volume_drop_android", "volume_drop", "5.2.0", None, 0.6),
    ("clean", "clean", None, None, None),
]
BEHAVIOR_FAULTS = [
    WEB_FAULTS[0], WEB_FAULTS[2], WEB_FAULTS[3],
    ("action_flood_ios", "volume_drop", "6.1.0", None, 0.7),
    ("feed_stops_ios", "feed_stops", "6.0.1", None, None),
    WEB_FAULTS[7],
]
PAY_FAULTS = [
    ("unit_change_card", "unit_change", "card", "amount_cents", 100),
    ("type_change_card", "type_change", "card", "amount_cents", ""),
    ("new_nullable_wallet", "new_nullable", "wallet", "user_id", 0.3),
    ("invalid_status_ach", "invalid_enum", "ach", "status", "chargeback"),
    ("volume_drop_card", "volume_drop", "card", None, 0.65),
    ("feed_stops_wallet", "feed_stops", "wallet", None, None),
    ("clean", "clean", None, None, None),
]
FAULT_TYPE = {"invalid_enum": "type_change"}


def truth(faults: list[tuple], pipeline: str = "", n_batches: int = 10) -> str:
    rows = []
    for s, kind, seg, field, _ in faults:
        q = lambda v: f"'{v}'" if v is not None else "CAST(NULL AS VARCHAR)"
        iid = "clean" if kind == "clean" else (f"invalid_enum:{field}:{seg}:4" if kind == "invalid_enum" else f"{kind}:{seg}:4")
        onset = n_batches + 1 if kind == "clean" else 4
        rows.append(f"('{s}', '{iid}', '{FAULT_TYPE.get(kind, kind)}', {q(field)}, {q(seg)}, {onset})")
    return f"truth AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(scenario, injection_id, fault_type, field, inj_segment, onset_batch))"


def numeric_baseline(table: str, field: str, seg: str, row_id: str, p: str = "bn", limit: int | None = None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY seg ORDER BY {h32('42', 'id')}, id, x) <= {limit}" if limit else ""
    qs = ", ".join(f"{i / 10}" for i in range(11))
    return f"""
{p}_v AS (SELECT coalesce(CAST({seg} AS VARCHAR), 'nan') AS seg, CAST({row_id} AS VARCHAR) AS id, CAST({field} AS DOUBLE) AS x FROM {table}),
{p}_stats AS (
  SELECT seg, count(x) AS sample_count, coalesce(avg(x), 0) AS mean, coalesce(median(x), 0) AS median,
    coalesce(stddev_samp(x), 0) AS std FROM {p}_v GROUP BY seg),
{p}_sample AS (
  SELECT seg, x FROM {p}_v WHERE x IS NOT NULL {cut}),
{p}_q AS (SELECT seg, quantile_cont(x, [{qs}]) AS q FROM {p}_sample GROUP BY seg),
{p}_edges AS (SELECT seg, list_sort(list_distinct(list_transform(q, lambda e: round(e, 9)))) AS edges FROM {p}_q),
{p}_bins AS (
  SELECT s.seg, len(list_filter(edges[2:len(edges) - 1], lambda e: e <= x)) AS bin, count(*) AS n
  FROM {p}_sample s JOIN {p}_edges USING (seg) GROUP BY ALL),
{p}_share AS (SELECT seg, bin, n / sum(n) OVER (PARTITION BY seg) AS share FROM {p}_bins)"""


def text_baseline(table: str, field: str, seg: str, p: str = "bt") -> str:
    return f"""
{p}_v AS (SELECT coalesce(CAST({seg} AS VARCHAR), 'nan') AS seg, {field} AS t FROM {table}),
{p}_count AS (SELECT seg, count(t) AS sample_count FROM {p}_v GROUP BY seg),
{p}_vocab AS (SELECT DISTINCT seg, lower(unnest(regexp_extract_all(t, '[A-Za-z]+'))) AS token FROM {p}_v),
{p}_templates AS (
  SELECT seg, regexp_replace(t, '\\p{{Nd}}+', '<NUM>', 'g') AS template, count(*) AS n FROM {p}_v WHERE t IS NOT NULL GROUP BY ALL)"""


def volume_baseline(table: str, seg: str, p: str = "bv") -> str:
    return f"""
{p}_n AS (SELECT CAST({seg} AS VARCHAR) AS seg, batch_no, count(*) AS n FROM {table} WHERE {seg} IS NOT NULL GROUP BY ALL),
{p}_grid AS (
  SELECT f.seg, b.batch_no, coalesce(n, 0) AS n FROM (SELECT seg, min(batch_no) AS f FROM {p}_n GROUP BY seg) f
  JOIN (SELECT unnest([1, 2, 3]) AS batch_no) b ON b.batch_no >= f.f
  LEFT JOIN {p}_n ON {p}_n.seg = f.seg AND {p}_n.batch_no = b.batch_no),
{p} AS (SELECT seg, list(n ORDER BY batch_no) AS batch_counts, median(n) AS usual FROM {p}_grid GROUP BY seg)"""
