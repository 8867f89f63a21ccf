"""SQL text of every check, producing one common result shape."""

from __future__ import annotations

RUN = "scenario, batch_no"


def row(cp: str, order: int, seq: int, name: str, ctype: str, field: str | None, seg: str, status: str, message: str,
        metric: str, n: str, source: str) -> str:
    f = f"'{field}'" if field else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {RUN}, '{cp}' AS checkpoint, {order} AS cp_order, {seq} AS check_seq, '{name}' AS check_name,
  '{ctype}' AS check_type, {f} AS field, {seg} AS segment, {status} AS status, {message} AS message,
  CAST({metric} AS DOUBLE) AS metric, CAST({n} AS BIGINT) AS n_rows FROM {source}"""


NOSEG = "CAST(NULL AS VARCHAR)"


def seg_of(col: str | None) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'nan')" if col else "'all'"


def few(n: str, ok: str, bad: str, text: str, what: str = "rows", base: str | None = None) -> tuple[str, str]:
    none = f"WHEN {base} IS NULL THEN" if base else None
    st = "CASE " + (f"{none} 'insufficient_data' " if none else "") + \
        f"WHEN {n} < 30 THEN 'insufficient_data' WHEN {ok} THEN 'pass' ELSE '{bad}' END"
    ms = "CASE " + (f"{none} 'no baseline for this field/segment yet' " if none else "") + \
        f"WHEN {n} < 30 THEN 'only ' || {n} || ' {what}, below the minimum of 30' WHEN {ok} THEN '' ELSE {text} END"
    return st, ms


def pct(x: str, d: int = 1) -> str:
    return f"printf('%.{d}f%%', ({x}) * 100)"


def null_rate(t, cp, o, seq, field, seg, limit, kind=None):
    miss = f"{field} IS NULL" + (f" AND coalesce({kind}, '') <> 'text'" if kind else "")
    src = f"(SELECT {RUN}, {seg_of(seg)} AS seg, count(*) AS n, count(*) FILTER (WHERE {miss}) / count(*) AS r FROM {t} GROUP BY ALL)"
    st, ms = few("n", f"r <= CAST({limit} AS DOUBLE)", "fail", f"'null rate ' || {pct('r')} || ' exceeds the {limit:.1%} limit'")
    return row(cp, o, seq, f"null_rate:{field}", "nulls", field, "seg" if seg else NOSEG, st, ms, "CASE WHEN n >= 30 THEN r END", "n", src)


def in_range(t, cp, o, seq, field, seg, lo, hi, limit=0.0, kind=None):
    bad = " OR ".join([f"{field} < CAST({lo} AS DOUBLE)"] * (lo is not None) + [f"{field} > CAST({hi} AS DOUBLE)"] * (hi is not None))
    textual = f"sum(count(*) FILTER (WHERE {kind} = 'text')) OVER (PARTITION BY {RUN})" if kind else "0"
    src = f"""(SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n,
      count(*) FILTER (WHERE {bad}) / nullif(count({field}), 0) AS r, {textual} AS textual FROM {t} GROUP BY {RUN}, seg)"""
    st, ms = few("n", f"r <= {limit}", "fail", f"{pct('r')} || ' of values fall outside [{lo}, {hi}]'", "non-null rows")
    out = row(cp, o, seq, f"range:{field}", "range", field, "seg" if seg else NOSEG, st, ms, "CASE WHEN n >= 30 THEN r END", "n",
              f"{src} WHERE textual = 0")
    if kind:
        msg = "'check cannot run: ' || k || ' values are no numbers'"
        out += "\nUNION ALL\n" + row(cp, o, seq, f"range:{field}", "range", None, NOSEG, "'error'", msg, "NULL", "NULL",
                                     f"(SELECT {RUN}, count(*) AS k FROM {t} WHERE {kind} = 'text' GROUP BY ALL)")
    return out


def volume(t, cp, o, seq, lo, hi=None):
    ok = " AND ".join(([f"n >= {lo}"] if lo is not None else []) + ([f"n <= {hi}"] if hi is not None else []))
    return row(cp, o, seq, "volume", "volume", None, NOSEG, f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END",
               f"CASE WHEN {ok} THEN '' ELSE n || ' rows, expected between {lo} and {hi}' END", "n", "n",
               f"(SELECT {RUN}, count(*) AS n FROM {t} GROUP BY ALL)")


def schema(t, cp, o, seq, field, dtype, kind=None):
    if kind:
        actual = f"""CASE WHEN count(*) FILTER (WHERE {kind} = 'text') > 0 OR count({field}) = 0 THEN 'object'
          WHEN count(*) FILTER (WHERE {field} <> floor({field})) > 0 OR count({field}) < count(*) THEN 'float64' ELSE 'int64' END"""
    else:
        actual = "'object'"
    ok = "(a LIKE 'int%' OR a LIKE 'float%')" if dtype == "numeric" else f"a LIKE '{dtype}%'"
    return row(cp, o, seq, f"schema:{field}", "schema", field, NOSEG, f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END",
               f"CASE WHEN {ok} THEN '' ELSE '''{field}'' is ' || a || ', expected {dtype}' END", "NULL", "n",
               f"(SELECT {RUN}, count(*) AS n, {actual} AS a FROM {t} GROUP BY {RUN})")


def key_set(t, cp, o, seq, field, allowed):
    odd = f"{field} IS NOT NULL AND {field} NOT IN ({', '.join(repr(a) for a in allowed)})"
    src = f"""(SELECT {RUN}, count(*) AS n, count(*) FILTER (WHERE {odd}) AS bad,
      array_to_string(list_sort(list(DISTINCT {field}) FILTER (WHERE {odd}))[1:5], ', ') AS shown FROM {t} GROUP BY ALL)"""
    return row(cp, o, seq, f"key_set:{field}", "schema", field, NOSEG, "CASE WHEN bad = 0 THEN 'pass' ELSE 'warn' END",
               "CASE WHEN bad = 0 THEN '' ELSE 'unexpected values: ' || shown END", "bad", "n", src)


def cardinality(t, cp, o, seq, field, limit):
    return row(cp, o, seq, f"cardinality:{field}", "schema", field, NOSEG,
               f"CASE WHEN d <= {limit} THEN 'pass' ELSE 'fail' END",
               f"CASE WHEN d <= {limit} THEN '' ELSE d || ' distinct values, expected at most {limit}' END", "d", "NULL",
               f"(SELECT {RUN}, count(DISTINCT {field}) AS d FROM {t} GROUP BY ALL)")


def unit(t, cp, o, seq, field, seg, limit=0.3, p="bn"):
    src = f"""(SELECT c.*, b.sample_count AS bc, CASE WHEN cur <= 0 OR b.median <= 0 THEN
        CASE WHEN cur <> b.median THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE log10(cur / b.median) END AS lr
      FROM (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n, median({field}) AS cur FROM {t} GROUP BY ALL) c
      LEFT JOIN {p}_stats b USING (seg))"""
    text = """'median moved by a factor of ' || CASE WHEN isinf(lr) THEN 'inf' ELSE printf('%.1f', pow(10, lr)) END
      || 'x versus baseline: looks like a unit change, not ordinary drift'"""
    st, ms = few("n", f"abs(lr) <= {limit}", "fail", text, base="bc")
    return row(cp, o, seq, f"unit:{field}", "unit", field, "seg", st, ms,
               "CASE WHEN bc IS NOT NULL AND n >= 30 AND NOT isinf(lr) THEN lr END", "n", src)


def segment_volume(t, cp, o, seq, seg, limit=0.5, p="bv"):
    src = f"""(SELECT b.scenario, b.batch_no, k.seg, k.usual, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / k.usual AS s
      FROM (SELECT DISTINCT {RUN} FROM {t}) b, (SELECT * FROM {p} WHERE usual > 0) k
      LEFT JOIN (SELECT {RUN}, {seg_of(seg)} AS seg, count(*) AS n FROM {t} GROUP BY ALL) c
        ON c.scenario = b.scenario AND c.batch_no = b.batch_no AND c.seg = k.seg)"""
    return row(cp, o, seq, "segment_volume", "volume", None, "seg", f"CASE WHEN s >= {limit} THEN 'pass' ELSE 'fail' END",
               f"""CASE WHEN s >= {limit} THEN '' WHEN n = 0 THEN '''' || seg || ''' silent this batch'
               ELSE '''' || seg || ''' volume is ' || {pct('s', 0)} || ' of its usual ' || printf('%.0f', usual) || ' rows' END""",
               "s", "n", src)


def psi(t, cp, o, seq, field, seg, limit=0.10, p="bn"):
    src = f"""(SELECT g.*, bc.sample_count AS bc, CASE WHEN len(e.edges) < 3 THEN 0 ELSE v.psi END AS psi FROM
      (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n FROM {t} GROUP BY ALL) g
      LEFT JOIN {p}_stats bc USING (seg) LEFT JOIN {p}_edges e USING (seg)
      LEFT JOIN (SELECT scenario, batch_no, seg, sum((cs - rs) * ln(cs / rs)) AS psi FROM (
        SELECT g2.scenario, g2.batch_no, r.seg, r.share + 1e-6 AS rs, coalesce(c.n, 0) / g2.total + 1e-6 AS cs
        FROM (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS total FROM {t} GROUP BY ALL) g2
        JOIN {p}_share r ON r.seg = g2.seg
        LEFT JOIN (SELECT {RUN}, seg, len(list_filter(edges[2:len(edges) - 1], lambda e: e <= x)) AS bin, count(*) AS n
                   FROM (SELECT {RUN}, {seg_of(seg)} AS seg, {field} AS x FROM {t} WHERE {field} IS NOT NULL) JOIN {p}_edges USING (seg)
                   GROUP BY ALL) c
          ON c.scenario = g2.scenario AND c.batch_no = g2.batch_no AND c.seg = g2.seg AND c.bin = r.bin
        WHERE g2.total > 0) GROUP BY ALL) v USING (scenario, batch_no, seg))"""
    st, ms = few("n", f"psi <= {limit}", "fail",
                 "'PSI score ' || printf('%.3f', psi) || ' indicates the distribution has drifted from baseline'", base="bc")
    return row(cp, o, seq, f"psi:{field}", "numeric_drift", field, "seg", st, ms, "CASE WHEN bc IS NOT NULL AND n >= 30 THEN psi END", "n", src)


def ks(t, cp, o, seq, field, seg, alpha=0.01, p="bn"):
    src = f"""(SELECT g.*, b.sample_count AS bc, k.d, k.pv FROM
      (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n FROM {t} GROUP BY ALL) g
      LEFT JOIN {p}_stats b USING (seg)
      LEFT JOIN (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
            lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam))))) END AS pv
        FROM (SELECT *, (sqrt(rn * cn / (rn + cn)) + 0.12 + 0.11 / sqrt(rn * cn / (rn + cn))) * d AS lam FROM (
          SELECT scenario, batch_no, seg, max(abs(rc / rn - cc / cn)) AS d, max(rn) AS rn, max(cn) AS cn FROM (
            SELECT scenario, batch_no, seg, x, sum(sum(c)) OVER w AS cc, sum(sum(r)) OVER w AS rc,
              sum(sum(c)) OVER g AS cn, sum(sum(r)) OVER g AS rn
            FROM (SELECT {RUN}, {seg_of(seg)} AS seg, CAST({field} AS DOUBLE) AS x, 1 AS c, 0 AS r FROM {t} WHERE {field} IS NOT NULL
                  UNION ALL SELECT a.scenario, a.batch_no, a.seg, s.x, 0, 1
                  FROM (SELECT DISTINCT {RUN}, {seg_of(seg)} AS seg FROM {t} WHERE {field} IS NOT NULL) a JOIN {p}_sample s USING (seg))
            GROUP BY scenario, batch_no, seg, x
            WINDOW w AS (PARTITION BY scenario, batch_no, seg ORDER BY x), g AS (PARTITION BY scenario, batch_no, seg))
          WHERE rn > 0 GROUP BY ALL))) k USING (scenario, batch_no, seg))"""
    st, ms = few("n", f"NOT (pv < {alpha} AND d >= 0.1)", "fail",
                 "'KS score ' || printf('%.3f', d) || ' indicates the distribution has drifted from baseline'", base="bc")
    return row(cp, o, seq, f"ks:{field}", "numeric_drift", field, "seg", st, ms, "CASE WHEN bc IS NOT NULL AND n >= 30 THEN d END", "n", src)


def oov(t, cp, o, seq, field, seg, limit, p="bt"):
    src = f"""(SELECT g.*, b.sample_count AS bc, coalesce(k.r, 0) AS r FROM
      (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n FROM {t} GROUP BY ALL) g LEFT JOIN {p}_count b USING (seg)
      LEFT JOIN (SELECT {RUN}, w.seg, count(*) FILTER (WHERE v.token IS NULL) / count(*) AS r
        FROM (SELECT {RUN}, {seg_of(seg)} AS seg, lower(unnest(regexp_extract_all({field}, '[A-Za-z]+'))) AS token FROM {t}) w
        LEFT JOIN {p}_vocab v ON v.seg = w.seg AND v.token = w.token GROUP BY ALL) k USING (scenario, batch_no, seg))"""
    st, ms = few("n", f"r <= {limit}", "fail", f"{pct('r')} || ' of words are new versus the baseline vocabulary'", base="bc")
    return row(cp, o, seq, f"oov_rate:{field}", "text_drift", field, "seg", st, ms, "CASE WHEN bc IS NOT NULL AND n >= 30 THEN r END", "n", src)


def template(t, cp, o, seq, field, seg, limit, p="bt"):
    src = f"""(SELECT g.*, b.sample_count AS bc, coalesce(k.f, 0) / nullif(g.n, 0) AS r, k.shown FROM
      (SELECT {RUN}, {seg_of(seg)} AS seg, count({field}) AS n FROM {t} GROUP BY ALL) g LEFT JOIN {p}_count b USING (seg)
      LEFT JOIN (SELECT {RUN}, w.seg, count(*) AS f, array_to_string(list_sort(list(DISTINCT w.template))[1:3], ''', ''') AS shown
        FROM (SELECT {RUN}, {seg_of(seg)} AS seg, regexp_replace({field}, '\\p{{Nd}}+', '<NUM>', 'g') AS template
              FROM {t} WHERE {field} IS NOT NULL) w
        ANTI JOIN {p}_templates v ON v.seg = w.seg AND v.template = w.template GROUP BY ALL) k USING (scenario, batch_no, seg))"""
    st, ms = few("n", f"r <= {limit}", "warn",
                 f"{pct('r')} || ' of records match a template never seen in the baseline, e.g. [''' || shown || ''']'", base="bc")
    return row(cp, o, seq, f"template_drift:{field}", "text_drift", field, "seg", st, ms, "CASE WHEN bc IS NOT NULL AND n >= 30 THEN r END", "n", src)


# --- guard, alerts, scores over a `results` CTE ---

def guarded(results: str, crashed: str, out: str = "kept") -> str:
    return f"""
stops AS (
  SELECT scenario, batch_no, least(coalesce(b, 99), coalesce(c, 99)) AS stop_at FROM
    (SELECT {RUN}, min(cp_order) FILTER (WHERE status = 'fail') AS b FROM {results} GROUP BY ALL)
    LEFT JOIN (SELECT {RUN}, 1 AS c FROM {crashed}) USING (scenario, batch_no)),
{out} AS (SELECT r.* FROM {results} r JOIN stops USING (scenario, batch_no) WHERE cp_order <= stop_at)"""


def alert_ctes(results: str, pipeline: str, run: str = "scenario") -> str:
    return f"""
prob AS (
  SELECT *, coalesce(field, check_name) AS root, '{pipeline}:' || coalesce(field, check_name) || ':' || coalesce(segment, 'all') AS alert_id,
    CASE WHEN message <> '' THEN check_name || CASE WHEN segment IS NOT NULL AND segment <> '' THEN ' (' || segment || ')' ELSE '' END
      || ': ' || message ELSE check_name || ' returned ' || status END AS alert_message,
    CASE WHEN status = 'fail' THEN 3 ELSE 2 END AS rnk
  FROM {results} WHERE status IN ('fail', 'warn', 'error')),
seen AS (
  SELECT *, row_number() OVER w AS seen_no, lead(batch_no) OVER w AS next_batch
  FROM (SELECT DISTINCT {run}, checkpoint, batch_no FROM {results}) WINDOW w AS (PARTITION BY {run}, checkpoint ORDER BY batch_no)),
isl AS (
  SELECT *, seen_no - row_number() OVER (PARTITION BY {run}, checkpoint, root, segment ORDER BY batch_no) AS island
  FROM (SELECT DISTINCT {run}, checkpoint, root, segment, alert_id, batch_no FROM prob) JOIN seen USING ({run}, checkpoint, batch_no)),
epi AS (
  SELECT {run}, checkpoint, root, segment, alert_id, island, min(batch_no) AS first_batch, max(batch_no) AS last_batch,
    count(*) AS batches, max_by(coalesce(next_batch, -1), batch_no) AS nb FROM isl GROUP BY ALL),
chg AS (
  SELECT * FROM (
    SELECT p.*, i.island, lag(alert_message) OVER w AS prev,
      max(rnk) OVER (PARTITION BY {', '.join('p.' + c.strip() for c in run.split(','))}, p.checkpoint, p.root, p.segment, i.island
        ORDER BY p.batch_no, p.cp_order, p.check_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst,
      min(p.batch_no) OVER (PARTITION BY {', '.join('p.' + c.strip() for c in run.split(','))}, p.checkpoint, p.root, p.segment, i.island) AS first_batch
    FROM prob p JOIN isl i ON {' AND '.join(f'p.{c.strip()} = i.{c.strip()}' for c in run.split(','))} AND p.checkpoint = i.checkpoint
      AND p.root = i.root AND p.segment IS NOT DISTINCT FROM i.segment AND p.batch_no = i.batch_no
    WINDOW w AS (PARTITION BY {', '.join('p.' + c.strip() for c in run.split(','))}, p.checkpoint, p.root, p.segment, i.island
      ORDER BY p.batch_no, p.cp_order, p.check_seq))
  WHERE worst IS NULL OR rnk > worst OR alert_message <> prev),
latest AS (
  SELECT {run}, alert_id, arg_max(CASE greatest(rnk, coalesce(worst, 0)) WHEN 3 THEN 'high' ELSE 'medium' END, o) AS severity,
    arg_max(alert_message, o) AS message, arg_max(coalesce(field, ''), o) AS root_field, arg_max(coalesce(segment, ''), o) AS segment,
    min(batch_no) AS first_batch
  FROM (SELECT *, batch_no * 1000000 + cp_order * 1000 + check_seq AS o FROM chg) GROUP BY ALL)"""


def score_ctes(run: str = "scenario", window: int = 5) -> str:
    return f"""
matched AS (
  SELECT {run}, alert_id, nullif(l.segment, '') AS segment, first_batch, injection_id, fault_type, onset_batch,
    fault_type <> 'clean' AND (l.segment = '' OR coalesce(l.segment = inj_segment, false))
      AND first_batch BETWEEN onset_batch AND onset_batch + {window - 1} AS is_match
  FROM latest l JOIN truth USING (scenario)),
scored AS (
  SELECT {run}, fault_type, f IS NOT NULL AS detected, f - onset_batch AS lag_batches, mid AS matched_alert_id,
    coalesce(tp, 0) AS true_positives, coalesce(fp, 0) AS false_positives
  FROM {{base}} LEFT JOIN (
    SELECT {run}, min(first_batch) FILTER (WHERE is_match) AS f,
      (min(lpad(CAST(first_batch AS VARCHAR), 6, '0') || alert_id) FILTER (WHERE is_match))[7:] AS mid,
      count(*) FILTER (WHERE is_match) AS tp, count(*) FILTER (WHERE NOT is_match) AS fp
    FROM matched GROUP BY ALL) m USING ({run}))"""
