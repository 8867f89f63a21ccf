"""Run profiles, output equivalence, review status and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

RTOL = 1e-9


# --- run profile ---

def profile_stages(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per stage and column: rows in and out, null count, and whether the column is new or dropped
    against the stage before. Each stage is read by one aggregation; the column lists are schema."""
    parts, before = [], None
    for order, (name, df) in enumerate(frames, start=1):
        counts = df.agg(F.count(F.lit(1)).alias("rows_out"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("null_count"),
                          F.lit("new" if before is not None and c not in before else "kept").alias("change"))
                 for c in df.columns]
        cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("bigint").alias("null_count"), F.lit("dropped").alias("change"))
                  for c in sorted(set(before or []) - set(df.columns))]
        parts.append(counts.select(F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), "rows_out",
                                   F.explode(F.array(*cells)).alias("c"))
                     .select("stage_order", "stage", "rows_out", "c.*"))
        before = df.columns
    out = reduce(DataFrame.unionByName, parts)
    sizes = out.groupBy("stage_order").agg(F.max("rows_out").alias("rows_in")).withColumn("stage_order", F.col("stage_order") + 1)
    return out.join(sizes, "stage_order", "left").select(
        "stage_order", "stage", "rows_in", "rows_out", "column", "null_count", "change")


# --- output equivalence ---

def _same(a: Column, b: Column, real: bool, rtol: float) -> Column:
    if not real:
        return a.eqNullSafe(b)
    close = F.abs(a - b) <= F.lit(rtol) * F.abs(a)
    return F.coalesce(close, a.eqNullSafe(b))


def equivalence_rows(golden: DataFrame, current: DataFrame, keys: list[str], rtol: float = RTOL) -> DataFrame:
    """Golden against current rows on their keys (missing keys equal): `identical`, `changed`,
    `missing` (only golden) or `added` (only current), with the differing columns."""
    values = [c for c in golden.columns if c not in keys]
    g = golden.select(*[F.col(k).alias(f"g_{k}") for k in keys], *[F.col(c).alias(f"g_{c}") for c in values], F.lit(1).alias("g_"))
    c = current.select(*[F.col(k).alias(f"c_{k}") for k in keys], *[F.col(v).alias(f"c_{v}") for v in values], F.lit(1).alias("c_"))
    on = reduce(lambda a, b: a & b, [F.col(f"g_{k}").eqNullSafe(F.col(f"c_{k}")) for k in keys])
    both = g.join(c, on, "full")
    types = {f.name: f.dataType for f in golden.schema.fields}
    diff = F.array_compact(F.array(*[
        F.when(~_same(F.col(f"g_{v}"), F.col(f"c_{v}"), isinstance(types[v], (DoubleType, FloatType)), rtol), F.lit(v))
        for v in values]))
    verdict = (F.when(F.col("c_").isNull(), "missing").when(F.col("g_").isNull(), "added")
               .when(F.size(diff) == 0, "identical").otherwise("changed"))
    return both.select(*[F.coalesce(f"g_{k}", f"c_{k}").alias(k) for k in keys], verdict.alias("verdict"),
                       F.when(F.col("c_").isNotNull() & F.col("g_").isNotNull(), F.array_join(diff, ",")).otherwise("")
                       .alias("changed_columns"))


def equivalence_score(rows: DataFrame) -> DataFrame:
    """Share of identical rows and the counts behind it."""
    v = F.col("verdict")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("rows"), *[F.count_if(v == x).alias(x) for x in ("identical", "changed", "missing", "added")],
                    F.when(n > 0, F.count_if(v == "identical") / n).otherwise(F.lit(1.0)).alias("equivalence_score"))


def difference(golden: DataFrame, current: DataFrame) -> DataFrame:
    """Keyless comparison: multiset differences in both directions."""
    return (golden.exceptAll(current).withColumn("side", F.lit("missing"))
            .unionByName(current.exceptAll(golden).withColumn("side", F.lit("added"))))


# --- review ---

STATUSES = ("confirmed", "rejected", "pending")

# Finding kind -> check types that enforce it; row filters enable the volume gates.
KIND_CHECKS = (
    ("unit_conversion", ("unit", "range", "numeric_drift")),
    ("required_field", ("nulls",)),
    ("row_filter", ()),
    ("dedup_key", ("schema",)),
    ("unmapped_to_null", ("schema",)),
    ("default_fill", ("schema", "nulls")),
    ("keyword_match", ("text_drift",)),
    ("string_format", ("text_drift",)),
    ("timestamp_unit", ("schema", "unit")),
    ("timezone", ("schema",)),
    ("group_key_drops_nulls", ("nulls",)),
    ("null_lookalike_value", ("nulls",)),
    ("runtime_columns", ()),
    ("unused_field", ()),
)
# Unit suffixes that do not change which field is meant.
UNIT_SUFFIXES = ("_ms", "_s", "_usd", "_cents", "_id", "_rate", "_count")


def stem(field: Column) -> Column:
    """Field name without its unit suffix, if two or more characters remain."""
    out = F
    for suffix in UNIT_SUFFIXES:
        out = out.when(field.endswith(suffix) & (F.length(field) > len(suffix) + 1),
                       F.substr(field, F.lit(1), F.length(field) - F.lit(len(suffix))))
    return out.otherwise(field)


def review(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with their decision; undecided ones are pending."""
    d = decisions.select("finding_id", "status")
    return findings.join(d, "finding_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def contract_for_decisions(contract: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Contract rows (pipeline, checkpoint, field, check_type, kind) backed by confirmed findings of
    the same pipeline: a finding kind allows some check types on its field or on fields with the
    same stem; a confirmed row filter keeps the volume gates."""
    allowed = F
    for kind, types in KIND_CHECKS:
        allowed = allowed.when(F.col("finding_kind") == kind, F.array(*[F.lit(t) for t in types]).cast("array<string>"))
    confirmed = (reviewed.where(F.col("status") == "confirmed")
                 .select("pipeline", F.col("kind").alias("finding_kind"), F.col("field").alias("finding_field")).distinct())
    by_field = (confirmed.where(F.col("finding_field").isNotNull())
                .select("pipeline", stem(F.col("finding_field")).alias("_stem"), F.explode(allowed).alias("check_type")).distinct())
    gates = confirmed.where(F.col("finding_kind") == "row_filter").select("pipeline").distinct()
    fields = contract.where(F.col("field").isNotNull()).withColumn("_stem", stem(F.col("field")))
    kept = fields.join(by_field, ["pipeline", "_stem", "check_type"], "left_semi").drop("_stem")
    volume = contract.where(F.col("field").isNull()).join(gates, "pipeline", "left_semi")
    return kept.select(*contract.columns).unionByName(volume)


def contract_counts(kept: DataFrame) -> DataFrame:
    """Enforced checks per pipeline and whether any of them needs a baseline."""
    needs = F.col("kind").isin("segment_volume", "unit", "numeric_drift", "text_drift")
    return kept.groupBy("pipeline").agg(F.count(F.lit(1)).alias("enforced_checks"), F.bool_or(needs).alias("needs_baselines"))


# --- reports ---

def failed_last_run(results: DataFrame, run: str = "batch_no") -> DataFrame:
    """Failing or crashed checks of each pipeline's latest run."""
    last = results.groupBy("pipeline").agg(F.max(run).alias(run))
    return results.where(F.col("status").isin("fail", "error")).join(last, ["pipeline", run], "left_semi")


def alerts_by_field(alerts: DataFrame, created: str, since: Column) -> DataFrame:
    """Alerts per pipeline and field created after `since`, most first."""
    return (alerts.where(F.col(created) > since).groupBy("pipeline", F.col("root_field").alias("field_name"))
            .agg(F.count(F.lit(1)).alias("alert_count"), F.count_if(F.col("severity") == "high").alias("high_severity"))
            .orderBy(F.desc("alert_count"), "pipeline", "field_name"))


def pipeline_summary(reviewed: DataFrame, results: DataFrame, alerts: DataFrame, scores: DataFrame, equivalence: DataFrame) -> DataFrame:
    """One row per pipeline: guarantees by status, check counts, alerts, detection quality (`scores` with false_positive_rate) and the
    share of rows equal to the golden output (`equivalence`: pipeline, equivalence_score; null where none was compared)."""
    st = F.col("status")
    guarantees = reviewed.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("total_guarantees"), *[F.count_if(st == s).alias(f"{s}_guarantees") for s in STATUSES])
    checks = results.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("total_checks_run"), F.count_if(st == "pass").alias("checks_passed"),
        F.count_if(st == "fail").alias("checks_failed"), F.count_if(st == "warn").alias("checks_warned"))
    alarm = alerts.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("severity") == "high").alias("high_severity_alerts"))
    quality = scores.select("pipeline", F.col("precision").alias("detection_precision"), F.col("recall").alias("detection_recall"),
                            F.col("mean_lag_batches").alias("avg_detection_lag_batches"), "false_positive_rate")
    out = guarantees
    for part in (checks, alarm, quality, equivalence.select("pipeline", "equivalence_score")):
        out = out.join(part, "pipeline", "full")
    counts = [c for c in out.columns if c.split("_")[0] in ("total", "confirmed", "rejected", "pending", "checks", "high")]
    return out.na.fill(0, counts)


def scorecard(pipelines: DataFrame, summary: DataFrame) -> DataFrame:
    """Every registered pipeline with its summary, if any."""
    return pipelines.join(summary, "pipeline", "left").select(
        "pipeline", "confirmed_guarantees", "total_alerts", "high_severity_alerts",
        "detection_precision", "detection_recall", "avg_detection_lag_batches", "false_positive_rate", "equivalence_score")
