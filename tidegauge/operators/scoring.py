"""Detection scoring: alerts against the injected ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_PRECISION = 0.90
MIN_RECALL = 0.70
MAX_MEAN_LAG = 2.0


def match(alerts: DataFrame, truth: DataFrame, run: list[str], window: int = WINDOW) -> DataFrame:
    """Every alert with `is_match`: same scenario, same or no segment, first seen between the onset
    and the end of the window. Alerts on clean data never match. `run` are the run keys of `alerts`
    (scenario among them); the join is an equi-join on the scenario with range conditions on top."""
    t = truth.select("scenario", "injection_id", "fault_type", F.col("segment").alias("inj_segment"), "onset_batch")
    joined = alerts.join(t, "scenario")
    same = F.col("segment").isNull() | F.coalesce(F.col("segment") == F.col("inj_segment"), F.lit(False))
    hit = ((F.col("fault_type") != "clean") & same
           & F.col("first_batch").between(F.col("onset_batch"), F.col("onset_batch") + F.lit(window - 1)))
    return joined.select(*run, "alert_id", "segment", "first_batch", "injection_id", "fault_type", "onset_batch",
                         hit.alias("is_match"))


def scenarios(matched: DataFrame, truth: DataFrame, systems: Column | None, run: list[str]) -> DataFrame:
    """Per run: detected, lag, matched alert, true and false positives. Runs without any alert keep a
    row; `systems` is the array of system names to report, when `run` has a system."""
    hit = F.col("is_match")
    agg = matched.groupBy(*run).agg(
        F.min(F.when(hit, F.col("first_batch"))).alias("_first"),
        F.min(F.when(hit, F.struct("first_batch", "alert_id")))["alert_id"].alias("matched_alert_id"),
        F.count_if(hit).alias("true_positives"), F.count_if(~hit).alias("false_positives"))
    base = truth.select("scenario", "fault_type", "onset_batch")
    if systems is not None:
        base = base.withColumn("system", F.explode(systems))
    out = base.join(agg, run, "left")
    return out.select(
        *run, "fault_type", F.col("_first").isNotNull().alias("detected"),
        (F.col("_first") - F.col("onset_batch")).alias("lag_batches"), "matched_alert_id",
        F.coalesce("true_positives", F.lit(0)).alias("true_positives"),
        F.coalesce("false_positives", F.lit(0)).alias("false_positives"))


def system_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Precision over alerts (1 without any), recall over faulty scenarios (0 without any), mean lag
    over detected ones."""
    tp, fp = F.sum("true_positives"), F.sum("false_positives")
    faulty = F.col("fault_type") != "clean"
    n = F.count_if(faulty)
    return scored.groupBy(*by).agg(
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0)).alias("precision"),
        F.when(n > 0, F.count_if(faulty & F.col("detected")) / n).otherwise(F.lit(0.0)).alias("recall"),
        F.avg(F.when(faulty, F.col("lag_batches"))).alias("mean_lag_batches"))


def false_alarms(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share of the scored runs, clean or faulty, that raise at least one alert no fault explains."""
    return scored.groupBy(*by).agg((F.count_if(F.col("false_positives") > 0) / F.count(F.lit(1))).alias("false_positive_rate"))


def report(scored: DataFrame) -> DataFrame:
    """The detection report as one table: every system and scenario with the system's precision, recall and mean lag."""
    return scored.join(system_scores(scored, ["system"]), "system")


def matrix(scored: DataFrame, systems: list[str]) -> DataFrame:
    """Scenario x system: caught or missed."""
    word = F.when(F.col("detected"), "caught").otherwise("missed")
    return (scored.groupBy("scenario").pivot("system", systems).agg(F.first(word)).na.fill("missed"))


def gate(scores: DataFrame) -> DataFrame:
    """One row per gate threshold with its verdict and the problem text when it is broken."""
    lag = F.col("mean_lag_batches")
    rows = F.array(
        F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("value"), F.lit(MIN_PRECISION).alias("bound"),
                 (F.col("precision") >= MIN_PRECISION).alias("passed")),
        F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("value"), F.lit(MIN_RECALL).alias("bound"),
                 (F.col("recall") >= MIN_RECALL).alias("passed")),
        F.struct(F.lit("mean_lag_batches").alias("metric"), lag.alias("value"), F.lit(MAX_MEAN_LAG).alias("bound"),
                 (lag.isNull() | (lag <= MAX_MEAN_LAG)).alias("passed")))
    keep = [c for c in scores.columns if c not in ("precision", "recall", "mean_lag_batches")]
    return scores.select(*keep, F.explode(rows).alias("g")).select(*keep, "g.*")


def by_check(problems: DataFrame, truth: DataFrame, window: int = WINDOW) -> DataFrame:
    """Fault x check: did this check catch the fault, how late, and does it alert on clean data.
    `problems` are failing results with scenario, check, segment and batch_no."""
    p = problems.groupBy("scenario", "check", "segment").agg(
        F.min("batch_no").alias("first_any"))
    hits = (problems.join(truth.select("scenario", F.col("segment").alias("inj_segment"), "onset_batch", "fault_type"),
                          "scenario")
            .where((F.col("fault_type") != "clean")
                   & (F.col("segment").isNull() | (F.col("segment") == F.col("inj_segment")))
                   & F.col("batch_no").between(F.col("onset_batch"), F.col("onset_batch") + F.lit(window - 1)))
            .groupBy("scenario", "check").agg((F.min("batch_no") - F.min("onset_batch")).alias("lag_batches")))
    noisy = p.where(F.col("scenario") == "clean").select("check", F.lit(True).alias("on_clean")).distinct()
    pairs = p.where(F.col("scenario") != "clean").select("scenario", "check").distinct()
    return (pairs.join(hits, ["scenario", "check"], "left").join(noisy, "check", "left")
            .select("scenario", "check", F.col("lag_batches").isNotNull().alias("caught"), "lag_batches",
                    F.coalesce("on_clean", F.lit(False)).alias("false_positive_on_clean")))
