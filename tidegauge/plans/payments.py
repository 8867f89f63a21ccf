"""Payment pipelines: ingest -> clean -> enrich -> reconcile, and the SQL-fed variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import stages as ops

NAME = "payment_processing"
ORDER = ["batch_no", "line_no"]  # of arrival
STAGES = ("ingest", "clean", "enrich", "reconcile")
ALLOWED_STATUS = ("settled", "declined", "pending", "refunded")
MAX_CENTS = 99_999_999.0


def clean(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tidy(ops.dedup_keep_first(raw, [*by, "transaction_id"], ORDER))


def tidy(df: DataFrame) -> DataFrame:
    """The clean step behind its deduplication."""
    df = ops.filter_required(df, "user_id")
    df = ops.filter_range(df, "amount_cents", above=0.0, below=MAX_CENTS)
    df = (df.withColumn("amount_usd", S.scaled_down("amount_cents", 100.0))
          .withColumn("is_error", S.contains_ci("error_message", "error")))
    return ops.filter_allowed(df, "status", ALLOWED_STATUS)


def enrich(df: DataFrame, ts_unit: str = "ns") -> DataFrame:
    """`ts_unit="ns"` keeps the feed's long-standing reading of the stamp as nanoseconds;
    `"ms"` gives the true calendar date."""
    return (df.withColumn("transaction_date", S.epoch_date("event_ts", ts_unit))
            .withColumn("merchant_region", S.merchant_region("merchant_id")))


def reconcile(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = [*by, "transaction_date", "merchant_region", "payment_method"]
    df = ops.filter_required(df, "transaction_date", "merchant_region", "payment_method")
    return df.groupBy(*keys).agg(
        F.count("transaction_id").alias("transaction_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.sum("amount_usd").alias("total_volume_usd"),
        F.avg("amount_usd").alias("avg_transaction_usd"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg(F.when(F.col("status") == "declined", 1.0).otherwise(0.0)).alias("decline_rate"))


def run(raw: DataFrame, ts_unit: str = "ns") -> DataFrame:
    return reconcile(enrich(clean(raw), ts_unit))


def clean_sql_feed(raw: DataFrame) -> DataFrame:
    """SQL-fed clean step: earliest stamp per transaction among rows with a user, no status
    filter, dotless versions map to an empty major version."""
    df = ops.filter_required(raw, "user_id")
    df = ops.dedup_keep_earliest(df, ["transaction_id"], "event_ts", ["batch_no", "line_no"])
    df = ops.filter_range(df, "amount_cents", above=0.0, below=MAX_CENTS)
    return (df.withColumn("amount_usd", S.scaled_down("amount_cents", 100.0))
            .withColumn("is_error", S.contains_ci("error_message", "error"))
            .withColumn("major_version", S.major_version_before_dot("client_version")))


def run_sql_feed(raw: DataFrame, ts_unit: str = "ms") -> DataFrame:
    return reconcile(enrich(clean_sql_feed(raw), ts_unit))
