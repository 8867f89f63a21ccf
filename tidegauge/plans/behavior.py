"""User behavior pipeline: ingest -> filter_sessions -> aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import stages as ops

NAME = "user_behavior"
STAGES = ("ingest", "filter_sessions", "aggregate")


def filter_sessions(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    df = ops.filter_required(raw, "user_id")
    df = df.withColumn("session_duration_s", S.scaled_down("duration_ms", 1000.0))
    df = ops.filter_equal(df, "action", "page_view")
    df = ops.filter_range(df, "session_duration_s", below=3600.0)
    return df.withColumn("major_version", S.major_version("client_version"))


def aggregate(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = [*by, "user_id"]
    out = df.groupBy(*keys).agg(
        F.count_distinct("session_id").alias("session_count"),
        F.count_distinct("platform").alias("platforms_used"),
        F.avg("session_duration_s").alias("avg_session_duration_s"),
        F.count("event_id").alias("events"))
    return out.withColumn("engagement_score", F.col("session_count") * F.col("platforms_used"))


def run(raw: DataFrame) -> DataFrame:
    return aggregate(filter_sessions(raw))
