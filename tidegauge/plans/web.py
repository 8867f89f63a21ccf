"""Web analytics pipeline: ingest -> clean -> enrich -> aggregate.

`by` adds leading group keys (scenario, batch_no) so many batches run as one plan while each
batch is still deduplicated and aggregated on its own, as when every file is a separate run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.functions.ordered import exact_quantiles
from tidegauge.operators import stages as ops

NAME = "web_analytics"
ORDER = ["batch_no", "line_no"]  # of arrival
STAGES = ("ingest", "clean", "enrich", "aggregate")
MAX_DURATION_S = 300.0


def clean(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tidy(ops.dedup_keep_first(raw, [*by, "event_id"], ORDER))


def tidy(df: DataFrame) -> DataFrame:
    """The clean step behind its deduplication."""
    df = ops.filter_required(df, "user_id")
    df = df.withColumn("duration_s", S.scaled_down("duration_ms", 1000.0))
    df = ops.filter_range(df, "duration_s", below=MAX_DURATION_S)
    return (df.withColumn("is_error", F.col("error_message").isNotNull())
            .withColumn("is_timeout", S.contains_ci("error_message", "timeout"))
            .withColumn("major_version", S.major_version("client_version")))


def enrich(df: DataFrame) -> DataFrame:
    return (df.withColumn("country", S.country_of("session_id"))
            .withColumn("date", F.col("event_ts").cast("date")))


def aggregate(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily metrics per date, platform and country over page views. The rows are narrowed and
    collapsed once; the plain metrics and the exact p95 both read that one exchange."""
    keys = [*by, "date", "platform", "country"]
    views = ops.filter_required(ops.filter_equal(df, "action", "page_view"), "date", "platform", "country")
    narrow = (views.groupBy(*keys, "user_id", "duration_s", "is_error", "is_timeout")
              .agg(F.count("event_id").alias("n")))

    def mean_of(col):
        return F.sum(col.cast("double") * F.col("n")) / F.sum(F.when(col.isNotNull(), F.col("n")))

    base = narrow.groupBy(*keys).agg(
        F.sum("n").alias("events"),
        F.count_distinct("user_id").alias("active_users"),
        mean_of(F.col("is_error")).alias("error_rate"),
        mean_of(F.col("is_timeout")).alias("timeout_rate"),
        mean_of(F.col("duration_s")).alias("avg_duration_s"))
    p95 = exact_quantiles(narrow, keys, "duration_s", {"p95_duration_s": 0.95}, weight="n", few_values=True)
    return base.join(p95, keys, "left")


def run(raw: DataFrame) -> DataFrame:
    return aggregate(enrich(clean(raw))).orderBy("date", "platform", "country")
