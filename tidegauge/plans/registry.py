"""Findings, decisions and contract rows of a catalogue of pipelines, from the document tables.

Every document is a review item of the feed it came from; its labels are the reviewer's decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.reports import KIND_CHECKS
from tidegauge.plans.contracts import WEB, contract_rows
from tidegauge.sources.views import table

FIELDS = ("duration_ms", "user_id", "error_message", "event_id", "country_id", "avg_duration_s", "status")
PIPELINES = ("web_analytics", "user_behavior", "payment_processing")


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def findings(spark: SparkSession, folder: str, by_feed: bool = True) -> DataFrame:
    """finding_id, pipeline, kind, field. Pipelines are the feeds, or the three shipped pipelines."""
    d = table(spark, folder, "documents").select("doc_id", "source")
    feed = F.substring("source", 4, 10).cast("int")
    pipeline = F.col("source") if by_feed else _pick(F.pmod(feed, F.lit(3)), PIPELINES)
    kinds = [k for k, _ in KIND_CHECKS]
    return d.select(
        F.concat(F.lit("finding_"), F.col("doc_id").cast("string")).alias("finding_id"), pipeline.alias("pipeline"),
        _pick(F.pmod("doc_id", F.lit(len(kinds))), kinds).alias("kind"),
        _pick(F.pmod(F.floor(F.col("doc_id") / F.lit(len(kinds))), F.lit(len(FIELDS))), FIELDS).alias("field"))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "labels")
    return d.select(F.concat(F.lit("finding_"), F.col("doc_id").cast("string")).alias("finding_id"),
                    F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed")
                    .otherwise("pending").alias("status"))


def contract_catalog(spark: SparkSession, pipelines: DataFrame) -> DataFrame:
    """The web contract's rows registered for every pipeline of the catalogue."""
    rows = contract_rows(spark, WEB).collect()  # configuration, not data
    specs = F.array(*[F.struct(
        F.lit(r.cp_order).alias("cp_order"), F.lit(r.checkpoint).alias("checkpoint"),
        F.lit(r.field).cast("string").alias("field"), F.lit(r.check_type).alias("check_type"),
        F.lit(r.kind).alias("kind")) for r in rows])
    return pipelines.select("pipeline").distinct().select("pipeline", F.explode(specs).alias("c")).select("pipeline", "c.*")
