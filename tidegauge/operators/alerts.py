"""Alert lifecycle as window functions over check results.

A problem is (run keys, pipeline, checkpoint, root field or check, segment). It opens on its first
failing batch and stays open while it fails in every batch *in which its checkpoint was seen*.
Windows run per checkpoint over its distinct batches, or per problem over its own failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROBLEM_STATUSES = ("fail", "warn", "error")


def severity_rank(status: Column) -> Column:
    return F.when(status == "fail", 3).when(status.isin("warn", "error"), 2).otherwise(1)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def with_severity(results: DataFrame) -> DataFrame:
    return results.withColumn("severity", severity_name(severity_rank(F.col("status"))))


def problems(results: DataFrame) -> DataFrame:
    """Failing results with their alert identity, message and severity rank. The alert id leaves
    out the checkpoint: one field failing at two checkpoints shares an id."""
    root = F.coalesce("field", "check")
    said = F.col("message").isNotNull() & (F.col("message") != "")
    where = F.when(F.col("segment").isNotNull() & (F.col("segment") != ""),
                   F.concat(F.lit(" ("), F.col("segment"), F.lit(")"))).otherwise(F.lit(""))
    return (results.where(F.col("status").isin(*PROBLEM_STATUSES))
            .withColumn("root", root)
            .withColumn("alert_id", F.concat_ws(":", "pipeline", root, F.coalesce("segment", F.lit("all"))))
            .withColumn("alert_message", F.when(said, F.concat(F.col("check"), where, F.lit(": "), F.col("message")))
                        .otherwise(F.concat(F.col("check"), F.lit(" returned "), F.col("status"))))
            .withColumn("rank", severity_rank(F.col("status"))))


def _seen(results: DataFrame, run: list[str]) -> DataFrame:
    """Batches in which each checkpoint produced any result, numbered, with the next one."""
    cp = [*run, "pipeline", "checkpoint"]
    w = Window.partitionBy(*cp).orderBy("batch_no")
    return (results.select(*cp, "batch_no").distinct()
            .withColumn("seen_no", F.row_number().over(w)).withColumn("next_batch", F.lead("batch_no").over(w)))


def _islands(results: DataFrame, run: list[str]) -> DataFrame:
    """(problem, batch) pairs with the number of the unbroken run they belong to."""
    key = [*run, "pipeline", "checkpoint", "root", "segment"]
    bad = problems(results).select(*key, "alert_id", "batch_no").distinct()
    at = bad.join(_seen(results, run), [*run, "pipeline", "checkpoint", "batch_no"])
    return at.withColumn("island", F.col("seen_no") - F.row_number().over(
        Window.partitionBy(*key).orderBy("batch_no")))


def episodes(results: DataFrame, run: list[str] = ()) -> DataFrame:
    """One row per open-to-close stretch of a problem; `closed_batch` is null while open."""
    run = list(run)
    key = [*run, "pipeline", "checkpoint", "root", "segment", "alert_id"]
    return (_islands(results, run).groupBy(*key, "island")
            .agg(F.min("batch_no").alias("first_batch"), F.max("batch_no").alias("last_batch"),
                 F.count(F.lit(1)).alias("batches"),
                 F.max_by("next_batch", "batch_no").alias("closed_batch"))
            .drop("island"))


def open_alerts(results: DataFrame, run: list[str] = ()) -> DataFrame:
    """Problems still failing at the last seen batch of their checkpoint."""
    return episodes(results, run).where(F.col("closed_batch").isNull())


def changes(results: DataFrame, run: list[str] = ()) -> DataFrame:
    """Every emitted alert row: a new problem, a worse severity, or a changed message. Severity
    never falls within an episode and the first batch is kept."""
    run = list(run)
    key = [*run, "pipeline", "checkpoint", "root", "segment"]
    island = _islands(results, run).select(*key, "batch_no", "island")
    p = problems(results)
    joined = _join_island(p, island, [*run, "pipeline", "checkpoint", "root", "batch_no"])
    w = Window.partitionBy(*key, "island").orderBy("batch_no", "cp_order", "check_seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    worst_before = F.max("rank").over(before)
    rows = (joined.withColumn("_prev", F.lag("alert_message").over(w))
            .withColumn("_worst", worst_before)
            .withColumn("first_batch", F.min("batch_no").over(w))
            .where(F.col("_worst").isNull() | (F.col("rank") > F.col("_worst"))
                   | (F.col("alert_message") != F.col("_prev"))))
    return rows.select(
        *run, "pipeline", "alert_id", "checkpoint", "cp_order", "check_seq", "batch_no", "first_batch",
        severity_name(F.greatest("rank", F.coalesce("_worst", F.lit(0)))).alias("severity"),
        F.col("alert_message").alias("message"), F.col("field").alias("root_field"), "segment")


def _join_island(p: DataFrame, island: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe on segment: whole-batch problems have none."""
    tag = F.coalesce("segment", F.lit("\u0000"))
    return p.withColumn("_s", tag).join(island.select(*on, tag.alias("_s"), "island"), [*on, "_s"]).drop("_s")


def latest(results: DataFrame, run: list[str] = ()) -> DataFrame:
    """Current view per alert id: the last emitted row wins, with the batch it was first seen in."""
    run = list(run)
    at = F.struct("batch_no", "cp_order", "check_seq")
    return changes(results, run).groupBy(*run, "pipeline", "alert_id").agg(
        F.max_by("severity", at).alias("severity"), F.max_by("message", at).alias("message"),
        F.max_by("root_field", at).alias("root_field"), F.max_by("segment", at).alias("segment"),
        F.min("batch_no").alias("first_batch"))
