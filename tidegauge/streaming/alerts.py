"""The alert lifecycle on a stream of check results, by the same set operations as in batch.

Each micro-batch is joined to what was open before it: an open problem is carried as one result row at the batch where its
checkpoint was last seen, with its worst severity and first batch. Runs of failing batches, worsening and closing are then
windows over (problem, batch). Nothing is held per key in a task, and a replayed epoch overwrites its own folders.

Batches may come late and in any order: results wait in a table until the watermark, the greatest batch number seen of their pipeline
and checkpoint less `lateness`, has passed them, and are then taken in order. Results of a batch that was already taken are kept apart
(`late`) and change nothing; the same row sent twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.alerts import problems, severity_name

RESULT = ["pipeline", "checkpoint", "cp_order", "check_seq", "batch_no", "check", "field", "segment", "status", "message"]
CARRIED = ["first_before", "worst_before"]
KEY = ["pipeline", "checkpoint", "root", "segment"]


def transitions(results: DataFrame, still_open: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, open problems) of whole batches of results on top of what was open. Rows come in order: see `follow` for batches
    that do not."""
    new = results.select(*RESULT, F.lit(None).cast("int").alias("first_before"), F.lit(None).cast("int").alias("worst_before"))
    rows = new if still_open is None else still_open.select(*RESULT, *CARRIED).unionByName(new)
    cp = Window.partitionBy("pipeline", "checkpoint").orderBy("batch_no")
    seen = (rows.select("pipeline", "checkpoint", "batch_no").distinct()
            .withColumn("seen_no", F.row_number().over(cp)).withColumn("next_batch", F.lead("batch_no").over(cp)))
    bad = problems(rows).join(seen, ["pipeline", "checkpoint", "batch_no"])
    bad = bad.withColumn("rank", F.greatest("rank", F.coalesce("worst_before", F.lit(0))))
    bad = bad.withColumn("run", F.col("seen_no") - F.dense_rank().over(Window.partitionBy(*KEY).orderBy("batch_no")))
    order = Window.partitionBy(*KEY, "run").orderBy("batch_no", "cp_order", "check_seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bad = bad.withColumns({"earlier": F.max("rank").over(before), "said": F.lag("alert_message").over(order), "worst": F.max("rank").over(whole),
                           "first_batch": F.coalesce(F.max("first_before").over(whole), F.min("batch_no").over(whole)),
                           "is_last": F.lead("batch_no").over(order).isNull()})

    def event(df: DataFrame, batch, rank, name) -> DataFrame:
        return df.select("pipeline", "checkpoint", "alert_id", batch.alias("batch_no"), "first_batch", severity_name(rank).alias("severity"),
                         F.col("alert_message").alias("message"), name.alias("event"))

    fresh = F.col("first_before").isNull()
    news = bad.where(fresh & (F.col("earlier").isNull() | (F.col("rank") > F.col("earlier")) | (F.col("alert_message") != F.col("said"))))
    ended = bad.where(F.col("is_last") & F.col("next_batch").isNotNull())
    events = event(news, F.col("batch_no"), F.greatest("rank", F.coalesce("earlier", F.lit(0))),
                   F.when(F.col("earlier").isNull(), "opened").otherwise("changed")).unionByName(
        event(ended, F.col("next_batch"), F.col("worst"), F.lit("closed")))
    left = bad.where(F.col("is_last") & F.col("next_batch").isNull())
    return events, left.select(*RESULT, F.col("first_batch").cast("int").alias("first_before"), F.col("worst").cast("int").alias("worst_before"))


CHECKPOINT = ["pipeline", "checkpoint"]


def _step(spark: SparkSession, batch: DataFrame | None, epoch: int, out: str, lateness: int | None) -> None:
    """One epoch on top of the one before; without `lateness` all that waits is taken."""
    def before(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{out}/{name}/epoch={epoch - 1}") if epoch else None

    def write(df: DataFrame, name: str) -> DataFrame:
        path = f"{out}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    held, marks = before("held"), before("marks")
    arrived = batch.select(*RESULT) if batch is not None else held.limit(0)
    if marks is not None:
        arrived = arrived.join(marks, CHECKPOINT, "left")
        past = F.coalesce(F.col("batch_no") <= F.col("taken"), F.lit(False))
    else:
        past = F.lit(False)
    write(arrived.where(past).select(*RESULT), "late")
    rows = arrived.where(~past).select(*RESULT)
    rows = write((rows if held is None else rows.unionByName(held)).distinct(), "waiting")
    seen = rows.groupBy(*CHECKPOINT).agg(F.max("batch_no").alias("top"))
    if marks is not None:
        seen = seen.join(marks, CHECKPOINT, "full").select(*CHECKPOINT, F.greatest("top", "seen").alias("top"), "taken")
    else:
        seen = seen.withColumn("taken", F.lit(None).cast("long"))
    limit = F.col("top").cast("long") - F.lit(lateness or 0)
    marks = write(seen.select(*CHECKPOINT, F.col("top").cast("long").alias("seen"), F.greatest("taken", limit).alias("taken")), "marks")
    rows = rows.join(marks, CHECKPOINT)
    ready = F.col("batch_no") <= F.col("taken")
    write(rows.where(~ready).select(*RESULT), "held")
    found, still_open = transitions(rows.where(ready).select(*RESULT), before("open"))
    write(still_open, "open")
    write(found, "events")


def follow(stream: DataFrame, out: str, checkpoint: str, lateness: int = 0) -> None:
    """Process what has arrived: events go to `out`/events, open problems to `out`/open, one folder an epoch."""
    query = stream.writeStream.foreachBatch(lambda batch, epoch: _step(batch.sparkSession, batch, epoch, out, lateness)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def finish(spark: SparkSession, out: str) -> None:
    """The stream has ended: what still waits is taken, as one more epoch."""
    last = spark.read.parquet(f"{out}/marks").agg(F.max("epoch")).first()[0]
    _step(spark, None, last + 1, out, None)


def events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/events").drop("epoch")
