"""One file per batch, checked on arrival: Structured Streaming over JSON-lines folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.jsonl import parse_lines


def stream_text(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines as they arrive (`value`, `_path`), not yet parsed."""
    lines = (spark.readStream.format("text").option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", str(files_per_trigger)).load(folder))
    return lines.select("value", F.col("_metadata.file_path").alias("_path"))


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming counterpart of the batch reader."""
    return parse_lines(stream_text(spark, folder, files_per_trigger))


def check_on_arrival(stream: DataFrame, checks: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run `checks` on every micro-batch and append the results, tagged with the epoch. An epoch
    replayed after a failure overwrites its own folder, so results are written exactly once."""

    def handle(batch: DataFrame, epoch: int) -> None:
        checks(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
