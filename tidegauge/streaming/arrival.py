"""Batches judged once, when they are whole: contract, guard and alerts chained on arriving files.

A manifest says how many files each batch has. Files land in a table partitioned by batch as they arrive, in any order and any split
over triggers. A batch is closed when all its files are there, or when it is overdue: a batch `lateness` or more numbers after it has
sent something. Closed batches are judged in order of their numbers, so the one after an open batch waits; an overdue batch without
files is judged as silent. A judged batch runs the whole contract; the guard decides which of its results count and which batches are
quarantined; the alert lifecycle goes on from what was open. Files of a batch that was judged before are counted in `late` and
change nothing.

Every epoch writes folders of its own and reads only those of earlier epochs, so a replayed or restarted stream gives the same tables.
What the driver collects are the batch numbers of one epoch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import guard
from tidegauge.sources.jsonl import parse_lines
from tidegauge.streaming.alerts import transitions

KEYS = ["batch_no"]
LINE = "value string, _path string, batch_no int"


def batch_of(path: str = "_path"):
    return F.regexp_extract(path, r"batch_(\d+)[^/]*\.jsonl", 1).cast("int")


def manifest_of(files: DataFrame) -> DataFrame:
    """(batch_no, files) of a listing of paths, for senders that write no manifest of their own."""
    return files.groupBy(batch_of().alias("batch_no")).agg(F.count_distinct("_path").alias("files"))


@dataclass(frozen=True)
class Chain:
    """`judge(lines, expected)` gives (check results of the batches, rows to quarantine from) for the parsed lines of closed batches;
    `expected` (batch_no) lists them, the silent ones too. `mode` is the guard's (None: the session's)."""

    judge: Callable[[DataFrame, DataFrame], tuple[DataFrame | None, DataFrame]]
    manifest: DataFrame
    out: str
    checkpoint: str
    mode: str | None = None
    lateness: int = 1 << 30

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.out}/{name}").drop("epoch")

    def _past(self, spark: SparkSession, name: str, epoch: int, schema: str) -> DataFrame:
        """What earlier epochs have written under this name."""
        if not epoch:
            return spark.createDataFrame([], schema)
        root = f"{self.out}/{name}"
        rows = spark.read.schema(schema + ", epoch int").option("basePath", root).parquet(*[f"{root}/epoch={e}" for e in range(epoch)])
        return rows.drop("epoch")

    def _write(self, df: DataFrame, name: str, epoch: int, by: str | None = None) -> DataFrame:
        path = f"{self.out}/{name}/epoch={epoch}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _closed(self, files: DataFrame, judged: DataFrame) -> list[int]:
        """Numbers of the batches to judge now: closed, not judged, and with no open batch before them."""
        have = files.groupBy("batch_no").agg(F.count_distinct("_path").alias("have"))
        state = self.manifest.join(have, "batch_no", "left").join(judged.withColumn("done", F.lit(True)), "batch_no", "left")
        newest = have.agg(F.max("batch_no").alias("newest"))
        state = state.join(F.broadcast(newest)).select("batch_no", F.coalesce("done", F.lit(False)).alias("done"), (
            (F.coalesce("have", F.lit(0)) >= F.col("files")) | (F.col("newest") - F.col("batch_no") >= self.lateness)).alias("closed"))
        first_open = state.where("not done and not closed").agg(F.min("batch_no")).first()[0]
        ready = state.where("not done and closed")
        if first_open is not None:
            ready = ready.where(F.col("batch_no") < first_open)
        return [r.batch_no for r in ready.orderBy("batch_no").collect()]

    def step(self, lines: DataFrame, epoch: int) -> None:
        spark = lines.sparkSession
        judged = self._past(spark, "judged", epoch, "batch_no int")
        landed = self._write(lines.select("value", "_path", batch_of().alias("batch_no")), "landing", epoch, by="batch_no")
        arrived = self._write(landed.select("_path", "batch_no").distinct(), "files", epoch)
        self._write(arrived.join(judged, KEYS, "left_semi"), "late", epoch)
        files = self._past(spark, "files", epoch, "_path string, batch_no int").unionByName(arrived)
        numbers = self._closed(files, judged)
        now = self._write(spark.createDataFrame([(n,) for n in numbers], "batch_no int"), "judged", epoch)
        if not numbers:
            return
        rows = self._past(spark, "landing", epoch, LINE).unionByName(landed).where(F.col("batch_no").isin(*numbers))
        results, data = self.judge(parse_lines(rows.select("value", "_path")), now)
        if results is None:
            return
        results = self._write(results, "checked", epoch)
        recorded = guard.guard(results, self.mode, KEYS)
        if recorded is None:  # the guard is off: nothing is recorded
            return
        recorded = self._write(recorded, "results", epoch)
        enforced = (self.mode or guard.configured_mode(spark)) == "enforce"
        stops = guard.blocked_at(results, KEYS, enforce=enforced)
        self._write(data.join(stops.where("blocked_order is not null").select(*KEYS), KEYS, "left_semi"), "quarantine", epoch)
        earlier = [e for e in range(epoch) if self._exists(spark, f"{self.out}/open/epoch={e}")]
        before = spark.read.parquet(f"{self.out}/open/epoch={earlier[-1]}") if earlier else None
        events, still_open = transitions(recorded, before)
        self._write(events, "events", epoch)
        self._write(still_open, "open", epoch)

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def follow(self, stream: DataFrame) -> None:
        """Process what has arrived since the last run."""
        query = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
