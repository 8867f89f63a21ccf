"""Result tables: append-only check results, drift rows, and keyed upserts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidegauge.operators.alerts import severity_name, severity_rank
from tidegauge.session import cut

#: Buckets of a keyed table, and how its pointers are kept; the row of `NO_BUCKET` notes the schema.
BUCKETS, NO_BUCKET = 16, -1
POINTERS = "bucket int, written long, note string"

# Check name prefix -> drift type vocabulary.
DRIFT_TYPES = (("psi", "psi"), ("ks", "ks_test"), ("oov_rate", "oov"), ("template_drift", "template_change"))


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("pipeline").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drift_rows(results: DataFrame) -> DataFrame:
    """Judged numeric and text drift results in the drift table's vocabulary. Only PSI and KS keep
    a score there; word and template rows have none."""
    prefix = F.split("check", ":")[0]
    kind = F
    for name, label in DRIFT_TYPES:
        kind = kind.when(prefix == name, F.lit(label))
    score = F.when(prefix.isin("psi", "ks"), F.col("metric"))
    threshold = F.when(prefix.isin("oov_rate", "template_drift"), F.col("threshold"))
    keep = [c for c in ("scenario", "batch_no") if c in results.columns]
    return (results.where(F.col("check_type").isin("numeric_drift", "text_drift")
                          & (F.col("status") != "insufficient_data"))
            .withColumn("drift_type", kind).where(F.col("drift_type").isNotNull())
            .select(*keep, "pipeline", "checkpoint", F.col("field").alias("field_name"),
                    F.coalesce("segment", F.lit("all")).alias("segment"), "drift_type",
                    severity_name(severity_rank(F.col("status"))).alias("severity"),
                    score.alias("baseline_value"), score.alias("current_value"), threshold.alias("threshold"),
                    "message"))


def upsert_alerts(old: DataFrame | None, new: DataFrame, at: list[str]) -> DataFrame:
    """Alert table after an upsert on (pipeline, alert_id): the newest row (by `at`) sets severity and
    message, the oldest keeps the run and the other columns. Re-applying the same rows changes nothing."""
    rows = new if old is None else old.unionByName(new)
    key = ["pipeline", "alert_id"]
    order = F.struct(*at)
    keep = [c for c in rows.columns if c not in key + ["severity", "message"] + at]
    return rows.groupBy(*key).agg(
        F.max_by("severity", order).alias("severity"), F.max_by("message", order).alias("message"),
        *[F.min_by(c, order).alias(c) for c in keep],
        *[F.min(order)[c].alias(c) for c in at], F.count(F.lit(1)).alias("writes"))


def _pointers(spark: SparkSession, folder: str, epoch: int) -> tuple[dict[int, int], StructType | None]:
    """({bucket: epoch that wrote it last}, schema) of the table after an epoch: as many rows as the table has buckets."""
    if epoch < 0:
        return {}, None
    rows = spark.read.schema(POINTERS).parquet(f"{folder}/pointers/epoch={epoch}").collect()
    schema = next(r.note for r in rows if r.bucket == NO_BUCKET)
    return {r.bucket: r.written for r in rows if r.bucket != NO_BUCKET}, StructType.fromJson(json.loads(schema))


def read_table(spark: SparkSession, folder: str, epoch: int, buckets: set[int] | None = None) -> DataFrame:
    """The keyed table as it stood after an epoch, or only some of its buckets."""
    at, schema = _pointers(spark, folder, epoch)
    paths = [f"{folder}/rows/epoch={e}/_bucket={b}" for b, e in sorted(at.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_epoch(new: DataFrame, folder: str, epoch: int, key: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
                buckets: int = BUCKETS, keep: int = 2) -> set[int]:
    """The keyed table after an epoch: `merge(rows before or None, new)` over the buckets of the key's hash that `new` touches; all others
    stay where they are, and a pointer table says which epoch wrote each bucket last. Returns the buckets written.

    An epoch writes only its own folders and reads only those of the one before, so a replay overwrites itself and a failed epoch
    leaves the last table whole; the pointers come last. What the last `keep` epochs no longer point at is removed. `buckets` is fixed
    by the first epoch's caller and must not change; choose it so that a bucket is a few files. Empty `new` moves pointers only."""
    spark = new.sparkSession
    tagged = cut(new.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    touched = {r[0] for r in tagged.select("_bucket").distinct().collect()}  # at most `buckets`
    at, schema = _pointers(spark, folder, epoch - 1)
    old = read_table(spark, folder, epoch - 1, touched) if epoch else None
    merged = merge(old, tagged.drop("_bucket"))
    schema = schema or merged.schema
    if touched:
        rows = merged.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/rows/epoch={epoch}")
        schema = merged.schema
    at |= dict.fromkeys(touched, epoch)
    told = [(b, e, None) for b, e in at.items()] + [(NO_BUCKET, epoch, schema.json())]
    spark.createDataFrame(told, POINTERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointers/epoch={epoch}")
    _retire(spark, folder, epoch, keep)
    return touched


def _retire(spark: SparkSession, folder: str, epoch: int, keep: int) -> None:
    """Remove bucket folders and pointers that no epoch of the last `keep` needs. Each epoch clears what it outdates, so few are listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = max(0, epoch - keep + 1)
    live = {(e, b) for k in range(oldest, epoch + 1) for b, e in _pointers(spark, folder, k)[0].items()}
    for found in fs.globStatus(path(f"{folder}/rows/epoch=*/_bucket=*")) or ():
        e, b = (int(x.split("=")[1]) for x in found.getPath().toString().rstrip("/").split("/")[-2:])
        if e < epoch and (e, b) not in live:
            fs.delete(found.getPath(), True)
    for found in fs.globStatus(path(f"{folder}/pointers/epoch=*")) or ():
        if int(found.getPath().getName().split("=")[1]) < oldest:
            fs.delete(found.getPath(), True)


def write_alerts(new: DataFrame, folder: str, epoch: int, at: list[str], buckets: int = BUCKETS) -> set[int]:
    """The alert table of an epoch: the one before it with `new` upserted, bucketed by pipeline and alert. Applying the same rows twice,
    in one epoch or in the next, changes nothing but the count of writes."""
    def merge(old, rows):
        return upsert_alerts(old.drop("writes") if old is not None else None, rows, at)
    return write_epoch(new, folder, epoch, ["pipeline", "alert_id"], merge, buckets)


def write_rows(new: DataFrame, folder: str, epoch: int, key: list[str], version: str, buckets: int = BUCKETS) -> set[int]:
    """The same for tables where the last version of a key wins."""
    return write_epoch(new, folder, epoch, key, lambda old, rows: upsert_rows(old, rows, key, version), buckets)


def upsert_rows(old: DataFrame | None, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last version per key wins (baseline profiles)."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return rows.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")
