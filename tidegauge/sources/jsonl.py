"""JSON-lines batch files: one file per batch, `batch_NNNN*.jsonl`.

Lines are read as text and parsed to VARIANT, so a field that arrives with another type than
expected keeps its wire type (`<field>_kind`) instead of turning into a silent null or cast."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, batch_no, doc): non-blank lines of every batch file, the id from the file name or
    from its `batch_NNNN.jsonl` parent folder."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    return parse_lines(lines.select("value", F.col("_metadata.file_path").alias("_path")))


def parse_lines(lines: DataFrame) -> DataFrame:
    batch_id = F.regexp_extract("_path", r"(batch_\d+)\.jsonl", 1)
    return (lines.where(F.length(F.trim("value")) > 0)
            .select(batch_id.alias("batch_id"),
                    F.regexp_extract(batch_id, r"(\d+)", 1).cast("int").alias("batch_no"),
                    F.try_parse_json("value").alias("doc")))


def text(path: str) -> Column:
    return F.try_variant_get("doc", path, "string")


def number(path: str) -> Column:
    """The value only if it was a number on the wire."""
    return F.when(kind(path) == "number", F.try_variant_get("doc", path, "double"))


def kind(path: str) -> Column:
    """Wire type of a field: number, text, or null when missing."""
    raw = F.schema_of_variant(F.try_variant_get("doc", path, "variant"))
    return (F.when(raw.isNull() | (raw == "VOID"), None).when(raw == "STRING", "text")
            .when(raw.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("other"))


def _stamp(path: str) -> Column:
    return F.timestamp_millis(F.try_variant_get("doc", path, "bigint"))


def web_events(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_web(read_lines(spark, folder))


def flatten_web(lines: DataFrame) -> DataFrame:
    p = "$.payload."
    return lines.select(
        "batch_id", "batch_no", F.try_variant_get("doc", "$.line_no", "bigint").alias("line_no"),
        text("$.event_id").alias("event_id"), _stamp("$.timestamp").alias("event_ts"),
        text("$.user_id").alias("user_id"), text("$.session_id").alias("session_id"),
        text("$.platform").alias("platform"), text("$.client_version").alias("client_version"),
        text(p + "page").alias("page"), text(p + "action").alias("action"),
        number(p + "duration_ms").alias("duration_ms"), text(p + "error_message").alias("error_message"),
        kind(p + "duration_ms").alias("duration_ms_kind"))


def behavior_sessions(spark: SparkSession, folder: str) -> DataFrame:
    p = "$.payload."
    return read_lines(spark, folder).select(
        "batch_id", "batch_no", F.try_variant_get("doc", "$.line_no", "bigint").alias("line_no"),
        text("$.event_id").alias("event_id"), text("$.user_id").alias("user_id"),
        text("$.session_id").alias("session_id"), text("$.platform").alias("platform"),
        text("$.client_version").alias("client_version"),
        F.try_variant_get("doc", "$.timestamp", "bigint").alias("session_start_ms"),
        number(p + "duration_ms").alias("duration_ms"), text(p + "action").alias("action"),
        kind(p + "duration_ms").alias("duration_ms_kind"), _stamp("$.timestamp").alias("session_start"))


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(spark, folder).select(
        "batch_id", "batch_no", F.try_variant_get("doc", "$.line_no", "bigint").alias("line_no"),
        text("$.transaction_id").alias("transaction_id"),
        F.try_variant_get("doc", "$.event_ts", "bigint").alias("event_ts"),
        text("$.merchant_id").alias("merchant_id"), text("$.user_id").alias("user_id"),
        number("$.amount_cents").alias("amount_cents"), text("$.currency").alias("currency"),
        text("$.payment_method").alias("payment_method"), text("$.status").alias("status"),
        text("$.error_message").alias("error_message"), kind("$.amount_cents").alias("amount_cents_kind"))


def web_documents(df: DataFrame) -> Column:
    """One JSON document per web event, keys sorted."""
    number_payload = F.struct("action", F.col("duration_ms").cast("bigint").alias("duration_ms"), "error_message", "page")
    head = [F.col("client_version"), F.col("event_id"), F.col("line_no")]
    tail = [F.col("platform"), F.col("session_id"), F.unix_millis(F.col("event_ts").cast("timestamp")).alias("timestamp"),
            F.col("user_id")]

    def doc(payload: Column) -> Column:
        return F.to_json(F.struct(*head, payload.alias("payload"), *tail))

    if "duration_ms_text" not in df.columns:
        return doc(number_payload)
    text_payload = F.struct("action", F.col("duration_ms_text").alias("duration_ms"), "error_message", "page")
    return F.when(F.col("duration_ms_kind") == "text", doc(text_payload)).otherwise(doc(number_payload))


def payment_documents(df: DataFrame) -> Column:
    return F.to_json(F.struct(
        F.col("amount_cents").cast("bigint").alias("amount_cents"), "currency", "error_message", "event_ts",
        "line_no", "merchant_id", "payment_method", "status", "transaction_id", "user_id"))


def write_batches(df: DataFrame, document: Column, folder: str) -> str:
    """Write each batch as JSON lines under its own `batch_NNNN.jsonl` folder. A batch may be
    written by many tasks, so a batch is a folder of part files."""
    name = F.concat(F.lit("batch_"), F.lpad(F.col("batch_no").cast("string"), 4, "0"), F.lit(".jsonl"))
    (df.select(document.alias("value"), name.alias("batch"))
     .write.partitionBy("batch").mode("overwrite").text(folder))
    return folder
