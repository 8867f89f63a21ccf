"""Telemetry views over the supplied tables: how `events`, `orders` and `documents` become web
events, payments and log messages. Every view reads its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESEND_OFFSET = 1_000_000_000_000  # resent copies arrive after every original of their batch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _pick(index, *names: str):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + F.lit(1)).cast("int"))


def _with_resends(df: DataFrame, resent, **changes) -> DataFrame:
    """Repeat the rows where `resent` holds, with small changes, at the end of their batch."""
    copies = F.when(resent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("_copy", F.explode(copies))
    for name, expr in changes.items():
        out = out.withColumn(name, F.when(F.col("_copy") == 1, expr).otherwise(F.col(name)))
    return out.drop("_copy")


def web_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw web events, three days per batch. `duration_ms_kind` is the wire type of the field."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    uid = F.col("user_id").cast("bigint")
    parity = F.pmod(F.col("event_id"), F.lit(2))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    rows = e.select(
        (F.floor(day / F.lit(3)) + F.lit(1)).cast("int").alias("batch_no"),
        F.col("event_id").cast("bigint").alias("line_no"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").alias("event_ts"),
        F.when(F.pmod(F.col("event_id"), F.lit(50)) != 0,
               F.concat(F.lit("u"), uid.cast("string"))).alias("user_id"),
        F.concat(F.lit("session_"),
                 F.lpad((F.pmod(uid, F.lit(8)) + F.lit(1)).cast("string"), 3, "0")).alias("session_id"),
        _pick(F.pmod(uid, F.lit(3)), "web", "ios", "android").alias("platform"),
        _pick(F.pmod(uid, F.lit(3)) * F.lit(2) + parity,
              "1.4.0", "1.5.2", "6.0.1", "6.1.0", "5.1.3", "5.2.0").alias("client_version"),
        _pick(F.pmod(k, F.lit(4)), "home", "search", "checkout", "profile").alias("page"),
        F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "scroll")
        .otherwise("page_view").alias("action"),
        F.round(F.col("value") * F.lit(1000.0)).cast("double").alias("duration_ms"),
        F.when(F.col("event_type") == "error",
               F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("Timeout while loading page "), k.cast("string")))
               .otherwise(F.concat(F.lit("invalid response "), k.cast("string")))).alias("error_message"),
        F.lit("number").alias("duration_ms_kind"),
        (F.pmod(F.col("event_id"), F.lit(50)) == 1).alias("_resent"),
    )
    return _with_resends(rows, F.col("_resent"),
                         line_no=F.col("line_no") + F.lit(RESEND_OFFSET),
                         duration_ms=F.col("duration_ms") + F.lit(7.0)).drop("_resent")


def payments_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw payments from orders, eight months per batch."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, folder, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    joined = (o.join(c, o.o_custkey == c.c_custkey, "left")
              .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    key = F.col("o_orderkey")
    months = (F.year("o_orderdate") - F.lit(1995)) * F.lit(12) + F.month("o_orderdate") - F.lit(1)
    day_ms = F.datediff(F.col("o_orderdate").cast("date"),
                        F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(86_400_000)
    rows = joined.select(
        (F.floor(months / F.lit(8)) + F.lit(1)).cast("int").alias("batch_no"),
        key.alias("line_no"),
        F.concat(F.lit("t"), key.cast("string")).alias("transaction_id"),
        (day_ms + F.pmod(key, F.lit(86400)) * F.lit(1000)).alias("event_ts"),
        F.when(F.col("r_name") == "AMERICA", "MER_US_01").when(F.col("r_name") == "EUROPE", "MER_EU_01")
        .when(F.col("r_name") == "ASIA", "MER_APAC_01").otherwise("MER_OTHER_01").alias("merchant_id"),
        F.when(F.pmod(key, F.lit(50)) != 0,
               F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("user_id"),
        F.round(F.col("o_totalprice") * F.lit(100.0)).cast("double").alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "card")
        .when(F.col("o_orderpriority") == "5-LOW", "wallet").otherwise("ach").alias("payment_method"),
        F.when(F.pmod(key, F.lit(97)) == 0, "reversed")
        .when(F.col("o_orderstatus") == "O", "declined").when(F.col("o_orderstatus") == "P", "pending")
        .when(F.pmod(key, F.lit(7)) == 0, "refunded").otherwise("settled").alias("status"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.lit("card declined by issuer"))
        .when(F.pmod(key, F.lit(5)) == 1,
              F.concat(F.lit("Insufficient funds ERROR "), F.pmod(F.col("o_custkey"), F.lit(9)).cast("string")))
        .alias("error_message"),
        F.when(F.pmod(F.col("o_custkey"), F.lit(10)) == 0, "beta").otherwise("5.2.0").alias("client_version"),
        F.lit("number").alias("amount_cents_kind"),
        (F.pmod(key, F.lit(50)) == 1).alias("_resent"),
    )
    return _with_resends(rows, F.col("_resent"),
                         line_no=F.col("line_no") + F.lit(RESEND_OFFSET),
                         event_ts=F.col("event_ts") + F.lit(1000),
                         amount_cents=F.col("amount_cents") + F.lit(1.0)).drop("_resent")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as log messages: one feed (`source`) per batch, language as segment."""
    d = table(spark, folder, "documents")
    return d.select(
        (F.substring("source", 4, 10).cast("int") + F.lit(1)).alias("batch_no"),
        F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("event_id"),
        F.col("lang"), F.col("text"))
