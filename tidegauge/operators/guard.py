"""Guard modes over whole runs: which batches stop where, and what still flows.

All batches are checked in one plan, so `enforce` is a mask on the results and an anti join on the
data instead of an exception inside one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("off", "observe", "enforce")
MODE_SETTING = "spark.tidegauge.guard.mode"
BLOCKING = ("fail",)  # statuses that stop a batch, unless the caller has another policy


def configured_mode(spark: SparkSession) -> str:
    """The mode that the session is configured with; a batch is stopped unless it says otherwise."""
    mode = spark.conf.get(MODE_SETTING, "enforce")
    if mode not in MODES:
        raise ValueError(f"unknown guard mode {mode!r}")
    return mode


def blocked_at(results: DataFrame, keys: list[str], crashed: DataFrame | None = None,
               enforce: bool = True, blocking: tuple[str, ...] = BLOCKING) -> DataFrame:
    """Per batch: the first checkpoint order with a blocking status (`blocked_order`, enforce only) and the
    stage order after which the batch crashed (`crash_order`). Batches without either have no row."""
    block = F.min(F.when(F.col("status").isin(*blocking), F.col("cp_order"))) if enforce else F.lit(None).cast("int")
    out = results.groupBy(*keys).agg(block.alias("blocked_order"))
    if crashed is not None:
        out = out.join(crashed.select(*keys, "crash_order"), keys, "full")
    else:
        out = out.withColumn("crash_order", F.lit(None).cast("int"))
    return out.where(F.col("blocked_order").isNotNull() | F.col("crash_order").isNotNull())


def reachable_results(results: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """Results the batch really produced: nothing after the checkpoint that stopped it."""
    last = F.least("blocked_order", "crash_order")
    return (results.join(stops.select(*keys, last.alias("_last")), keys, "left")
            .where(F.col("_last").isNull() | (F.col("cp_order") <= F.col("_last"))).drop("_last"))


def guard(results: DataFrame | None, mode: str | None, keys: list[str], crashed: DataFrame | None = None,
          blocking: tuple[str, ...] = BLOCKING) -> DataFrame | None:
    """Recorded results under a guard mode (None: the session's). `off` records nothing."""
    if mode is None and results is not None:
        mode = configured_mode(results.sparkSession)
    if mode not in MODES:
        raise ValueError(f"unknown guard mode {mode!r}")
    if mode == "off" or results is None:
        return None
    return reachable_results(results, blocked_at(results, keys, crashed, mode == "enforce", blocking), keys)


def passed_data(df: DataFrame, stops: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Rows of batches that were not blocked at or before checkpoint `order`."""
    return df.join(stops.where(F.col("blocked_order") <= order).select(*keys), keys, "left_anti")


def quarantined_data(df: DataFrame, stops: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Rows diverted by the guard at or before checkpoint `order`."""
    return df.join(stops.where(F.col("blocked_order") <= order).select(*keys), keys, "left_semi")


def batch_outcome(results: DataFrame, keys: list[str], crashed: DataFrame | None = None,
                  crash_stage: str | None = None) -> DataFrame:
    """One row per batch: blocked_at, crashed_at, ok. A crash counts only if no earlier checkpoint
    blocked the batch."""
    fail = F.col("status") == "fail"
    out = results.groupBy(*keys).agg(
        F.min(F.when(fail, F.col("cp_order"))).alias("bo"),
        F.min_by(F.when(fail, F.col("checkpoint")), F.when(fail, F.col("cp_order"))).alias("blocked_at"))
    if crashed is not None:
        out = out.join(crashed.select(*keys, "crash_order"), keys, "left")
    else:
        out = out.withColumn("crash_order", F.lit(None).cast("int"))
    crash = F.col("crash_order").isNotNull() & (F.col("bo").isNull() | (F.col("bo") > F.col("crash_order")))
    return out.select(*keys, F.when(~crash, F.col("blocked_at")).alias("blocked_at"),
                      F.when(crash, F.lit(crash_stage)).alias("crashed_at"),
                      (~crash & F.col("bo").isNull()).alias("ok"))


def batch_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Passed / warned / failed counts per batch, whether it is blocked, and its failing checks
    (at most one name per contract check)."""
    st = F.col("status")
    return results.groupBy(*keys).agg(
        F.count_if(st == "pass").alias("passed"), F.count_if(st == "warn").alias("warned"),
        F.count_if(st == "fail").alias("failed"), (F.count_if(st == "fail") > 0).alias("blocked"),
        F.array_join(F.array_sort(F.collect_set(F.when(st == "fail", F.col("check")))), ",").alias("failing_checks"))
