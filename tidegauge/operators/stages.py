"""Row-level pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in arrival order; missing keys equal each other. The rank filter is
    applied before the shuffle too (partial group limit), so a key with very many copies sends
    one row per task."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedup_keep_earliest(df: DataFrame, key: list[str], ts: str, tie: list[str]) -> DataFrame:
    """Row with the earliest timestamp per key (ties in arrival order)."""
    return dedup_keep_first(df, key, [ts, *tie])


def filter_required(df: DataFrame, *fields: str) -> DataFrame:
    for f in fields:
        df = df.where(F.col(f).isNotNull())
    return df


def filter_range(df: DataFrame, field: str, above: float | None = None,
                 below: float | None = None) -> DataFrame:
    """Strict bounds; a missing value compares false and is dropped."""
    if above is not None:
        df = df.where(F.col(field) > F.lit(above))
    if below is not None:
        df = df.where(F.col(field) < F.lit(below))
    return df


def filter_allowed(df: DataFrame, field: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(field).isin(*allowed))


def filter_equal(df: DataFrame, field: str, value: str) -> DataFrame:
    return df.where(F.col(field) == F.lit(value))
