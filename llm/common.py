"""What several operators share: null-safe ids and training folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text, as `id` and `text`. A missing id becomes the smallest long, so that such rows
    survive joins; `unkeyed` turns it back."""
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def unkeyed(column: str = "id") -> Column:
    return F.when(F.col(column) != F.lit(NULL_ID), F.col(column))


def bounded_sample(rows: DataFrame, key: str | list[str], most: int) -> DataFrame:
    """About `most` rows with a column `h`: those whose hash of `key` falls into that share of the range; all rows if there are fewer.
    One count, no sort and no limit, so nothing goes through one task. `key` must tell rows apart (the id, or id and text where ids
    repeat): then the number of rows is within a few deviations of `most`; rows equal in `key` come or stay together."""
    share = min(1.0, most / max(1, rows.count()))
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("h", F.xxhash64(*keys)).where(F.col("h") <= F.lit(min((1 << 63) - 1, int((1 << 64) * share) - (1 << 63))))


def one_each(rows: DataFrame) -> DataFrame:
    """One row (id, text, and what else there is) of every id: that of the least text hash. Bounds the rows of a sample by its ids,
    however many documents share one."""
    others = [c for c in rows.columns if c != "id"]
    least = F.min(F.struct(F.xxhash64("text").alias("_h"), *others)).alias("_row")
    return rows.groupBy("id").agg(least).select("id", *[F.col("_row")[c].alias(c) for c in others])


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
