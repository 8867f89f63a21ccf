"""Frozen baselines: what normal looks like per checkpoint, field and segment.

All tables are long and keyed (checkpoint, field, segment); an unsegmented profile uses the
segment `all`. Numeric values are kept whole, collapsed to (value, count); everything is a grouped
aggregate, so one profile never depends on one task seeing a whole segment. A bounded sample is there
for who asks for one; nothing here depends on it."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import scalars as S
from tidegauge.functions.ordered import exact_quantiles, smallest_by_hash
from tidegauge.functions.stats import PSI_BINS
from tidegauge.plans.contracts import Contract
from tidegauge.session import cut

SAMPLE_SEED = "42"
KEY = ["checkpoint", "field", "segment"]
TOP_TEMPLATES = 20


def _segment(segment_by: str | None):
    return S.segment_of(segment_by) if segment_by else F.lit("all")


def _tag(df: DataFrame, checkpoint: str, field: str) -> DataFrame:
    return df.select(F.lit(checkpoint).alias("checkpoint"), F.lit(field).alias("field"), "*")


def numeric_stats(values: DataFrame, seen: DataFrame) -> DataFrame:
    """Count, mean, median and sample deviation per key, from the collapsed values; zeros when there are none. `seen` has every key."""
    mean = values.groupBy(*KEY).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    apart = (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) * F.col("n")
    std = values.join(mean, KEY).groupBy(*KEY).agg(F.first("mean").alias("mean"), F.when(
        F.sum("n") > 1, F.sqrt(F.sum(apart) / (F.sum("n") - 1))).alias("std"))
    median = exact_quantiles(values, KEY, "x", {"median": 0.5}, weight="n")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return seen.join(std, KEY, "left").join(median, KEY, "left").select(*KEY, "sample_count", zero("mean"), zero("median"), zero("std"))


def numeric_sample(df: DataFrame, checkpoint: str, field: str, segment_by: str | None,
                   row_id: str, limit: int) -> DataFrame:
    """At most `limit` values per segment, chosen by a hash of the row id."""
    v = (df.select(_segment(segment_by).alias("segment"), F.col(row_id).cast("string").alias("id"),
                   S.clean_number(field).alias("x"))
         .where(F.col("x").isNotNull())
         .withColumn("h", S.hash32(SAMPLE_SEED, "id")))
    return _tag(smallest_by_hash(v, ["segment"], "h", ["id", "x"], limit).select("segment", "x"),
                checkpoint, field)


def numeric_values(df: DataFrame, checkpoint: str, field: str, segment_by: str | None) -> DataFrame:
    """Every value of a segment with its count."""
    v = df.select(_segment(segment_by).alias("segment"), S.clean_number(field).alias("x")).where(F.col("x").isNotNull())
    return _tag(v.groupBy("segment", "x").agg(F.count(F.lit(1)).alias("n")), checkpoint, field)


def value_bins(values: DataFrame) -> DataFrame:
    """Decile edges of all values (repeated edges removed) and the count in each bin."""
    q = exact_quantiles(values, KEY, "x", {f"q{i}": i / PSI_BINS for i in range(PSI_BINS + 1)}, weight="n")
    edges = q.select(*KEY, F.array_distinct(F.array(*[F.round(f"q{i}", 9) for i in range(PSI_BINS + 1)])).alias("edges"))
    binned = values.join(edges, KEY).withColumn("bin", bin_of(F.col("x"), inner_edges()))
    counts = binned.groupBy(*KEY).agg(*[
        F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"b{i}") for i in range(PSI_BINS)])
    all_bins = F.array(*[F.col(f"b{i}") for i in range(PSI_BINS)])
    n_bins = F.greatest(F.size("edges") - F.lit(1), F.lit(0))
    total = sum((F.col(f"b{i}") for i in range(PSI_BINS)), F.lit(0))
    return edges.join(counts, KEY).select(
        *KEY, "edges", F.slice(all_bins, F.lit(1), n_bins).alias("bin_counts"), total.alias("total")).withColumn(
        "bin_shares", F.transform("bin_counts", lambda c: c / F.col("total"))).drop("total")


def inner_edges():
    """The edges between bins: all but the first and the last."""
    e = F.col("edges")
    return [F.when(F.size(e) > F.lit(i + 2), F.get(e, F.lit(i + 1))) for i in range(PSI_BINS - 1)]


def bin_of(x, inner):
    """Left-closed bin number; the outer bins reach to infinity."""
    return sum((F.coalesce((x >= e).cast("int"), F.lit(0)) for e in inner), F.lit(0))


def vocabulary(df: DataFrame, checkpoint: str, field: str, segment_by: str | None) -> DataFrame:
    tokens = df.select(_segment(segment_by).alias("segment"), F.explode(S.word_tokens(field)).alias("token"))
    return _tag(tokens.distinct(), checkpoint, field)


def templates(df: DataFrame, checkpoint: str, field: str, segment_by: str | None) -> DataFrame:
    """Masked messages with their counts, grouped by a 128-bit hash: whole texts are no shuffle keys."""
    masked = (df.where(F.col(field).isNotNull())
              .select(_segment(segment_by).alias("segment"), S.mask_template(field).alias("template")).withColumns(S.text_key("template")))
    found = masked.groupBy("segment", "h1", "h2").agg(F.first("template").alias("template"), F.count(F.lit(1)).alias("n"))
    return _tag(found.select("segment", "template", "n"), checkpoint, field)


def value_counts(df: DataFrame, checkpoint: str, field: str, segment_by: str | None, numeric: bool = False) -> DataFrame:
    """How many values every segment has, none included."""
    value = S.clean_number(field) if numeric else F.col(field)
    return _tag(df.groupBy(_segment(segment_by).alias("segment")).agg(F.count(value).alias("sample_count")), checkpoint, field)


def daily_counts(df: DataFrame, checkpoint: str, segment_by: str) -> DataFrame:
    """Rows per segment and batch; a missing segment is no segment."""
    rows = df.where(F.col(segment_by).isNotNull()).groupBy(F.col(segment_by).cast("string").alias("segment"), "batch_no")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(checkpoint).alias("checkpoint"), "segment", "batch_no", "n")


def segment_volume(daily: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows per batch for every segment, zero for batches after it was first seen; the median. `batches` lists the batches of the
    learning period."""
    first = daily.groupBy("checkpoint", "segment").agg(F.min("batch_no").alias("first"))
    period = batches.agg(F.collect_set("batch_no").alias("period"))  # one short list
    grid = first.join(F.broadcast(period)).select("checkpoint", "segment", F.explode(
        F.filter("period", lambda b: b >= F.col("first"))).alias("batch_no"))
    full = grid.join(daily, ["checkpoint", "segment", "batch_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("checkpoint", "segment").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("batch_no", "n"))), lambda s: s["n"]).alias("batch_counts"),
        F.percentile("n", 0.5).alias("median"))


@dataclass(frozen=True)
class Baselines:
    """The frozen tables. Any of them may be None when a pipeline profiles no such field."""

    numeric: DataFrame | None = None   # KEY, sample_count, mean, median, std, edges, bin_counts, bin_shares
    values: DataFrame | None = None    # KEY, x, n
    text: DataFrame | None = None      # KEY, sample_count
    vocab: DataFrame | None = None     # KEY, token
    templates: DataFrame | None = None  # KEY, template, n
    volume: DataFrame | None = None    # checkpoint, segment, batch_counts, median
    seen: DataFrame | None = None      # KEY, sample_count of numeric fields
    daily: DataFrame | None = None     # checkpoint, segment, batch_no, n
    batches: DataFrame | None = None   # batch_no: what was learned from

    def freeze(self) -> "Baselines":
        """Materialise every table once; all later passes read the small frozen result."""
        return Baselines(**{k: (cut(v) if v is not None else None) for k, v in vars(self).items()})

    def save(self, folder: str) -> None:
        for name, df in vars(self).items():
            if df is not None:
                df.write.mode("overwrite").parquet(os.path.join(folder, name))

    @staticmethod
    def load(spark: SparkSession, folder: str, names: tuple[str, ...] = (
            "numeric", "values", "text", "vocab", "templates", "volume", "seen", "daily", "batches")) -> "Baselines":
        return Baselines(**{n: spark.read.parquet(os.path.join(folder, n)) for n in names})

    def merge(self, other: "Baselines") -> "Baselines":
        """The baseline of both learning periods, from the two frozen ones: counts add up, word sets unite, and what is no sum (mean,
        deviation, median, edges, usual volume) follows from the collapsed values. No batch is read again. The periods must not
        share a batch."""
        def both(name: str) -> DataFrame | None:
            mine, theirs = getattr(self, name), getattr(other, name)
            return mine if theirs is None else theirs if mine is None else mine.unionByName(theirs)

        def added(name: str, by: list[str], count: str) -> DataFrame | None:
            rows = both(name)
            return None if rows is None else rows.groupBy(*by).agg(F.sum(count).alias(count))

        templates, vocab, batches = both("templates"), both("vocab"), both("batches")
        if templates is not None:
            keyed = templates.withColumns(S.text_key("template")).groupBy(*KEY, "h1", "h2")
            templates = keyed.agg(F.first("template").alias("template"), F.sum("n").alias("n")).drop("h1", "h2")
        return derived(values=added("values", [*KEY, "x"], "n"), seen=added("seen", KEY, "sample_count"),
                       text=added("text", KEY, "sample_count"), vocab=vocab.distinct() if vocab is not None else None, templates=templates,
                       daily=added("daily", ["checkpoint", "segment", "batch_no"], "n"), batches=batches.distinct() if batches is not None else None)


def derived(**counted: DataFrame | None) -> Baselines:
    """Baselines of the counted tables, with what follows from them."""
    values, daily = counted["values"], counted["daily"]
    numeric = numeric_stats(values, counted["seen"]).join(value_bins(values), KEY, "left") if values is not None else None
    volume = segment_volume(daily, counted["batches"]) if daily is not None else None
    return Baselines(numeric=numeric, volume=volume, **counted)


def targets(contract: Contract, *types: str) -> list[tuple[str, str, str | None]]:
    """(checkpoint, field, segment column) of the contract's fields that have a check of one of these types."""
    return [(cp.name, field, cp.segment_by) for cp in contract.checkpoints for field, specs in cp.fields if {s.type for s in specs} & set(types)]


def _all(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def build(frames: dict[str, DataFrame], contract: Contract, batches: DataFrame) -> Baselines:
    """Profile clean frames (checkpoint name -> frame with a batch_no column) for every check of `contract` that compares with a baseline.
    `batches` (batch_no) is the learning period."""
    numeric, text = targets(contract, "unit", "numeric_drift"), targets(contract, "text_drift")
    volume = [cp for cp in contract.checkpoints if cp.check_segment_volume and cp.segment_by]
    return derived(
        values=_all([numeric_values(frames[cp], cp, f, seg) for cp, f, seg in numeric]),
        seen=_all([value_counts(frames[cp], cp, f, seg, numeric=True) for cp, f, seg in numeric]),
        text=_all([value_counts(frames[cp], cp, f, seg) for cp, f, seg in text]),
        vocab=_all([vocabulary(frames[cp], cp, f, seg) for cp, f, seg in text]),
        templates=_all([templates(frames[cp], cp, f, seg) for cp, f, seg in text]),
        daily=_all([daily_counts(frames[cp.name], cp.name, cp.segment_by) for cp in volume]), batches=batches.select("batch_no").distinct())


def profiles(base: Baselines) -> DataFrame:
    """Export rows: percentiles of all values for numeric keys, vocabulary size and the most
    frequent templates for text keys."""
    parts = []
    if base.numeric is not None:
        names = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
        q = exact_quantiles(base.values, KEY, "x", names, weight="n")
        parts.append(base.numeric.join(q, KEY, "left").select(
            *KEY, *names,
            "mean", F.col("std").alias("stddev"), F.lit(None).cast("bigint").alias("cardinality"),
            F.lit(None).cast("string").alias("top_values"), "sample_count"))
    if base.text is not None:
        size = base.vocab.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cardinality"))
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "template"))
        top = (base.templates.withColumn("r", rank).where(F.col("r") <= TOP_TEMPLATES).groupBy(*KEY)
               .agg(F.sort_array(F.collect_list(F.struct("r", "template", "n"))).alias("t"))
               .select(*KEY, F.to_json(F.map_from_entries(F.transform(
                   "t", lambda s: F.struct(s["template"], s["n"])))).alias("top_values")))
        none = F.lit(None).cast("double")
        parts.append(base.text.join(size, KEY, "left").join(top, KEY, "left").select(
            *KEY, *[none.alias(n) for n in ("p0", "p25", "p50", "p75", "p95", "p100", "mean", "stddev")],
            F.coalesce("cardinality", F.lit(0)).alias("cardinality"), "top_values", "sample_count"))
    return _all(parts)
