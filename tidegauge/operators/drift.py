"""Drift statistics of current batches against a frozen baseline.

Each function returns one row per (keys, segment). Text and KS inputs are collapsed to counts
before any join, so a frequent word, message or value costs one row per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import scalars as S
from tidegauge.functions.ordered import prefix_sums
from tidegauge.functions.stats import PSI_BINS, ks_exact, ks_pvalue, psi_of
from tidegauge.operators.baseline import inner_edges

SAMPLE_TEMPLATES = 3


def at_key(table: DataFrame, checkpoint: str, field: str) -> DataFrame:
    """The rows of a baseline table for one checkpoint and field, keyed by segment `_seg`."""
    return (table.where((F.col("checkpoint") == checkpoint) & (F.col("field") == field))
            .drop("checkpoint", "field").withColumnRenamed("segment", "_seg"))


def with_edges(df: DataFrame, numeric: DataFrame, checkpoint: str, field: str, prefix: str) -> DataFrame:
    """Add the segment's inner bin edges as plain columns `<prefix>0..8` (null where the baseline has
    fewer bins or is missing). Needs the `_seg` column."""
    edges = at_key(numeric, checkpoint, field).select(
        "_seg", *[e.alias(f"{prefix}{i}") for i, e in enumerate(inner_edges())])
    return df.join(edges, "_seg", "left")


def edge_counts(field: str, prefix: str) -> dict[str, Column]:
    """Aggregates: how many values reach each inner edge. One comparison per row and edge; bin counts
    are differences of neighbours."""
    x = S.clean_number(field)
    return {f"ge_{prefix}{i}": F.count_if(x >= F.col(f"{prefix}{i}")) for i in range(PSI_BINS - 1)}


def bins_from_edges(total: Column, prefix: str) -> list[Column]:
    reach = [total] + [F.col(f"ge_{prefix}{i}") for i in range(PSI_BINS - 1)] + [F.lit(0)]
    return [reach[i] - reach[i + 1] for i in range(PSI_BINS)]


def psi_score(current: list[Column], total: Column, shares: Column) -> Column:
    """PSI of the counted bins; 0 when the baseline has fewer than two bins (no spread)."""
    return F.when(F.size(shares) < 2, F.lit(0.0)).otherwise(psi_of(shares, F.array(*current), total))


def ordered_stats(df: DataFrame, keys: list[str], field: str, known: DataFrame | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Median and, with the baseline's collapsed values, the two-sample KS test per (keys, _seg), from one sliced
    running count of the collapsed values.

    Between two current values the current step function is constant, so the largest gap lies at a
    current value or just before one. The baseline steps are therefore ranked once per distinct
    (segment, value), however many batches share the segment."""
    seg = [*keys, "_seg"]
    cur = (df.select(*seg, S.clean_number(field).alias("x")).where(F.col("x").isNotNull())
           .groupBy(*seg, "x").agg(F.count(F.lit(1)).alias("n")))
    run = prefix_sums(cur, seg, "x", ["n"])
    pos = F.lit(0.5) * (F.col("all_n") - F.lit(1))
    start = F.col("cum_n") - F.col("n")

    def at(rank):
        return F.max(F.when((start <= rank) & (rank < F.col("cum_n")), F.col("x")))

    aggs = [at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.max("all_n").alias("ks_m")]
    if known is not None:
        ref = at_key(known, checkpoint, field).groupBy("_seg", "x").agg(F.sum("n").alias("n_ref"))
        values = (cur.select("_seg", "x").distinct().withColumn("n_ref", F.lit(0).cast("bigint"))
                  .unionByName(ref).groupBy("_seg", "x").agg(F.sum("n_ref").alias("n_ref")))
        steps = (prefix_sums(values, ["_seg"], "x", ["n_ref"]).where(F.col("all_n_ref") > 0))
        run = run.join(steps, ["_seg", "x"], "left")
        upto = F.col("cum_n_ref") / F.col("all_n_ref")
        before = (F.col("cum_n_ref") - F.col("n_ref")) / F.col("all_n_ref")
        gap = F.greatest(F.abs(F.col("cum_n") / F.col("all_n") - upto), F.abs(start / F.col("all_n") - before))
        aggs += [F.max(gap).alias("ks_d"), F.max("all_n_ref").alias("ks_n")]
    out = run.groupBy(*seg).agg(*aggs).withColumn("median", (F.col("_lo") + F.col("_hi")) / F.lit(2.0)).drop("_lo", "_hi")
    if known is not None:
        # a row a batch and segment, each with a recursion of its own: dealt to all tasks, which by size alone would be one
        out = out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *seg)
        sides = (F.col("ks_d"), F.col("ks_n"), F.col("ks_m"))
        out = out.withColumn("ks_p", F.coalesce(ks_exact(*sides), ks_pvalue(*sides)))
    return out


def oov_stats(df: DataFrame, vocab: DataFrame, keys: list[str], checkpoint: str, field: str) -> DataFrame:
    """Token count and tokens missing from the segment's baseline vocabulary."""
    words = (df.select(*keys, "_seg", F.explode(S.word_tokens(field)).alias("token"))
             .groupBy(*keys, "_seg", "token").agg(F.count(F.lit(1)).alias("n")))
    known = at_key(vocab, checkpoint, field).withColumn("known", F.lit(True))
    joined = words.join(known, ["_seg", "token"], "left")
    return joined.groupBy(*keys, "_seg").agg(
        F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("new_tokens"))


def template_stats(df: DataFrame, templates: DataFrame, keys: list[str], checkpoint: str,
                   field: str) -> DataFrame:
    """Records whose masked template is new, and the smallest `SAMPLE_TEMPLATES` new templates, for the message. Templates are
    whole messages, so rows are shuffled and joined on a 128-bit hash; the text rides along for the sample only."""
    masked = (df.where(F.col(field).isNotNull())
              .select(*keys, "_seg", S.mask_template(field).alias("template"))
              .withColumns(S.text_key("template")).groupBy(*keys, "_seg", "h1", "h2")
              .agg(F.count(F.lit(1)).alias("n"), F.first("template").alias("template")))
    known = at_key(templates, checkpoint, field).withColumns(S.text_key("template")).select("_seg", "h1", "h2")
    fresh = masked.join(known, ["_seg", "h1", "h2"], "left_anti")
    counts = fresh.groupBy(*keys, "_seg").agg(F.sum("n").alias("new_records"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy("template"))
    sample = (fresh.select(*keys, "_seg", "template").withColumn("r", rank)
              .where(F.col("r") <= SAMPLE_TEMPLATES).groupBy(*keys, "_seg")
              .agg(F.sort_array(F.collect_list("template")).alias("new_sample")))
    return counts.join(sample, [*keys, "_seg"], "left")

