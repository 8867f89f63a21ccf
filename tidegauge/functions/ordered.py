"""Exact order statistics without gathering a group in one task.

Values are first collapsed to (group, value, weight). A monotone bucket number then cuts every
group into slices, and a slice of very many values is cut again at values of its own: slice totals
give each part its offset, and ranks inside a part come from a window over that part alone. All
steps are exact; a group holding a third of all rows is spread over as many tasks as it has parts,
wherever its values lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.scalars import as_col

SLICES_PER_OCTAVE = 64
_CENTRE = 2_000 * SLICES_PER_OCTAVE
SLICE_VALUES, SHARE, PARTS = 1 << 16, 4096, 256  # a slice of more values, and of more than a SHARE-th of all, is cut into about PARTS


def order_slice(value: Column | str) -> Column:
    """Bucket number that never decreases with the value: log2 scale, sign aware. Depends on the
    value alone, so every branch and every retry cuts a group the same way."""
    v = as_col(value).cast("double")
    edge = F.lit(float(_CENTRE - 1))  # infinities share the outermost slices
    scale = F.greatest(F.least(F.log2(F.abs(v)) * F.lit(float(SLICES_PER_OCTAVE)), edge), -edge)
    level = F.coalesce(F.floor(scale).cast("bigint"), F.lit(0).cast("bigint"))
    return (F.when(v > 0, F.lit(_CENTRE) + level)
            .when(v < 0, -(F.lit(_CENTRE) + level))
            .otherwise(F.lit(0).cast("bigint")))


def at_or_below(cuts: Column, value: Column) -> Column:
    """How many of the ascending `cuts` (up to a few times PARTS) lie at or below the value: bisection inside the row. 0 where the
    array is missing."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((4 * PARTS).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0))
    return F.coalesce(found, F.lit(0))


def in_parts(df: DataFrame, keys: list[str], value: str, most: int = SLICE_VALUES, parts: int = PARTS) -> DataFrame:
    """Adds `_slice` and `_part`, which together never decrease with the value inside a group. `df` holds one row per (keys, value).
    Slices of more than `most` values and of more than a `SHARE`-th of all rows are cut at those of their values whose hash falls into a
    share that leaves about `parts` of them: cuts follow the values however close they lie, and are the same in every branch and every
    retry. Fewer than `SHARE` slices are cut, so about `SHARE * parts` cuts (8 MB) at any input size are broadcast; a slice left whole
    is below a `SHARE`-th of the input."""
    sliced = df.withColumn("_slice", order_slice(value))
    at = [*keys, "_slice"]
    sizes = sliced.groupBy(*at).agg(F.count(F.lit(1)).alias("_d"))
    least = (sizes.agg(F.greatest(F.lit(most), F.sum("_d") / F.lit(SHARE)).alias("_least")).withColumn("_all", F.lit(1)))
    heavy = (sizes.where(F.col("_d") > most).withColumn("_all", F.lit(1)).join(F.broadcast(least), "_all")
             .where(F.col("_d") > F.col("_least")).select(*at, "_d"))
    share = F.ceil(F.col("_d") / F.lit(parts)).cast("bigint")
    cuts = (sliced.select(*at, F.col(value).alias("_cut")).join(F.broadcast(heavy), at).where(F.pmod(F.xxhash64("_cut"), share) == 0)
            .groupBy(*at).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")))
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(at_or_below(F.col("_cuts"), F.col(value)))
    return sliced.join(F.broadcast(cuts), at, "left").withColumn("_part", part).drop("_cuts")


def prefix_sums(df: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Running totals `cum_<w>` (rows with a value <= this one) and group totals `all_<w>`.
    `df` holds one row per (keys, value)."""
    sliced = in_parts(df, keys, value)
    by_slice = sliced.groupBy(*keys, "_slice", "_part").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    ordered = Window.partitionBy(*keys).orderBy("_slice", "_part")
    offsets = by_slice.select(
        *keys, "_slice", "_part",
        *[(F.sum(f"_s_{w}").over(ordered) - F.col(f"_s_{w}")).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(Window.partitionBy(*keys)).alias(f"all_{w}") for w in weights])
    inside = (Window.partitionBy(*keys, "_slice", "_part").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = sliced.join(offsets, [*keys, "_slice", "_part"])
    return joined.select(
        *keys, value, *weights,
        *[(F.col(f"_o_{w}") + F.sum(w).over(inside)).alias(f"cum_{w}") for w in weights],
        *[f"all_{w}" for w in weights])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    weight: str | None = None, few_values: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per group: one row per key with a column per entry of
    `probs` (name -> probability). Missing values are ignored; a group without values has no row.
    `weight` names a count column when `df` is already collapsed. `few_values` says that the values' domain bounds what a slice can hold
    (such as whole milliseconds up to a limit), so that none needs to be cut."""
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("_v"))
               .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_w")))
    counted = counted.withColumns({"_slice": order_slice("_v"), "_part": F.lit(0)}) if few_values else in_parts(counted, keys, "_v")
    by_slice = counted.groupBy(*keys, "_slice", "_part").agg(F.sum("_w").alias("_sw"))
    ordered = Window.partitionBy(*keys).orderBy("_slice", "_part")
    placed = by_slice.select(
        *keys, "_slice", "_part", "_sw",
        (F.sum("_sw").over(ordered) - F.col("_sw")).alias("_before"),
        F.sum("_sw").over(Window.partitionBy(*keys)).alias("_n"))

    position = {name: F.lit(float(p)) * (F.col("_n") - F.lit(1)) for name, p in probs.items()}
    low = {name: F.floor(pos).cast("bigint") for name, pos in position.items()}
    high = {name: F.ceil(pos).cast("bigint") for name, pos in position.items()}

    def holds(rank: Column, before: str, width: str) -> Column:
        return (F.col(before) <= rank) & (rank < F.col(before) + F.col(width))

    wanted = reduce(lambda a, b: a | b,
                    [holds(r, "_before", "_sw") for n in probs for r in (low[n], high[n])])
    hits = placed.where(wanted).drop("_sw")
    inside = Window.partitionBy(*keys, "_slice", "_part").orderBy("_v")
    ranked = counted.join(hits, [*keys, "_slice", "_part"]).withColumn(
        "_at", F.col("_before") + F.sum("_w").over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w"))
    picks = []
    for name in probs:
        picks += [F.max(F.when(holds(low[name], "_at", "_w"), F.col("_v"))).alias(f"_lo_{name}"),
                  F.max(F.when(holds(high[name], "_at", "_w"), F.col("_v"))).alias(f"_hi_{name}")]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    return found.select(*keys, *[
        F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise(
            F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (position[n] - low[n])).alias(n) for n in probs])


def smallest_by_hash(df: DataFrame, keys: list[str], hash_col: str, tie: list[str],
                     limit: int) -> DataFrame:
    """Exactly the `limit` rows of each group with the smallest 32-bit hash. A histogram over the
    top 16 hash bits finds the cut-off, so only about `limit` rows per group reach the window."""
    sliced = df.withColumn("_slice", F.shiftright(F.col(hash_col), 16))
    by_slice = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    ordered = Window.partitionBy(*keys).orderBy("_slice")
    keep = (by_slice.withColumn("_before", F.sum("_c").over(ordered) - F.col("_c"))
            .where(F.col("_before") < limit).select(*keys, "_slice"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col, *tie))
    return (sliced.join(keep, [*keys, "_slice"]).withColumn("_r", rank)
            .where(F.col("_r") <= limit).drop("_r", "_slice"))
