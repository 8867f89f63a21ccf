"""Fault injection as row transforms, with the ground truth kept beside the data.

A fault touches rows of one segment from its onset batch on. Random faults draw from a hash of
(seed, row id), so a recomputed task breaks exactly the same rows. Several scenarios are applied
in one pass: every row is repeated per scenario and changed by `CASE scenario` expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import scalars as S
from tidegauge.operators.stages import dedup_keep_first

# Message templates no baseline has seen.
NEW_TEMPLATES = (
    "upstream dependency unavailable",
    "rate limit exceeded, retry later",
    "database connection pool exhausted",
)
DRAW_SEED = "123"


@dataclass(frozen=True)
class Fault:
    """One fault scenario. `kind` is the operation, `fault_type` its ground-truth label."""

    scenario: str
    kind: str
    fault_type: str
    segment: str | None = None
    segment_column: str = "client_version"
    field: str | None = None
    onset: int = 4
    factor: float = 1000.0
    rate: float = 0.0
    step: float = 0.08
    suffix: str = "ms"
    value: str | None = None

    @property
    def injection_id(self) -> str:
        if self.kind == "clean":
            return "clean"
        if self.kind == "invalid_enum":
            return f"invalid_enum:{self.field}:{self.segment}:{self.onset}"
        return f"{self.kind}:{self.segment}:{self.onset}"


def hit(f: Fault) -> Column:
    """Rows the fault may touch; a missing segment never matches."""
    return F.coalesce((F.col("batch_no") >= f.onset) & (F.col(f.segment_column) == F.lit(f.segment)), F.lit(False))


def chance(f: Fault, row_id: str) -> Column:
    return S.draw(f"{DRAW_SEED}-{f.kind}", row_id) < F.lit(f.rate)


def drops(f: Fault, row_id: str) -> Column | None:
    """Rows the fault removes."""
    if f.kind == "feed_stops":
        return hit(f)
    if f.kind == "volume_drop":
        return hit(f) & chance(f, row_id)
    return None


def rewrites(f: Fault, row_id: str) -> dict[str, tuple[Column, Column]]:
    """column -> (rows to change, new value)."""
    c = F.col(f.field) if f.field else None
    if f.kind == "unit_change":
        return {f.field: (hit(f), c / F.lit(f.factor))}
    if f.kind == "new_nullable":
        return {f.field: (hit(f) & chance(f, row_id), F.lit(None))}
    if f.kind == "gradual_drift":
        steps = (F.col("batch_no") - F.lit(f.onset) + F.lit(1)).cast("double")
        return {f.field: (hit(f), c * F.pow(F.lit(1 + f.step), steps))}
    if f.kind == "text_change":
        pick = F.pmod(S.hash32(f"{DRAW_SEED}-template", row_id), F.lit(len(NEW_TEMPLATES))) + F.lit(1)
        new = F.element_at(F.array(*[F.lit(t) for t in NEW_TEMPLATES]), pick.cast("int"))
        return {f.field: (hit(f) & c.isNotNull() & chance(f, row_id), new)}
    if f.kind == "invalid_enum":
        return {f.field: (hit(f), F.lit(f.value))}
    if f.kind == "type_change":
        # The wire value becomes text: with a unit suffix no number can be read from it any more;
        # even a bare numeral is text to the stages, so the number is gone for them either way.
        return {f"{f.field}_kind": (hit(f), F.lit("text")), f.field: (hit(f), F.lit(None)),
                f"{f.field}_text": (hit(f), F.concat(c.cast("bigint").cast("string"), F.lit(f.suffix)))}
    return {}


def clean_run(faults: list[Fault]) -> str | None:
    """The scenario that breaks nothing."""
    return next((f.scenario for f in faults if f.kind == "clean"), None)


def _touched(f: Fault) -> Column:
    """Batches a fault may change; one without a number counts as changed."""
    return F.coalesce(F.col("batch_no") >= f.onset, F.lit(True))


def _in_segment(f: Fault, label: Column) -> Column:
    return F.coalesce(label == F.lit(f.segment), F.lit(False))


def segment_column(faults: list[Fault], df: DataFrame) -> str | None:
    """The text column whose segments the faults break, if a clean run is among them, all break segments of that column and none changes
    the column or the batch: then the other segments of a batch are those of the clean run."""
    broken = [f for f in faults if f.kind != "clean"]
    columns = {f.segment_column for f in broken}
    changed = {name for f in broken for name in rewrites(f, "batch_no")}
    if clean_run(faults) is None or len(columns) != 1 or changed & {*columns, "batch_no"}:
        return None
    column = columns.pop()
    return column if dict(df.dtypes).get(column) == "string" else None


def unlike_clean(df: DataFrame, faults: list[Fault], column: str) -> set[str]:
    """Scenarios in which a row of another segment than the broken one is there and not in the clean run, or the other way round: where a
    fault removes the first of equal rows, the next may be in another segment. One number a scenario comes to the driver."""
    clean = _has(next(i for i, f in enumerate(faults) if f.kind == "clean"))
    odd = [F.max((_touched(f) & ~_in_segment(f, S.segment_of(column)) & (_has(i) != clean)).cast("int")).alias(f.scenario)
           for i, f in enumerate(faults) if f.kind != "clean"]
    return {name for name, found in df.agg(*odd).first().asDict().items() if found} if odd else set()


def broken_segments(df: DataFrame, faults: list[Fault], column: str, wide: set[str]) -> DataFrame:
    """Of the runs of a row those where a fault may change its segment, and the clean run; runs in `wide` keep all their rows."""
    keep = F.lit(0).cast("bigint")
    for i, f in enumerate(faults):
        kept = F.lit(True) if f.kind == "clean" or f.scenario in wide else _in_segment(f, S.segment_of(column))
        keep = keep + F.when(kept, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn("_runs", F.col("_runs").bitwiseAND(keep)).where(F.col("_runs") != 0)


def with_clean_segments(df: DataFrame, faults: list[Fault], wide: set[str], label: str = "_seg") -> DataFrame:
    """What was counted per segment of `broken_segments`, completed: the other segments of a batch are those of the clean run."""
    clean = clean_run(faults)
    shared = [F.when(_touched(f) & ~_in_segment(f, F.col(label)), F.lit(f.scenario)) for f in faults
              if f.kind != "clean" and f.scenario not in wide]
    names = F.when(F.col("scenario") == clean, F.array_compact(F.array(F.lit(clean), *shared))).otherwise(F.array("scenario"))
    return df.withColumn("scenario", F.explode(names))


def with_clean_past(df: DataFrame, faults: list[Fault]) -> DataFrame:
    """Rows of scenario runs that hold only the batches from their onset on, completed: before its onset a run is the clean run, whose
    rows are repeated under its name. A narrow step over what was computed per batch; nothing is computed twice."""
    clean = clean_run(faults)
    if clean is None:
        return df
    shared = [F.when(~_touched(f), F.lit(f.scenario)) for f in faults if f.kind != "clean"]
    names = F.when(F.col("scenario") == clean, F.array_compact(F.array(F.lit(clean), *shared))).otherwise(F.array("scenario"))
    return df.withColumn("scenario", F.explode(names))


def _with_text(df: DataFrame, faults: list[Fault]) -> DataFrame:
    for name in sorted({f"{f.field}_text" for f in faults if f.kind == "type_change"}):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def apply_scenarios(df: DataFrame, faults: list[Fault], row_id: str, from_onset: bool = False) -> DataFrame:
    """`df` once per scenario, in a single pass over the source, with a `scenario` column. With `from_onset` a faulty scenario gets only
    the batches it may change, if a clean run is among the scenarios (`with_clean_past` completes what is computed from them)."""
    return in_runs(with_runs(df, faults, row_id, from_onset), faults, row_id)


def with_runs(df: DataFrame, faults: list[Fault], row_id: str, from_onset: bool = False) -> DataFrame:
    """Every row once, with the scenarios it appears in as `_runs`: what is worth writing, as `in_runs` repeats rows in a narrow step."""
    return _with_text(df, faults).withColumn("_runs", _runs(faults, row_id, from_onset)).where(F.col("_runs") != 0)


def _has(i: int) -> Column:
    return F.col("_runs").bitwiseAND(F.lit(1 << i)) != 0


def _runs(faults: list[Fault], row_id: str, from_onset: bool) -> Column:
    """The scenarios a row appears in, as bits in the order of `faults`."""
    part, bits = from_onset and clean_run(faults) is not None, F.lit(0).cast("bigint")
    for i, f in enumerate(faults):
        gone = drops(f, row_id)
        there = _touched(f) if part and f.kind != "clean" else F.lit(True)
        bits = bits + F.when(there if gone is None else there & ~gone, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return bits


def in_runs(df: DataFrame, faults: list[Fault], row_id: str) -> DataFrame:
    """Every row once per scenario of its `_runs`, changed as the scenario says."""
    names = [F.when(_has(i), F.lit(f.scenario)) for i, f in enumerate(faults)]
    out = df.withColumn("scenario", F.explode(F.array(*names))).where(F.col("scenario").isNotNull()).drop("_runs")  # all in codegen
    edits: dict[str, list[tuple[Column, Column]]] = {}
    for f in faults:
        for name, (cond, value) in rewrites(f, row_id).items():
            edits.setdefault(name, []).append(((F.col("scenario") == F.lit(f.scenario)) & cond, value))
    new = {}
    for name, cases in edits.items():
        expr = F
        for cond, value in cases:
            expr = expr.when(cond, value)
        new[name] = expr.otherwise(F.col(name)).cast(out.schema[name].dataType)
    return out.withColumns(new) if new else out


def first_per_scenario(df: DataFrame, faults: list[Fault], row_id: str, key: list[str], order: list[str], from_onset: bool = False) -> DataFrame:
    """`apply_scenarios`, and of its rows the first per scenario and `key`."""
    return in_runs(first_runs(with_runs(df, faults, row_id, from_onset), faults, row_id, key, order), faults, row_id)


def first_runs(known: DataFrame, faults: list[Fault], row_id: str, key: list[str], order: list[str]) -> DataFrame:
    """Of rows `with_runs` the first per scenario and `key`. Faults remove rows but change no key, so the rows are ranked
    before they are repeated: of equal keys that are in the same runs one is kept, and a row stays in the runs that no earlier row of its
    key is in. What is shuffled and sorted is the input once, not once per scenario."""
    changed = {name for f in faults for name in rewrites(f, row_id)}
    if changed & {*key, *order}:
        raise ValueError(f"faults change the key or the order of rows: {sorted(changed & {*key, *order})}")
    once = dedup_keep_first(known, [*key, "_runs"], order)
    earlier = F.bit_or("_runs").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("_runs").bitwiseAND(F.bitwise_not(F.coalesce(earlier, F.lit(0).cast("bigint"))))
    return once.withColumn("_runs", left).where(F.col("_runs") != 0)


def ground_truth(spark: SparkSession, faults: list[Fault], n_batches: int) -> DataFrame:
    """One row per scenario: what was broken, where and from which batch."""
    rows = [(f.scenario, f.injection_id, f.fault_type, f.field, f.segment,
             n_batches + 1 if f.kind == "clean" else f.onset) for f in faults]
    return spark.createDataFrame(
        rows, "scenario string, injection_id string, fault_type string, field string, segment string, onset_batch int")


def catalog(pipeline: str, onset: int = 4) -> list[Fault]:
    """The fault scenarios of a pipeline."""
    web = dict(onset=onset)
    pay = dict(onset=onset, segment_column="payment_method")
    clean = Fault("clean", "clean", "clean")
    if pipeline == "payment_processing":
        return [
            Fault("unit_change_card", "unit_change", "unit_change", "card", field="amount_cents", factor=100.0, **pay),
            Fault("type_change_card", "type_change", "type_change", "card", field="amount_cents", suffix="", **pay),
            Fault("new_nullable_wallet", "new_nullable", "new_nullable", "wallet", field="user_id", rate=0.3, **pay),
            Fault("invalid_status_ach", "invalid_enum", "type_change", "ach", field="status", value="chargeback", **pay),
            Fault("volume_drop_card", "volume_drop", "volume_drop", "card", rate=0.65, **pay),
            Fault("feed_stops_wallet", "feed_stops", "feed_stops", "wallet", **pay),
            clean]
    unit = Fault("unit_change_android", "unit_change", "unit_change", "5.2.0", field="duration_ms", **web)
    nullable = Fault("new_nullable_web", "new_nullable", "new_nullable", "1.5.2", field="user_id", rate=0.3, **web)
    text_type = Fault("type_change_android", "type_change", "type_change", "5.1.3", field="duration_ms", **web)
    if pipeline == "user_behavior":
        return [
            unit, nullable, text_type,
            Fault("action_flood_ios", "volume_drop", "volume_drop", "6.1.0", rate=0.7, **web),
            Fault("feed_stops_ios", "feed_stops", "feed_stops", "6.0.1", **web), clean]
    return [
        unit, Fault("feed_stops_ios", "feed_stops", "feed_stops", "6.1.0", **web), nullable, text_type,
        Fault("gradual_drift_ios", "gradual_drift", "gradual_drift", "6.0.1", field="duration_ms", **web),
        Fault("text_change_web", "text_change", "text_change", "1.4.0", field="error_message", rate=0.6, **web),
        Fault("volume_drop_android", "volume_drop", "volume_drop", "5.2.0", rate=0.6, **web), clean]


# --- finding-driven faults over a whole frame ---

def scale(df: DataFrame, field: str, factor: float = 1000.0) -> DataFrame:
    return df.withColumn(field, F.col(field) * F.lit(factor))


def drop_column(df: DataFrame, field: str) -> DataFrame:
    return df.drop(field)


def cast_text(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn(field, F.col(field).cast("string"))


def row_positions(df: DataFrame, order: list[str], out: str = "_pos") -> DataFrame:
    """Zero-based arrival position over all batches. Each batch is cut into slices of line numbers,
    slice sizes give the offsets, and rows are only ranked inside their slice."""
    batch, line = order
    sliced = df.withColumn("_slice", F.floor(F.col(line) / F.lit(65536)))
    sizes = sliced.groupBy(batch, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    per_batch = sizes.groupBy(batch).agg(F.sum("_c").alias("_bc"))
    starts = per_batch.withColumn("_b0", F.sum("_bc").over(Window.orderBy(batch)) - F.col("_bc"))
    total = F.max(F.col("_b0") + F.col("_bc")).over(Window.partitionBy(F.lit(1)))
    starts = starts.withColumn("_total", total).select(batch, "_b0", "_total")
    offsets = (sizes.withColumn("_s0", F.sum("_c").over(Window.partitionBy(batch).orderBy("_slice")) - F.col("_c"))
               .join(starts, batch).select(batch, "_slice", (F.col("_b0") + F.col("_s0")).alias("_o"), "_total"))
    rank = F.row_number().over(Window.partitionBy(batch, "_slice").orderBy(line))
    return (sliced.join(offsets, [batch, "_slice"]).withColumn(out, F.col("_o") + rank - F.lit(1))
            .drop("_slice", "_o"))


def null_half(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """Every second row (the even positions) loses the field."""
    p = row_positions(df, order)
    return p.withColumn(field, F.when(F.col("_pos") % 2 == 1, F.col(field))).drop("_pos", "_total")


def cut_80(df: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first fifth of the rows, at least one."""
    p = row_positions(df, order)
    return p.where(F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("_total") / F.lit(5)))).drop("_pos", "_total")


def duplicate_rows(df: DataFrame, order: list[str], times: int = 100) -> DataFrame:
    """The first row again, `times` more copies."""
    first = df.orderBy(*order).limit(1)
    copies = first.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_i")
    return df.unionByName(copies)


# Finding kind -> (case name stem, fault applied); other kinds give no case.
CASE_KINDS = (
    ("unit_conversion", "test_unit_conversion_", "inj_scale"),
    ("required_field", "test_missing_field_", "inj_drop_column"),
    ("row_filter", "test_row_filter", "inj_cut_80"),
    ("group_key_drops_nulls", "test_null_in_key_", "inj_null_half"),
    ("dedup_key", "test_duplicate_key_", "inj_duplicate_rows"),
)


def cases_for_findings(findings: DataFrame) -> DataFrame:
    """Confirmed findings -> one fault case each. `findings` has kind, field and status."""
    stem, fault = F, F
    for kind, s, f in CASE_KINDS:
        stem = stem.when(F.col("kind") == kind, F.lit(s))
        fault = fault.when(F.col("kind") == kind, F.lit(f))
    out = findings.where(F.col("status") == "confirmed").withColumn("_stem", stem).withColumn("fault", fault)
    name = F.when(F.col("kind") == "row_filter", F.col("_stem")).otherwise(
        F.concat("_stem", F.coalesce("field", F.lit("unknown"))))
    return out.where(F.col("fault").isNotNull()).withColumn("case_name", name).drop("_stem")
