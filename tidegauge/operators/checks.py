"""Contract checks as one fused aggregation per checkpoint.

All counting checks of a checkpoint (row counts, nulls, ranges, wire types, disallowed values, PSI
bins) are aggregate expressions of a single `groupBy(keys, segment)`. Checks that need their own
shape (median, KS, words, templates, distinct values) are computed on collapsed counts and joined
to that small result, and everything is unpivoted to one row per check and segment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tidegauge.functions import scalars as S
from tidegauge.operators import drift
from tidegauge.operators.baseline import Baselines
from tidegauge.plans.contracts import Checkpoint, Contract, Spec
from tidegauge.session import cut

MIN_SAMPLE = 30
KS_MIN_STATISTIC = 0.1
KEY_SET_SHOWN = 5

RESULT_FIELDS = [
    ("check_seq", "int"), ("check", "string"), ("check_type", "string"), ("field", "string"),
    ("segment", "string"), ("status", "string"), ("message", "string"), ("metric", "double"),
    ("threshold", "double"), ("baseline", "double"), ("rows", "bigint"), ("detail", "string"),
]
RESULT_COLUMNS = ["pipeline", "checkpoint", "cp_order"] + [n for n, _ in RESULT_FIELDS]

# What a check measures before it is graded. `kind` picks the wording, `ok` is the verdict if the
# row can be judged at all, `no_base` marks a missing baseline, `few_of` names the rows counted
# against the minimum sample (null: no minimum), `fixed` overrides the grading.
MEASURE_FIELDS = [
    ("check_seq", "int"), ("kind", "string"), ("check", "string"), ("check_type", "string"), ("field", "string"),
    ("segment", "string"), ("rows", "bigint"), ("metric", "double"), ("threshold", "double"),
    ("baseline", "double"), ("ok", "boolean"), ("no_base", "boolean"), ("few_of", "string"),
    ("extra", "string"), ("detail", "string"), ("fixed", "string"),
]

NO_BASELINE = "no baseline for this field/segment yet"


def _measure(**values) -> Column:
    """One measured row; anything not given is null."""
    return F.struct(*[
        (values[n] if isinstance(values.get(n), Column) else F.lit(values.get(n))).cast(t).alias(n)
        for n, t in MEASURE_FIELDS])


def _graded(df: DataFrame, keys: list[str]) -> DataFrame:
    """Status and message of measured rows, one CASE over the check kinds."""
    kind, metric, extra = F.col("kind"), F.col("metric"), F.col("extra")
    rows = F.col("rows").cast("string")
    no_base = F.coalesce("no_base", F.lit(False))
    few = F.col("few_of").isNotNull() & (F.col("rows") < MIN_SAMPLE)
    judged = ~no_base & ~few
    said = (F.when(kind == "null_rate", F.concat(F.lit("null rate "), S.percent(metric), extra))
            .when(kind == "share", F.concat(S.percent(metric), extra))
            .when(kind == "score", F.concat(extra, F.lit(" score "), S.fixed(metric, 3), F.lit(
                " indicates the distribution has drifted from baseline")))
            .when(kind == "unit", F.concat(
                extra, F.lit(" moved by a factor of "),
                F.when(metric == F.lit(float("inf")), "inf").otherwise(S.fixed(F.pow(F.lit(10.0), metric), 1)),
                F.lit("x versus baseline: looks like a unit change, not ordinary drift")))
            .when(kind == "count", F.concat(metric.cast("bigint").cast("string"), extra))
            .when((kind == "segment_volume") & (F.col("rows") == 0),
                  F.concat(F.lit("'"), F.col("segment"), F.lit("' silent this batch")))
            .when(kind == "segment_volume", F.concat(
                F.lit("'"), F.col("segment"), F.lit("' volume is "), S.percent(metric, 0), F.lit(" of its usual "),
                S.fixed(F.col("baseline"), 0), F.lit(" rows")))
            .otherwise(extra))
    few_text = F.concat(F.lit("only "), rows, F.lit(" "), F.col("few_of"),
                        F.lit(f", below the minimum of {MIN_SAMPLE}"))
    bad = (F.when(F.col("check").startswith("key_set:") | F.col("check").startswith("template_drift:"), "warn")
           .otherwise("fail"))
    status = (F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(~judged, "insufficient_data")
              .when(F.col("ok"), "pass").otherwise(bad))
    message = (F.when(F.col("fixed").isNotNull(), F.coalesce("extra", F.lit(""))).when(no_base, NO_BASELINE)
               .when(few, few_text).when(F.col("ok"), "").otherwise(said))
    shown = F.when(judged & (metric != F.lit(float("inf"))), metric)
    return df.select(
        *keys, "check_seq", "check", "check_type", "field", "segment", status.alias("status"),
        message.alias("message"), shown.alias("metric"), "threshold", "baseline", "rows",
        F.when(judged, F.col("detail")).alias("detail"))


def unexpected_values(df: DataFrame, keys: list[str], field: str, allowed: tuple[str, ...]) -> DataFrame:
    """Every value outside the allowed set with its count, as rows; the check's message shows the first `KEY_SET_SHOWN`."""
    v = F.col(field).cast("string")
    return df.where(v.isNotNull() & ~v.isin(*allowed)).groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


class _Compiler:
    """Collects the aggregates, side results and measured rows of one checkpoint."""

    def __init__(self, df: DataFrame, cp: Checkpoint, keys: list[str], base: Baselines | None,
                 complete: Callable[[DataFrame], DataFrame] | None = None):
        self.complete = complete or (lambda counted: counted)  # counts per (keys, _seg) that `df` leaves out
        self.cp, self.keys, self.base = cp, keys, base or Baselines()
        self.segmented = bool(cp.segment_by and cp.segment_by in df.columns)
        self.df = df.withColumn("_seg", S.segment_of(cp.segment_by) if self.segmented else F.lit("all"))
        self.plain = self.df                    # without the edge columns
        self.segment = F.col("_seg") if self.segmented else F.lit(None).cast("string")
        self.aggs: dict[str, Column] = {"n_rows": F.count(F.lit(1))}
        self.totals: set[str] = {"n_rows"}
        self.metrics: dict[str, Column] = {}
        self.side: list[DataFrame] = []         # joined on (keys, _seg)
        self.batch_side: list[DataFrame] = []   # joined on keys
        self.base_side: list[DataFrame] = []    # joined on _seg
        self.rows: list[Column] = []            # per segment
        self.batch_rows: list[Column] = []      # once per batch
        self.ordered: dict[str, bool] = {}      # field -> KS wanted
        self.seq = 0
        self.fused: DataFrame | None = None
        self.shared = cp.check_segment_volume or cp.min_rows is not None or cp.max_rows is not None

    def next(self) -> int:
        self.seq += 1
        return self.seq

    def has(self, field: str) -> bool:
        return field in self.df.columns

    def total(self, name: str) -> Column:
        self.totals.add(name)
        return F.col(f"t_{name}")

    def metric(self, seq: int, expr: Column) -> Column:
        """Name a score so that it is computed once."""
        self.metrics[f"m_{seq}"] = expr
        return F.col(f"m_{seq}")

    def missing(self, name: str, check_type: str, field: str, status: str = "error") -> None:
        self.batch_rows.append(_measure(check_seq=self.next(), check=name, check_type=check_type, field=field,
                                        fixed=status, extra=f"'{field}' is missing from this batch"))

    def unjudged(self, name: str, check_type: str, field: str, n: Column) -> None:
        self.rows.append(_measure(check_seq=self.next(), check=name, check_type=check_type, field=field,
                                  segment=self.segment, rows=n, no_base=True))

    # --- once per batch ---
    def volume(self) -> None:
        lo, hi = self.cp.min_rows, self.cp.max_rows
        n = self.total("n_rows")
        ok = (n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True))
        self.batch_rows.append(_measure(
            check_seq=self.next(), kind="count", check="volume", check_type="volume", rows=n, metric=n,
            threshold=lo, ok=ok, extra=f" rows, expected between {lo} and {hi}"))

    def schema(self, field: str, dtype: str | None) -> None:
        name = f"schema:{field}"
        if not self.has(field):
            return self.missing(name, "schema", field, "fail")
        common = dict(check_seq=self.next(), check=name, check_type="schema", field=field)
        if dtype is None:
            self.batch_rows.append(_measure(ok=True, **common))
            return
        actual = self.metric(self.seq, self._dtype(field))
        kinds = ("int", "float") if dtype == "numeric" else (dtype,)
        ok = reduce(lambda a, b: a | b, [actual.startswith(k) for k in kinds])
        text = F.concat(F.lit(f"'{field}' is "), actual, F.lit(f", expected {dtype}"))
        self.batch_rows.append(_measure(rows=self.total("n_rows"), detail=actual, ok=ok, extra=text, **common))

    def _dtype(self, field: str) -> Column:
        """Column type a batch shows: text anywhere, or nothing but missing values, is `object`."""
        kind = f"{field}_kind"
        if not isinstance(self.df.schema[field].dataType, NumericType):
            return F.lit("object")
        self.aggs[f"num_{field}"] = F.count(field)
        self.aggs[f"frac_{field}"] = F.count_if(F.col(field) != F.floor(field))
        num, frac = self.total(f"num_{field}"), self.total(f"frac_{field}")
        text = F.lit(False)
        if self.has(kind):
            self.aggs[f"text_{field}"] = F.count_if(F.col(kind) == "text")
            text = self.total(f"text_{field}") > 0
        return (F.when(text | (num == 0), "object")
                .when((frac > 0) | (num < self.total("n_rows")), "float64").otherwise("int64"))

    def key_set(self, field: str, allowed: tuple[str, ...]) -> None:
        name = f"key_set:{field}"
        if not self.has(field):
            return self.missing(name, "schema", field)
        odd = F.col(field).isNotNull() & ~F.col(field).cast("string").isin(*allowed)
        self.aggs[f"odd_{field}"] = F.count_if(odd)
        values = self.complete(unexpected_values(self.df, [*self.keys, "_seg"], field, allowed))
        values = values.select(*self.keys, F.col("value").alias("v")).distinct()
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy("v"))
        shown = (values.withColumn("r", rank).where(F.col("r") <= KEY_SET_SHOWN).groupBy(*self.keys)
                 .agg(F.array_join(F.sort_array(F.collect_list("v")), ", ").alias(f"odd_shown_{field}")))
        self.batch_side.append(shown)
        n = self.total(f"odd_{field}")
        self.batch_rows.append(_measure(
            check_seq=self.next(), check=name, check_type="schema", field=field, rows=self.total("n_rows"),
            metric=n, ok=n == 0, extra=F.concat(F.lit("unexpected values: "), F.col(f"odd_shown_{field}"))))

    def cardinality(self, field: str, max_distinct: int) -> None:
        name = f"cardinality:{field}"
        if not self.has(field):
            return self.missing(name, "schema", field)
        values = self.complete(self.df.groupBy(*self.keys, "_seg", F.col(field).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
        self.batch_side.append(values.groupBy(*self.keys).agg(F.count_distinct("_v").alias(f"distinct_{field}")))
        d = F.col(f"distinct_{field}")
        self.batch_rows.append(_measure(
            check_seq=self.next(), kind="count", check=name, check_type="schema", field=field, metric=d,
            threshold=max_distinct, ok=d <= max_distinct,
            extra=f" distinct values, expected at most {max_distinct}"))

    # --- per segment ---
    def nulls(self, field: str, limit: float) -> None:
        name = f"null_rate:{field}"
        if not self.has(field):
            return self.missing(name, "nulls", field)
        self.aggs[f"null_{field}"] = F.count_if(self._missing(field))
        rate = self.metric(self.next(), F.col(f"null_{field}") / F.col("n_rows"))
        self.rows.append(_measure(
            check_seq=self.seq, kind="null_rate", check=name, check_type="nulls", field=field, segment=self.segment,
            rows=F.col("n_rows"), metric=rate, threshold=limit, ok=rate <= limit, few_of="rows",
            extra=f" exceeds the {limit:.1%} limit"))

    def _missing(self, field: str) -> Column:
        numeric = isinstance(self.df.schema[field].dataType, NumericType)
        absent = F.col(field).isNull() | (F.isnan(field) if numeric else F.lit(False))
        if not self.has(f"{field}_kind"):
            return absent
        return absent & (F.coalesce(f"{field}_kind", F.lit("")) != "text")

    def _count(self, field: str) -> Column:
        self.aggs[f"val_{field}"] = F.count(S.clean_number(field))
        return F.col(f"val_{field}")

    def range(self, field: str, spec: Spec) -> None:
        name = f"range:{field}"
        if not self.has(field):
            return self.missing(name, "range", field)
        v = S.clean_number(field)
        below = v < spec.min if spec.min is not None else F.lit(False)
        above = v > spec.max if spec.max is not None else F.lit(False)
        n, seq = self._count(field), self.next()
        self.aggs[f"out_{seq}"] = F.count_if(below | above)
        rate = self.metric(seq, F.col(f"out_{seq}") / F.when(n > 0, n))
        row = self.unless_text(field, name, "range", seq, _measure(
            check_seq=seq, kind="share", check=name, check_type="range", field=field, segment=self.segment, rows=n,
            metric=rate, threshold=spec.max_violation_rate, ok=rate <= spec.max_violation_rate,
            few_of="non-null rows", extra=f" of values fall outside [{spec.min}, {spec.max}]"))
        self.rows.append(row)

    def unless_text(self, field: str, name: str, check_type: str, seq: int, row: Column) -> Column:
        """`row`, unless the batch holds text where the check needs numbers: then the check cannot run, which is one `error` row
        for the whole batch, and everything else still reports."""
        if self.has(f"{field}_kind"):
            text = F.col(f"{field}_kind") == "text"
        elif not isinstance(self.df.schema[field].dataType, NumericType):
            text = S.uncastable(field)
        else:
            return row
        self.aggs[f"text_{field}"] = F.count_if(text)
        n = self.total(f"text_{field}")
        self.batch_rows.append(F.when(n > 0, _measure(
            check_seq=seq, check=name, check_type=check_type, fixed="error",
            extra=F.concat(F.lit("check cannot run: "), n.cast("string"), F.lit(" values are no numbers")))))
        return F.when(n == 0, row)

    def _numeric_base(self, field: str) -> str:
        """Join the numeric baseline of `field` (once) and return its column prefix."""
        prefix = f"base_{field}_"
        if self.base.numeric is None:
            return ""
        if not any(prefix + "mean" in d.columns for d in self.base_side):
            cols = ["mean", "median", "sample_count", "bin_shares"]
            self.base_side.append(drift.at_key(self.base.numeric, self.cp.name, field)
                                  .select("_seg", *[F.col(c).alias(prefix + c) for c in cols]))
        return prefix

    def _ordered(self, field: str, ks: bool) -> None:
        """Ask for the median and optionally the KS test of a field; both share one pass."""
        self.ordered[field] = self.ordered.get(field, False) or ks

    def unit(self, field: str, stat: str, limit: float) -> None:
        name = f"unit:{field}"
        if not self.has(field):
            return self.missing(name, "unit", field)
        n, prefix = self._count(field), self._numeric_base(field)
        if not prefix:
            return self.unjudged(name, "unit", field, n)
        if stat == "mean":
            self.aggs[f"mean_{field}"] = F.avg(S.clean_number(field))
        else:
            self._ordered(field, ks=False)
        current, ref = F.col(f"{stat}_{field}"), F.col(prefix + stat)
        ratio = self.metric(self.next(), F.when(
            (current <= 0) | (ref <= 0),
            F.when(current != ref, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(F.log10(current / ref)))
        self.rows.append(self.unless_text(field, name, "unit", self.seq, _measure(
            check_seq=self.seq, kind="unit", check=name, check_type="unit", field=field, segment=self.segment, rows=n,
            metric=ratio, threshold=limit, baseline=ref, ok=F.abs(ratio) <= limit, few_of="rows", extra=stat,
            no_base=F.col(prefix + "sample_count").isNull())))

    def numeric_drift(self, field: str, spec: Spec) -> None:
        if not self.has(field):
            self.missing(f"psi:{field}", "numeric_drift", field)
            return self.missing(f"ks:{field}", "numeric_drift", field)
        n, prefix = self._count(field), self._numeric_base(field)
        if not prefix:
            self.unjudged(f"psi:{field}", "numeric_drift", field, n)
            return self.unjudged(f"ks:{field}", "numeric_drift", field, n)
        common = dict(kind="score", check_type="numeric_drift", field=field, segment=self.segment, rows=n,
                      few_of="rows", no_base=F.col(prefix + "sample_count").isNull())
        self._ordered(field, ks=True)
        edge = f"edge_{field}_"
        self.df = drift.with_edges(self.df, self.base.numeric, self.cp.name, field, edge)
        self.aggs.update(drift.edge_counts(field, edge))
        psi = self.metric(self.next(), drift.psi_score(
            drift.bins_from_edges(n, edge), n, F.col(prefix + "bin_shares")))
        self.rows.append(self.unless_text(field, f"psi:{field}", "numeric_drift", self.seq, _measure(
            check_seq=self.seq, check=f"psi:{field}", metric=psi, threshold=spec.psi_threshold, ok=psi <= spec.psi_threshold,
            extra="PSI", **common)))
        d, p = F.col(f"ks_d_{field}"), F.col(f"ks_p_{field}")
        drifted = (p < spec.ks_alpha) & (d >= KS_MIN_STATISTIC)
        seq = self.next()
        self.rows.append(self.unless_text(field, f"ks:{field}", "numeric_drift", seq, _measure(
            check_seq=seq, check=f"ks:{field}", metric=d, threshold=spec.ks_alpha, ok=~drifted, extra="KS", **common)))

    def text_drift(self, field: str, spec: Spec) -> None:
        if not self.has(field):
            self.missing(f"oov_rate:{field}", "text_drift", field)
            return self.missing(f"template_drift:{field}", "text_drift", field)
        self.aggs[f"txt_{field}"] = F.count(field)
        n = F.col(f"txt_{field}")
        if self.base.text is None:
            self.unjudged(f"oov_rate:{field}", "text_drift", field, n)
            return self.unjudged(f"template_drift:{field}", "text_drift", field, n)
        self.base_side.append(drift.at_key(self.base.text, self.cp.name, field)
                              .select("_seg", F.col("sample_count").alias(f"text_base_{field}")))
        common = dict(kind="share", check_type="text_drift", field=field, segment=self.segment, rows=n,
                      few_of="rows", no_base=F.col(f"text_base_{field}").isNull())

        oov = drift.oov_stats(self.df, self.base.vocab, self.keys, self.cp.name, field)
        self.side.append(oov.select(*self.keys, "_seg", F.col("tokens").alias(f"tokens_{field}"),
                                    F.col("new_tokens").alias(f"new_tokens_{field}")))
        rate = self.metric(self.next(), F.coalesce(F.col(f"new_tokens_{field}") / F.col(f"tokens_{field}"), F.lit(0.0)))
        self.rows.append(_measure(check_seq=self.seq, check=f"oov_rate:{field}", metric=rate,
                                  threshold=spec.oov_threshold, ok=rate <= spec.oov_threshold,
                                  extra=" of words are new versus the baseline vocabulary", **common))

        tpl = drift.template_stats(self.df, self.base.templates, self.keys, self.cp.name, field)
        self.side.append(tpl.select(*self.keys, "_seg", F.col("new_records").alias(f"new_records_{field}"),
                                    F.col("new_sample").alias(f"new_sample_{field}")))
        share = self.metric(self.next(), F.coalesce(F.col(f"new_records_{field}"), F.lit(0)) / F.when(n > 0, n))
        shown = F.concat(F.lit(" of records match a template never seen in the baseline, e.g. ['"),
                         F.array_join(f"new_sample_{field}", "', '"), F.lit("']"))
        self.rows.append(_measure(check_seq=self.seq, check=f"template_drift:{field}", metric=share,
                                  threshold=spec.template_threshold, ok=share <= spec.template_threshold,
                                  detail=F.array_join(f"new_sample_{field}", " | "), extra=shown, **common))

    def crashed(self, field: str, spec: Spec, error: Exception) -> None:
        self.batch_rows.append(_measure(
            check_seq=self.next(), check=f"{spec.type}:{field}", check_type=spec.type, fixed="error",
            extra=f"check crashed: {type(error).__name__}: {error}"))

    def field_check(self, field: str, spec: Spec) -> None:
        if spec.type == "schema" and spec.allowed is not None:
            self.key_set(field, spec.allowed)
        elif spec.type == "schema" and spec.max_distinct is not None:
            self.cardinality(field, spec.max_distinct)
        elif spec.type == "schema":
            self.schema(field, spec.dtype)
        elif spec.type == "nulls":
            self.nulls(field, spec.max_null_rate or 0.0)
        elif spec.type == "range":
            self.range(field, spec)
        elif spec.type == "unit":
            self.unit(field, spec.baseline_stat, spec.log_ratio_threshold or 0.3)
        elif spec.type == "numeric_drift":
            self.numeric_drift(field, spec)
        elif spec.type == "text_drift":
            self.text_drift(field, spec)

    def counted(self) -> DataFrame:
        """The one fused aggregation per (keys, segment). Where a volume check also looks at it, it is written once: a row a batch and
        segment, instead of another scan."""
        if self.fused is None:
            out = self.df.groupBy(*self.keys, "_seg").agg(*[c.alias(n) for n, c in self.aggs.items()])
            self.fused = self.complete(cut(out) if self.shared else out)
        return self.fused

    def stats(self) -> DataFrame:
        """The wide row per (keys, segment): the fused aggregation plus the side results."""
        out = self.counted()
        if self.batch_rows or any(n != "n_rows" for n in self.totals):
            totals = out.groupBy(*self.keys).agg(*[F.sum(n).alias(f"t_{n}") for n in sorted(self.totals)], F.min("_seg").alias("_one"))
            out = out.join(totals, self.keys).withColumn("_first", F.col("_seg") == F.col("_one"))
        for field, ks in self.ordered.items():
            found = drift.ordered_stats(self.plain, self.keys, field, self.base.values if ks else None, self.cp.name)
            names = ["median"] + (["ks_d", "ks_p"] if ks else [])
            self.side.append(found.select(*self.keys, "_seg", *[F.col(c).alias(f"{c}_{field}") for c in names]))
        for s in self.base_side:
            out = out.join(s, "_seg", "left")
        for s in self.side:
            out = out.join(self.complete(s), [*self.keys, "_seg"], "left")
        for s in self.batch_side:
            out = out.join(s, self.keys, "left")
        return out.select("*", *[c.alias(n) for n, c in self.metrics.items()])

    def measured(self) -> DataFrame | None:
        built = list(self.rows) + [F.when(F.col("_first"), r) for r in self.batch_rows]
        if not built:
            return None
        return (self.stats().select(*self.keys, F.explode(F.array(*built)).alias("r"))
                .where(F.col("r").isNotNull()).select(*self.keys, "r.*"))


def numbered_batches(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """An expected-batch list for batches that are numbered with a fixed step."""
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("batch_no"))


def silent_volume(absent: DataFrame, cp: Checkpoint, keys: list[str], seq: int) -> DataFrame:
    """The volume check of expected batches without a row."""
    lo, hi = cp.min_rows, cp.max_rows
    row = _measure(check_seq=seq, kind="count", check="volume", check_type="volume", rows=0, metric=0, threshold=lo,
                   ok=(lo is None or lo <= 0) and (hi is None or hi >= 0), extra=f" rows, expected between {lo} and {hi}")
    return absent.select(*keys, row.alias("r")).select(*keys, "r.*")


def segment_volume(counts: DataFrame, cp: Checkpoint, keys: list[str], base: Baselines | None, seq: int,
                   batches: DataFrame, segmented: bool) -> DataFrame:
    """One measured row per batch and segment the baseline knows, present or not: the output asked for. Segments are dealt to as many
    buckets as shuffles have partitions and every batch visits each, so the pairing is an equi-join. `counts`: keys, _seg, n_rows."""
    common = dict(check_seq=seq, kind="segment_volume", check="segment_volume", check_type="volume")

    def for_each(found: DataFrame, **what) -> DataFrame:
        return found.select(*keys, _measure(**what, **common).alias("r")).select(*keys, "r.*")

    no_base = dict(fixed="insufficient_data", extra="no segment-volume baseline yet")
    if base is None or base.volume is None:
        return for_each(batches, **no_base)
    known = base.volume.where(F.col("checkpoint") == cp.name)
    any_known = known.select(F.col("checkpoint").alias("_cp")).distinct()
    unknown = for_each(batches.withColumn("_cp", F.lit(cp.name)).join(any_known, "_cp", "left_anti").drop("_cp"), **no_base)
    if not segmented:
        told = batches.withColumn("_cp", F.lit(cp.name)).join(any_known, "_cp", "left_semi").drop("_cp")
        return for_each(told, fixed="error", extra="no segment column to count by").unionByName(unknown)
    buckets = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.where(F.col("median") > 0).select(
        F.col("segment").alias("_seg"), F.col("median").alias("usual"), F.pmod(F.hash("segment"), F.lit(buckets)).alias("_bucket"))
    visits = batches.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    full = (visits.join(known, "_bucket").drop("_bucket").join(counts.select(*keys, "_seg", F.col("n_rows").alias("current")), [*keys, "_seg"], "left")
            .withColumn("current", F.coalesce("current", F.lit(0))))
    share = F.col("current") / F.col("usual")
    return for_each(full, segment=F.col("_seg"), rows=F.col("current"), metric=share, threshold=cp.min_share_of_baseline,
                    baseline=F.col("usual"), ok=share >= cp.min_share_of_baseline).unionByName(unknown)


def _run_checkpoint(df: DataFrame, pipeline: str, cp: Checkpoint, order: int, keys: list[str], base: Baselines | None,
                    expected: DataFrame | None, complete: Callable[[DataFrame], DataFrame] | None = None,
                    ) -> tuple[DataFrame | None, DataFrame | None]:
    """(results, batches seen or expected, where the checkpoint has counted them)."""
    c = _Compiler(df, cp, keys, base, complete)
    volume_seq = segment_seq = None
    if cp.min_rows is not None or cp.max_rows is not None:
        c.volume()
        volume_seq = c.seq
    if cp.check_segment_volume:
        segment_seq = c.next()
    for field, specs in cp.fields:
        for spec in specs:
            try:
                c.field_check(field, spec)
            except Exception as error:  # noqa: BLE001 - a check that cannot be built is recorded, not fatal
                c.crashed(field, spec, error)
    parts, batches = [c.measured()], None
    if c.shared:
        seen = c.counted().select(*keys).distinct()
        absent = expected.select(*keys).distinct().join(seen, keys, "left_anti") if expected is not None else None
        batches = seen if absent is None else seen.unionByName(absent)
        if volume_seq is not None and absent is not None:
            parts.append(silent_volume(absent, cp, keys, volume_seq))
        if segment_seq is not None:
            parts.append(segment_volume(c.counted(), cp, keys, base, segment_seq, batches, c.segmented))
    parts = [p for p in parts if p is not None]
    if not parts:
        return None, batches
    out = _graded(reduce(DataFrame.unionByName, parts), keys)
    return out.select(*keys, F.lit(pipeline).alias("pipeline"), F.lit(cp.name).alias("checkpoint"),
                      F.lit(order).alias("cp_order"), *[n for n, _ in RESULT_FIELDS]), batches


def run_checkpoint(df: DataFrame, pipeline: str, cp: Checkpoint, order: int, keys: list[str],
                   base: Baselines | None = None, expected: DataFrame | None = None) -> DataFrame | None:
    """All results of one checkpoint over every batch in `df` (None when nothing is checked). The volume checks also judge the batches of
    the list `expected` (keys) that have no row; nothing is concluded from gaps in batch numbers."""
    return _run_checkpoint(df, pipeline, cp, order, keys, base, expected)[0]


def run_contract(frames: dict[str, DataFrame], contract: Contract, orders: dict[str, int], keys: list[str],
                 base: Baselines | None = None, expected: DataFrame | None = None,
                 complete: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame | None:
    """Results of a whole contract; `frames` maps checkpoint names to stage outputs and `orders`
    gives each checkpoint its place in the pipeline. A batch that an earlier checkpoint has counted is expected at the later ones.
    Where a frame leaves out segments that are known from others, `complete` maps its checkpoint to a function that adds them to what was
    counted per keys and segment (`_seg`)."""
    parts = []
    for cp in (c for c in contract.checkpoints if c.checks_anything):
        found, batches = _run_checkpoint(frames[cp.name], contract.pipeline, cp, orders[cp.name], keys, base, expected, (complete or {}).get(cp.name))
        parts.append(found)
        expected = batches if batches is not None else expected
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None
