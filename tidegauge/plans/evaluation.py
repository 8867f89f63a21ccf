"""End-to-end runs: scenario frames -> stage outputs -> contract results -> alerts -> scores.

Scenario and batch are columns, so all batches of all scenarios of a pipeline form one plan. The
rows and those of them without repeats feed many checks, so each is written once as a stage table,
with the scenarios of a row as bits; rows are repeated per scenario as they are read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import alerts, checks, faults, guard, scoring
from tidegauge.operators.baseline import Baselines, build
from tidegauge.plans import behavior, contracts, payments, web
from tidegauge.session import cut, spread, staged

RUN = ["scenario", "batch_no"]
BASELINE_BATCHES = [1, 2, 3]
N_BATCHES = 10


@dataclass(frozen=True)
class Pipeline:
    """How a pipeline turns raw rows into the frames its checkpoints look at."""

    name: str
    row_id: str
    raw_number: str                       # the untyped numeric field whose text crashes a stage
    stages: tuple[str, ...]
    frames: Callable[..., "Frames"]       # (raw rows, batch keys, how to get the same rows without repeats if these are known)
    dedup: bool = True                    # by row_id; repeats in a batch are dropped

    @property
    def orders(self) -> dict[str, int]:
        return {f"after_{s}": i for i, s in enumerate(self.stages, start=1)}


class Frames(dict):
    """Stage outputs by checkpoint, each built when it is first asked for: a contract that looks at one checkpoint runs no later stage."""

    def __init__(self, **make: Callable[["Frames"], DataFrame]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make[name](self)
        return self[name]


def _web(raw: DataFrame | Callable[[], DataFrame], by: tuple[str, ...], first: Callable[[], DataFrame] | None = None) -> Frames:
    return Frames(
        after_ingest=lambda f: raw() if callable(raw) else raw,
        after_clean=lambda f: web.tidy(first()) if first else staged(web.clean(f["after_ingest"], by), "web-clean"),
        after_enrich=lambda f: web.enrich(f["after_clean"]),
        after_aggregate=lambda f: web.aggregate(f["after_enrich"], by))


def _behavior(raw: DataFrame | Callable[[], DataFrame], by: tuple[str, ...], first: Callable[[], DataFrame] | None = None) -> Frames:
    return Frames(
        after_ingest=lambda f: raw() if callable(raw) else raw,
        after_filter_sessions=lambda f: (behavior.filter_sessions(first(), by) if first
                                         else staged(behavior.filter_sessions(f["after_ingest"], by), "sessions")),
        after_aggregate=lambda f: behavior.aggregate(f["after_filter_sessions"], by))


def _payments(raw: DataFrame | Callable[[], DataFrame], by: tuple[str, ...], first: Callable[[], DataFrame] | None = None) -> Frames:
    return Frames(
        after_ingest=lambda f: raw() if callable(raw) else raw,
        after_clean=lambda f: payments.tidy(first()) if first else staged(payments.clean(f["after_ingest"], by), "payments-clean"),
        after_enrich=lambda f: payments.enrich(f["after_clean"]),
        after_reconcile=lambda f: payments.reconcile(f["after_enrich"], by))


PIPELINES = {
    "web_analytics": Pipeline("web_analytics", "event_id", "duration_ms", web.STAGES, _web),
    "user_behavior": Pipeline("user_behavior", "event_id", "duration_ms", behavior.STAGES, _behavior, dedup=False),
    "payment_processing": Pipeline("payment_processing", "transaction_id", "amount_cents", payments.STAGES, _payments),
}


def learn(raw: DataFrame, pipeline: str, batches: list[int] | None = None) -> Baselines:
    """Profile the learning batches, each batch cleaned on its own."""
    p, known = PIPELINES[pipeline], batches or BASELINE_BATCHES
    frames = p.frames(raw.where(F.col("batch_no").isin(*known)), ("batch_no",))
    return build(frames, contracts.CONTRACTS[pipeline], raw.sparkSession.createDataFrame([(b,) for b in known], "batch_no int"))


class Runs:
    """The rows of all scenarios, each once with its scenarios as bits. Repeated rows are found in the rows themselves, before these are
    repeated per scenario. Both tables are written when they are first asked for."""

    def __init__(self, raw: DataFrame, pipeline: str, fault_list: list[faults.Fault], from_onset: bool) -> None:
        self.raw, self.p, self.faults, self.from_onset = raw, PIPELINES[pipeline], fault_list, from_onset

    @cached_property
    def rows(self) -> DataFrame:
        return staged(faults.with_runs(spread(self.raw), self.faults, self.p.row_id, self.from_onset), "rows")

    @cached_property
    def first(self) -> DataFrame:
        if not self.p.dedup:
            return self.rows
        return staged(faults.first_runs(self.rows, self.faults, self.p.row_id, ["batch_no", self.p.row_id], web.ORDER), "first-rows")

    def frames(self, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Frames:
        def repeated(rows: DataFrame) -> DataFrame:
            return faults.in_runs(only(rows), self.faults, self.p.row_id)
        return self.p.frames(lambda: repeated(self.rows), tuple(RUN), lambda: repeated(self.first))


def scenario_frames(raw: DataFrame, pipeline: str, fault_list: list[faults.Fault], from_onset: bool = False) -> Frames:
    """Stage outputs of every scenario."""
    return Runs(raw, pipeline, fault_list, from_onset).frames()


def run_scenarios(runs: Runs, contract: contracts.Contract, base: Baselines | None) -> DataFrame | None:
    """Results of a contract over all scenarios. A fault breaks one segment, so a checkpoint that counts by that segment column reads of a
    faulty run only the broken segment; what was counted of the others in the clean run is repeated. Whole batches are judged on the
    completed counts, and other checkpoints (the aggregates) read all rows."""
    whole, column = runs.frames(), faults.segment_column(runs.faults, runs.raw)
    split = {cp.name for cp in contract.checkpoints if cp.checks_anything and column is not None and cp.segment_by == column}
    if not split:
        return checks.run_contract(whole, contract, runs.p.orders, RUN, base)
    wide = faults.unlike_clean(runs.first, runs.faults, column) if runs.p.dedup else set()
    narrow = runs.frames(lambda rows: faults.broken_segments(rows, runs.faults, column, wide))
    frames = Frames(**{name: lambda _, name=name: (narrow if name in split else whole)[name] for name in runs.p.orders})
    complete = {name: lambda counted: faults.with_clean_segments(counted, runs.faults, wide) for name in split}
    return checks.run_contract(frames, contract, runs.p.orders, RUN, base, complete=complete)


def crashes(scen: DataFrame, p: Pipeline) -> DataFrame:
    """Batches whose second stage would crash: text where it divides or compares a number."""
    kind = F.col(f"{p.raw_number}_kind") == "text"
    return scen.where(kind).groupBy(*RUN).agg(F.count(F.lit(1)).alias("uncastable")).withColumn("crash_order", F.lit(1))


def scenario_crashes(raw: DataFrame, pipeline: str, fault_list: list[faults.Fault]) -> DataFrame:
    """The batches that crash, without any check."""
    p = PIPELINES[pipeline]
    return faults.with_clean_past(crashes(faults.apply_scenarios(raw, fault_list, p.row_id, from_onset=True), p), fault_list)


def scenario_results(raw: DataFrame, pipeline: str, fault_list: list[faults.Fault], base: Baselines | None,
                     contract: contracts.Contract | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(all check results before the guard acts, batches that crash). A batch is judged by itself, so only batches that a fault may change
    are written and judged per scenario; the results of earlier ones are those of the clean run."""
    p = PIPELINES[pipeline]
    runs = Runs(raw, pipeline, fault_list, from_onset=True)
    results = run_scenarios(runs, contract or contracts.CONTRACTS[pipeline], base)
    crashed = faults.with_clean_past(crashes(runs.frames()["after_ingest"], p), fault_list)
    return (None if results is None else faults.with_clean_past(results, fault_list)), crashed


def guarded(raw: DataFrame, pipeline: str, fault_list: list[faults.Fault], base: Baselines | None,
            contract: contracts.Contract | None = None, mode: str = "enforce") -> DataFrame | None:
    results, crashed = scenario_results(raw, pipeline, fault_list, base, contract)
    return guard.guard(results, mode, RUN, crashed)


def evaluate(spark: SparkSession, raw: DataFrame, pipeline: str = "web_analytics",
             window: int = scoring.WINDOW, base: Baselines | None = None) -> tuple[DataFrame, DataFrame]:
    """(recorded results per system, scenario scores per system) for the three systems: no checks
    (B0), one dtype check (B1) and the contract (ours). B1 is a subset of the contract's first
    checkpoint, so all systems are judged on one pass of results."""
    fault_list = faults.catalog(pipeline)
    p = PIPELINES[pipeline]
    base = base or learn(raw, pipeline).freeze()
    results, crashed = scenario_results(raw, pipeline, fault_list, base)
    results, crashed = cut(results), cut(crashed)
    naive = results.where((F.col("cp_order") == 1) & (F.col("check") == f"schema:{p.raw_number}"))
    recorded = reduce(DataFrame.unionByName, [
        guard.guard(r, "enforce", RUN, crashed).withColumn("system", F.lit(name))
        for name, r in (("B1", naive), ("ours", results))])
    recorded = cut(recorded)
    run = ["system", "scenario"]
    truth = faults.ground_truth(spark, fault_list, N_BATCHES)
    matched = scoring.match(alerts.latest(recorded, run), truth, run, window)
    systems = F.array(*[F.lit(s) for s in ("B0", "B1", "ours")])
    return recorded, scoring.scenarios(matched, truth, systems, run)
