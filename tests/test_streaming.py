"""Arriving batches and the alert stream: any split, order and restart gives what one run over everything gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import checks, guard, lineage
from tidegauge.plans.contracts import Checkpoint, Contract, Spec
from tidegauge.sources import jsonl
from tidegauge.streaming import alerts, arrival, batches

CONTRACT = Contract("p", (Checkpoint("a", "seg", min_rows=5, fields=(("f", (Spec("range", min=0.0, max=10.0),)),)),
                          Checkpoint("b", "seg", fields=(("f", (Spec("nulls", max_null_rate=0.0),)),))))
ORDERS, KEYS = {"a": 1, "b": 2}, ["batch_no"]


def judge(lines, expected):
    rows = lines.select("batch_no", jsonl.text("$.seg").alias("seg"), jsonl.number("$.f").alias("f"))
    return checks.run_contract({"a": rows, "b": rows}, CONTRACT, ORDERS, KEYS, None, expected), rows


def put(folder, batch, part, value, n=40):
    os.makedirs(f"{folder}/batch_{batch:04d}.jsonl", exist_ok=True)
    with open(f"{folder}/batch_{batch:04d}.jsonl/part-{part}", "w") as f:
        f.writelines(json.dumps({"seg": "v", "f": value}) + "\n" for _ in range(n))


def tables(chain, spark):
    read = lambda name: sorted(map(str, chain.table(spark, name).collect()))
    return {n: read(n) for n in ("results", "quarantine", "events")}


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)], "batch_no int, files long")


def test_split_shuffled_and_silent_batches_equal_one_run(spark, tmp_path, manifest):
    """Batch 2 is out of range, batch 4 sends nothing, batch 3 is there before batch 1 is whole; the second run is a restart."""
    later = [(1, 1, 2.0), (2, 1, 99.0), (5, 0, 4.0)]
    first = [(1, 0, 1.0), (2, 0, 99.0), (3, 0, 3.0), (3, 1, 3.0)]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    chain = arrival.Chain(judge, manifest, f"{one}-out", f"{one}-cp", lateness=1)
    split = arrival.Chain(judge, manifest, f"{two}-out", f"{two}-cp", lateness=9)
    for b, part, v in first + later:
        put(one, b, part, v)
    chain.follow(batches.stream_text(spark, one, 100))
    got = tables(chain, spark)
    results = chain.table(spark, "results")
    assert {(r.batch_no, r.status) for r in results.where("check = 'volume'").collect()} == {(1, "pass"), (2, "pass"), (3, "pass"), (4, "fail"), (5, "pass")}
    assert {r.batch_no for r in results.where("checkpoint = 'b'").collect()} == {1, 3, 5}  # the guard stopped batch 2
    assert {r.batch_no for r in chain.table(spark, "quarantine").select("batch_no").distinct().collect()} == {2}
    assert {(r.batch_no, r.event) for r in chain.table(spark, "events").collect()} == {(2, "opened"), (3, "closed"), (4, "opened"), (5, "closed")}

    for b, part, v in first:
        put(two, b, part, v)
    split.follow(batches.stream_text(spark, two, 3))
    assert split.table(spark, "judged").count() == 0  # batch 1 is not whole, so batch 3 waits
    for b, part, v in later:
        put(two, b, part, v)
    split.follow(batches.stream_text(spark, two, 2))
    assert sorted(r.batch_no for r in split.table(spark, "judged").collect()) == [1, 2, 3]
    split = arrival.Chain(judge, manifest.where("batch_no <> 4"), split.out, split.checkpoint, lateness=9)
    put(two, 1, 7, 1000.0)  # a file of a batch that was judged
    split.follow(batches.stream_text(spark, two, 1))
    assert [os.path.basename(r._path) for r in split.table(spark, "late").collect()] == ["part-7"]
    without = lambda t: [r for r in t if "batch_no=4" not in r]
    mine = tables(split, spark)
    assert mine["results"] == without(got["results"]) and mine["quarantine"] == got["quarantine"]
    assert mine["events"] == [e for e in got["events"] if "batch_no=2" in e or "batch_no=3" in e]


def test_guard_off_records_nothing(spark, tmp_path, manifest):
    chain = arrival.Chain(judge, manifest.where("batch_no = 5"), str(tmp_path / "out"), str(tmp_path / "cp"), mode="off")
    put(str(tmp_path / "in"), 5, 0, 99.0)
    chain.follow(batches.stream_text(spark, str(tmp_path / "in"), 9))
    assert chain.table(spark, "judged").count() == 1 and not os.path.exists(f"{chain.out}/results")
    assert "off" in guard.MODES


def outcome(b, f, status, message="m", seg=None):
    return ("p", "a", 1, 1, b, f"c:{f}", f, seg, status, message)


COLUMNS = ("pipeline string, checkpoint string, cp_order int, check_seq int, batch_no int, check string, field string, segment string, "
           "status string, message string")


@pytest.mark.parametrize("arrivals", [[[1, 2, 3, 4, 5, 6, 7]], [[2, 1], [4], [3, 5], [7, 6]], [[2], [1], [3], [5, 2], [4, 1], [6], [7]]])
def test_alerts_of_late_and_repeated_batches(spark, tmp_path, arrivals):
    """Within the lateness any order gives the events of one run in order; a batch that was taken changes nothing when it comes again."""
    per = {1: "pass", 2: "fail", 3: "warn", 4: "pass", 5: "fail", 6: "fail", 7: "pass"}
    rows = {b: [outcome(b, "f", s, f"m{b // 3}"), outcome(b, "g", "fail" if b == 6 else "pass", seg="v")] for b, s in per.items()}
    everything = spark.createDataFrame([r for b in per for r in rows[b]], COLUMNS)
    want = sorted(map(str, alerts.transitions(everything)[0].collect()))
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in arrivals:
        spark.createDataFrame([r for b in part for r in rows[b]], COLUMNS).repartition(1).write.mode("append").parquet(folder)
        alerts.follow(spark.readStream.schema(everything.schema).parquet(folder), out, cp, lateness=2)
    alerts.finish(spark, out)
    assert sorted(map(str, alerts.events(spark, out).collect())) == want
    if len(arrivals) == 7:
        assert {r.batch_no for r in spark.read.parquet(f"{out}/late").collect()} <= {1, 2} and want


def test_traces_and_outputs_on_a_graph_with_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("c", "o1"), ("d", "e"), ("e", "e"), ("e", "o2"), ("x", "y"), ("y", "z"), ("z", "o1"), ("q", "q")]
    links += [("many", f"w{k}") for k in range(70)]
    ids = {i for e in links for i in e}
    outs = {i for i in ids if i[0] in "ow"}
    nodes = spark.createDataFrame([("p", i, "output" if i in outs else "field", i.upper()) for i in ids] + [("r", "a", "field", "A")],
                                  "pipeline string, id string, type string, label string")
    edges = spark.createDataFrame([("p", s, t, "produces" if t in outs else "derives", "f", 1) for s, t in links * 2],
                                  "pipeline string, source string, target string, type string, file string, line int")
    asked = spark.createDataFrame([("p", i.upper()) for i in ids - outs] + [("p", "NONE"), ("r", "A")], "pipeline string, field string")

    def back(i):
        way = [i]
        while True:
            prior = sorted(s for s, t in links if t == way[-1] and s != t)
            if not prior or prior[0] in way:
                return way
            way.append(prior[0])

    got = {(r.pipeline, r.field): [s.node_id for s in r.lineage] for r in lineage.traces(nodes, edges, asked).collect()}
    assert got == {("p", i.upper()): back(i) for i in ids - outs} | {("r", "A"): ["a"]}
    reach = {i: set() for i in ids}
    for _ in ids:
        for s, t in links:
            reach[s] |= {t} | reach[t]
    want = {("p", i.upper(), o.upper()) for i in ids - outs for o in reach[i] & outs}
    assert {tuple(r) for r in lineage.affected_outputs(nodes, edges).collect()} == want
    assert {r.field for r in lineage.affected_outputs(nodes, edges, asked.where("field = 'X'")).collect()} == {"X"}
