"""The reachability index against a walk in plain Python: random graphs with cycles, long paths, closed paths, unknown nodes."""

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tidegauge.operators import lineage, reachability
from tidegauge.plans import graphs


def walk(links):
    """{(pipeline, start): nodes reached}, the start left out."""
    after = {}
    for p, s, t in links:
        after.setdefault((p, s), set()).add(t)
    out = {}
    for p, s in after:
        seen, todo = set(), [s]
        while todo:
            for t in after.get((p, todo.pop()), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        out[p, s] = seen - {s}
    return {k: v for k, v in out.items() if v}


def random_links(seed, nodes, links):
    r = random.Random(seed)
    return [(p, f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for p in ("a", "b") for _ in range(links)]


PATH = [("p", f"n{k:03}", f"n{k + 1:03}") for k in range(40)]
GRAPHS = {
    "sparse": random_links(1, 30, 25), "dense": random_links(2, 12, 40), "path": PATH,
    "path with ways back and ahead": PATH + [("p", "n030", "n010"), ("p", "n005", "n035"), ("p", "n020", "m"), ("p", "m", "n025")],
    "ring": PATH + [("p", "n040", "n000")], "two rings and a bridge": [
        ("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "x", "y"), ("p", "y", "x"), ("p", "c", "x"), ("p", "q", "q")],
    "layers": [("p", f"s{k}", f"t{k % 7}") for k in range(30)] + [("p", f"t{k}", f"u{k % 2}") for k in range(7)] + [("p", "u1", "v")]}


@pytest.mark.parametrize("name", GRAPHS)
def test_labels_equal_a_walk(spark, monkeypatch, name):
    monkeypatch.setattr(reachability, "CHUNK", 8)
    links, told = GRAPHS[name], walk(GRAPHS[name])
    index = reachability.build(spark.createDataFrame(links + links[:3], "pipeline string, source string, target string"))
    known = reachability.labels(index)
    found = {}
    for r in reachability.nodes_of(index, known).collect():
        assert r.node not in found.setdefault((r.pipeline, r.start), set())
        found[r.pipeline, r.start].add(r.node)
    assert found == told
    ids = sorted({(p, n) for p, s, t in links for n in (s, t)})
    nodes = spark.createDataFrame(ids + ids[:1], "pipeline string, id string")
    got = {(r.pipeline, r.start): (r.nodes, r.fives)
           for r in reachability.counts(index, known, nodes, fives=F.col("id").endswith("5")).collect()}
    assert got == {k: (len(v), sum(n.endswith("5") for n in v)) for k, v in told.items()}


def test_a_path_has_one_label_a_start(spark):
    index = reachability.build(spark.createDataFrame(PATH, "pipeline string, source string, target string"))
    assert index.exits.count() == 0 and reachability.labels(index).count() == len(PATH)


def test_asked_starts_and_pairs(spark):
    links = GRAPHS["path with ways back and ahead"]
    index = reachability.build(spark.createDataFrame(links, "pipeline string, source string, target string"))
    starts = spark.createDataFrame([("p", "n038"), ("p", "n038"), ("p", "nobody"), (None, None)], "pipeline string, start string")
    assert {(r.start, r.node) for r in reachability.nodes_of(index, reachability.labels(index, starts)).collect()} == {
        ("n038", "n039"), ("n038", "n040")}
    pairs = [("p", "n025", "n012"), ("p", "n036", "n012"), ("p", "m", "n010"), ("p", "n003", "n003"), ("p", "n001", "nobody")]
    got = reachability.reaches(index, spark.createDataFrame(pairs, "pipeline string, start string, node string")).collect()
    assert {(r.start, r.node) for r in got} == {("n025", "n012"), ("m", "n010")}


def test_empty_graph_and_unknown_nodes(spark):
    none = reachability.build(spark.createDataFrame([], "pipeline string, source string, target string"))
    assert reachability.labels(none).count() == 0 and reachability.nodes_of(none, reachability.labels(none)).count() == 0
    index = reachability.build(spark.createDataFrame(PATH[:2], "pipeline string, source string, target string"))
    nodes = spark.createDataFrame([("p", "n002")], "pipeline string, id string")  # only one node is catalogued
    got = {(r.start, r.nodes) for r in reachability.counts(index, reachability.labels(index), nodes).collect()}
    assert got == {("n000", 1), ("n001", 1)}


@pytest.mark.parametrize("turn", [False, True])
@pytest.mark.parametrize("name", GRAPHS)
def test_counts_of_all_starts_equal_a_walk_both_ways(spark, monkeypatch, name, turn):
    monkeypatch.setattr(reachability, "CHUNK", 8)
    monkeypatch.setattr(reachability, "GATHERED", 0 if turn else 1 << 22)
    links = [(p, t, s) for p, s, t in GRAPHS[name]] if turn else GRAPHS[name]
    ids = sorted({(p, n) for p, s, t in links for n in (s, t)})[1:]  # one node is not catalogued
    nodes = spark.createDataFrame(ids + ids[:1], "pipeline string, id string")
    cover = reachability.cover(spark.createDataFrame(links + links[:3], "pipeline string, source string, target string"))
    for back in (False, True):
        told = walk([(p, t, s) for p, s, t in links] if back else links)
        got = {(r.pipeline, r.start): (r.nodes, r.fives)
               for r in reachability.count_all(cover, nodes, back, fives=F.col("id").endswith("5")).collect()}
        kept = {k: {n for n in v if (k[0], n) in ids} for k, v in told.items()}
        assert got == {k: (len(v), sum(n.endswith("5") for n in v)) for k, v in kept.items() if v}


WIDE = ([("p", f"s{k}", f"t{(k * j) % 29}") for k in range(400) for j in (1, 2, 3)]
        + [("p", f"t{k}", f"u{k % 4}") for k in range(29)] + [("p", f"u{k}", f"v{k % 2}") for k in range(4)])


@pytest.mark.parametrize("turn", [False, True])
def test_counts_of_all_starts_write_little_more_than_the_links(spark, monkeypatch, turn):
    """On a wide and shallow graph the labels are about as many as the pairs: they must not be written, whichever way is asked."""
    wrote, cut = [], reachability.cut

    def counted(df):
        out = cut(df)
        wrote.append(out.count())
        return out
    monkeypatch.setattr(reachability, "cut", counted)
    links = set(WIDE)
    edges = spark.createDataFrame([(*link, "derives") for link in links], "pipeline string, source string, target string, type string")
    nodes = spark.createDataFrame(sorted({("p", n) for _, s, t in links for n in (s, t)}), "pipeline string, id string")
    got = lineage.reach_counts(nodes, lineage.turned(edges) if turn else edges).collect()
    told = walk([(p, t, s) for p, s, t in links] if turn else links)
    assert {(r.pipeline, r.start): r.nodes for r in got} == {k: len(v) for k, v in told.items()}
    assert sum(wrote) < 2 * len(links)


def test_numbered_sales_links_are_those_of_the_sales_graph(spark):
    folder = "/root/testdata/sf0.001"
    nodes, links = graphs.sales_links(spark, folder)
    names, edges = graphs.sales_graph(spark, folder)
    named = [tuple(r) for r in graphs.sales_names(links, "source", "target").collect()]
    assert len(named) == len(set(named))
    assert set(named) == {tuple(r) for r in lineage.lineage_edges(edges).collect()}
    known = {tuple(r) for r in graphs.sales_names(nodes, "id").collect()}
    assert known == {(r.pipeline, r.id, r.type) for r in names.where("type in ('field', 'output')").collect()}


def test_lineage_upstream_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    count, diff = compare(spark, duck(folder), "lineage_upstream", folder)
    assert not diff, diff
    assert count > 0


def test_label_rows_are_dealt_in_bounded_parts(spark, monkeypatch):
    """Parts follow the number of label rows, and an even cover groups a start's labels in the one shuffle that deals them."""
    links = spark.createDataFrame(sorted(set(WIDE)), "pipeline string, source string, target string")
    nodes = spark.createDataFrame([("p", "v0"), ("p", "v1")], "pipeline string, id string")
    monkeypatch.setattr(reachability, "DEALT", 100)
    even = reachability.cover(links)
    monkeypatch.setattr(reachability, "GATHERED", 0)
    uneven = reachability.cover(links)
    assert even.even and not uneven.even and even.parts == uneven.parts > 20
    plans = [reachability.count_all(c, nodes)._jdf.queryExecution().toString() for c in (even, uneven)]
    assert all(f", {even.parts}), REPARTITION_BY_NUM" in p for p in plans)
    assert plans[0].count("Exchange hashpartitioning") < plans[1].count("Exchange hashpartitioning")
