"""Lineage over node and edge tables: reachability, stage summaries, unused fields, merging with
observed columns. A catalogue of many pipelines is one pair of tables keyed by `pipeline`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators import reachability
from tidegauge.session import cut

DATA_LINKS = ("derives", "produces")


def dedup_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """First node per (pipeline, id)."""
    rank = F.row_number().over(Window.partitionBy("pipeline", "id").orderBy(*order))
    return nodes.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edges unique on source, target, type and evidence; no evidence counts as file '' line 0."""
    return (edges.withColumn("file", F.coalesce("file", F.lit("")))
            .withColumn("line", F.coalesce("line", F.lit(0)))
            .select("pipeline", "source", "target", "type", "file", "line").distinct())


def lineage_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*DATA_LINKS)).select("pipeline", "source", "target").distinct()


def reach(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(pipeline, start, node) pairs with a path of data links from start to node, start excluded.

    Frontier rounds: only pairs found last are extended, pairs already known are removed with an
    anti join, and each frontier is checkpointed so that a lost executor costs one round and the
    plan stays flat. Cycles end because no new pair appears."""
    links = cut(lineage_edges(edges))
    step = links.select("pipeline", F.col("source").alias("node"), F.col("target").alias("next"))
    if starts is None:
        frontier = links.select("pipeline", F.col("source").alias("start"), F.col("target").alias("node"))
    else:
        frontier = (links.join(starts.select("pipeline", F.col("start").alias("source")).distinct(),
                               ["pipeline", "source"])
                    .select("pipeline", F.col("source").alias("start"), F.col("target").alias("node")))
    frontier = cut(frontier.distinct())
    found = frontier
    while True:
        longer = (frontier.join(step, ["pipeline", "node"])
                  .select("pipeline", "start", F.col("next").alias("node")).distinct())
        frontier = cut(longer.join(found, ["pipeline", "start", "node"], "left_anti"))
        if frontier.isEmpty():
            return found.where(F.col("start") != F.col("node"))
        found = found.unionByName(frontier)


def downstream(nodes: DataFrame, edges: DataFrame, node_type: str | None = None,
               starts: DataFrame | None = None) -> DataFrame:
    """Nodes computed, directly or not, from each start node."""
    named = nodes.select("pipeline", F.col("id").alias("node"), "type", "label")
    out = reach(edges, starts).join(named, ["pipeline", "node"])
    return out.where(F.col("type") == node_type) if node_type else out


def upstream(nodes: DataFrame, edges: DataFrame, node_type: str | None = None,
             starts: DataFrame | None = None) -> DataFrame:
    """Nodes each start node is computed from: the same walk over turned edges."""
    return downstream(nodes, turned(edges), node_type, starts)


def turned(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def reach_counts(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, **kinds: Column) -> DataFrame:
    """How many nodes, and nodes of each kind (conditions on node columns), are computed from every start, or from the starts asked for:
    by the reachability index, without listing them."""
    if starts is None:
        return reachability.count_all(reach_cover(edges), nodes, **kinds)
    index = reachability.build(edges.where(F.col("type").isin(*DATA_LINKS)))
    return reachability.counts(index, reachability.labels(index, starts), nodes, **kinds)


def reach_cover(edges: DataFrame) -> reachability.Cover:
    """What `reachability.count_all` needs to count for every start, downstream or upstream."""
    return reachability.cover(edges.where(F.col("type").isin(*DATA_LINKS)))


def reached_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pipeline, node, output, label): the outputs each node reaches, by sets pushed back against the edges. A pipeline's outputs are
    numbered and held as bits of one long per 64 of them; a round sends what a node has newly learned to the nodes before it, joined by
    `bit_or`. A round shuffles at most one row an edge (and long), whatever the number of pairs; cycles end as bits stop changing."""
    number = F.row_number().over(Window.partitionBy("pipeline").orderBy("id")) - 1
    outs = nodes.where(F.col("type") == "output").select("pipeline", "id", "label").dropDuplicates(["pipeline", "id"])
    outs = cut(outs.withColumn("_n", number).select("pipeline", "id", "label", F.expr("_n div 64").alias("word"), (F.col("_n") % 64).alias("bit")))
    links = cut(lineage_edges(edges)).select("pipeline", F.col("source").alias("before"), F.col("target").alias("node"))
    known = outs.select("pipeline", F.col("id").alias("node"), "word", F.expr("shiftleft(1L, cast(bit as int))").alias("bits"))
    fresh = known
    while True:
        told = links.join(fresh, ["pipeline", "node"]).groupBy("pipeline", F.col("before").alias("node"), "word").agg(F.bit_or("bits").alias("told"))
        both = told.join(known, ["pipeline", "node", "word"], "left")
        fresh = cut(both.select("pipeline", "node", "word", F.expr("told & ~coalesce(bits, 0L)").alias("bits")).where("bits <> 0"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh).groupBy("pipeline", "node", "word").agg(F.bit_or("bits").alias("bits")))
    each = known.select("pipeline", "node", "word", F.explode(F.expr(
        "filter(sequence(0L, 63L), b -> (shiftrightunsigned(bits, cast(b as int)) & 1L) = 1)")).alias("bit"))
    found = each.join(outs.withColumn("bit", F.col("bit").cast("bigint")), ["pipeline", "word", "bit"])
    return found.where(F.col("node") != F.col("id")).select("pipeline", "node", F.col("id").alias("output"), "label")


def affected_outputs(nodes: DataFrame, edges: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(pipeline, field, output) labels. `fields` (pipeline, field) limits the result to some fields; an unknown field gives no rows."""
    named = nodes.where(F.col("type") == "field").select("pipeline", F.col("id").alias("node"), F.col("label").alias("field"))
    if fields is not None:
        named = named.join(fields.select("pipeline", "field").distinct(), ["pipeline", "field"])
    return (reached_outputs(nodes, edges).join(named, ["pipeline", "node"])
            .select("pipeline", "field", F.col("label").alias("output")).distinct())


TRACE = "array<struct<node_id:string,node_type:string,label:string>>"


def traces(nodes: DataFrame, edges: DataFrame, fields: DataFrame) -> DataFrame:
    """(pipeline, field, lineage) for the asked fields (pipeline, field): the way from the failing field back to where its data comes from,
    as steps (node_id, node_type, label), the field first. Every node keeps one node before it, the smallest id; a frontier of one row
    a field follows these pointers a step a round, and stops at a node without one or, in a cycle, before a node it has passed. Fields
    that the graph does not know have no row."""
    known = nodes.select("pipeline", "id", F.struct(F.col("id").alias("node_id"), F.col("type").alias("node_type"), "label").alias("step"))
    known = known.groupBy("pipeline", "id").agg(F.min("step").alias("step"))
    before = lineage_edges(edges).where(F.col("source") != F.col("target")).groupBy("pipeline", F.col("target").alias("at")).agg(
        F.min("source").alias("id"))
    pointers = cut(before.join(known, ["pipeline", "id"]).select("pipeline", "at", F.col("id").alias("prior"), F.col("step").alias("more")))
    asked = fields.select("pipeline", "field").distinct()
    starts = known.where(F.col("step.node_type") == "field").withColumn("field", F.col("step.label"))
    starts = starts.groupBy("pipeline", "field").agg(F.min_by("step", "id").alias("step"))
    frontier = cut(asked.join(starts, ["pipeline", "field"]).select("pipeline", "field", F.col("step.node_id").alias("at"), F.array("step").alias("lineage")))
    done = []
    while True:
        moved = frontier.join(pointers, ["pipeline", "at"], "left")
        on = F.col("prior").isNotNull() & ~F.exists("lineage", lambda s: s["node_id"] == F.col("prior"))
        moved = cut(moved.select("pipeline", "field", on.alias("on"), F.when(on, F.col("prior")).otherwise(F.col("at")).alias("at"),
                                 F.when(on, F.concat("lineage", F.array("more"))).otherwise(F.col("lineage")).alias("lineage")))
        done.append(moved.where("not on").select("pipeline", "field", "lineage"))
        frontier = moved.where("on").drop("on")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, done)


def unused_fields(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fields written but never read, derived from or produced."""
    used = (edges.where(F.col("type").isin("reads", "derives", "produces"))
            .select("pipeline", F.col("source").alias("id")).distinct())
    written = (edges.where((F.col("type") == "writes") & F.col("file").isNotNull())
               .select("pipeline", F.col("target").alias("id"), "file", "line").distinct())
    labels = nodes.select("pipeline", "id", "label")
    return written.join(used, ["pipeline", "id"], "left_anti").join(labels, ["pipeline", "id"]).select(
        "pipeline", F.col("label").alias("field"), "file", "line")


def stage_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What each stage does, one row per stage, role and label: fields it reads and writes, derivations
    (transforms) whose target its function wrote, and outputs it produces (a source it reads or
    writes, or evidence in the function's file). Rows, not lists: a stage may touch any number."""
    kind = nodes.select("pipeline", "id", "type", "label", "file")
    stages = nodes.where(F.col("type") == "stage").select(
        "pipeline", F.col("id").alias("stage"), F.col("label").alias("stage_label"), "stage_order",
        F.col("function").alias("fn"))
    fields = kind.where(F.col("type") == "field").select("pipeline", F.col("id").alias("fid"), F.col("label").alias("flabel"))
    outs = kind.where(F.col("type") == "output").select("pipeline", F.col("id").alias("oid"), F.col("label").alias("olabel"))

    def edge(t: str, *cols) -> DataFrame:
        return edges.where(F.col("type") == t).select("pipeline", *cols)

    reads = edge("reads", F.col("source").alias("fid"), F.col("target").alias("fn"))
    writes = edge("writes", F.col("source").alias("fn"), F.col("target").alias("fid"))
    derives = edge("derives", F.col("source").alias("sid"), F.col("target").alias("fid"), "file", "line")
    produces = edge("produces", F.col("source").alias("fid"), F.col("target").alias("oid"), F.col("file").alias("efile"))
    src = fields.select("pipeline", F.col("fid").alias("sid"), F.col("flabel").alias("slabel"))

    def role(df: DataFrame, name: str, label: Column) -> DataFrame:
        return df.select("pipeline", "fn", F.lit(name).alias("role"), label.alias("label"))

    touched = reads.select("pipeline", "fn", "fid").union(writes.select("pipeline", "fn", "fid")).distinct()
    by_touch = produces.join(touched, ["pipeline", "fid"]).select("pipeline", "fn", "oid")
    fn_file = kind.where((F.col("type") == "function") & (F.col("file") != "")).select(
        "pipeline", F.col("id").alias("fn"), F.col("file").alias("efile"))
    by_file = produces.where(F.col("efile") != "").join(fn_file, ["pipeline", "efile"]).select("pipeline", "fn", "oid")
    parts = [
        role(reads.join(fields, ["pipeline", "fid"]), "reads", F.col("flabel")),
        role(writes.join(fields, ["pipeline", "fid"]), "writes", F.col("flabel")),
        role(derives.join(fields, ["pipeline", "fid"]).join(src, ["pipeline", "sid"])
             .join(writes.distinct(), ["pipeline", "fid"]), "transforms", F.concat("slabel", F.lit("->"), "flabel")),
        role(by_touch.union(by_file).distinct().join(outs, ["pipeline", "oid"]), "produces", F.col("olabel"))]
    rows = reduce(DataFrame.unionByName, parts).distinct()
    return stages.join(rows, ["pipeline", "fn"]).select("pipeline", "stage", "stage_order", "stage_label", "role", "label")


def merge_origin(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """Field and output nodes against the columns a run showed (pipeline, label): static (only in the
    graph), both, or runtime (only in the run)."""
    known = nodes.where(F.col("type").isin("field", "output")).select("pipeline", "id", "type", "label")
    seen = observed.select("pipeline", "label").distinct().withColumn("seen", F.lit(True))
    merged = known.join(seen, ["pipeline", "label"], "full")
    origin = F.when(F.col("id").isNull(), "runtime").when(F.col("seen"), "both").otherwise("static")
    return merged.select("pipeline", F.coalesce("id", F.concat(F.lit("field:"), "label")).alias("id"),
                         F.coalesce("type", F.lit("field")).alias("type"), "label", origin.alias("origin"))


def merge_report(nodes: DataFrame, edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Per pipeline: how many static fields and field-to-field derivations the run confirmed."""
    merged = merge_origin(nodes, observed)
    f = merged.where(F.col("type") == "field")
    counts = f.groupBy("pipeline").agg(
        F.count_if(F.col("origin") != "runtime").alias("static_fields"),
        F.count_if(F.col("origin") == "both").alias("confirmed_fields"),
        F.count_if(F.col("origin") == "runtime").alias("runtime_only_fields"))
    ends = f.where(F.col("origin") != "runtime").select("pipeline", "id", (F.col("origin") == "both").alias("both"))
    a = ends.select("pipeline", F.col("id").alias("source"), F.col("both").alias("a"))
    b = ends.select("pipeline", F.col("id").alias("target"), F.col("both").alias("b"))
    links = (dedup_edges(edges).where(F.col("type") == "derives").join(a, ["pipeline", "source"]).join(b, ["pipeline", "target"])
             .groupBy("pipeline").agg(F.count(F.lit(1)).alias("field_edges"),
                                      F.count_if(F.col("a") & F.col("b")).alias("confirmed_field_edges")))
    out = counts.join(links, "pipeline", "left").na.fill(0, ["field_edges", "confirmed_field_edges"])
    ratio = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.0))
    return out.withColumn("field_agreement", ratio("confirmed_fields", "static_fields")) \
              .withColumn("edge_agreement", ratio("confirmed_field_edges", "field_edges"))


def alerts_with_outputs(alerts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Alerts with the way back from their root field (`lineage`, empty when the field is unknown or missing) and the outputs it can
    reach (comma separated; a pipeline's outputs are few)."""
    fields = alerts.where(F.col("root_field").isNotNull()).select("pipeline", F.col("root_field").alias("field"))
    hit = (affected_outputs(nodes, edges, fields).groupBy("pipeline", F.col("field").alias("root_field"))
           .agg(F.array_join(F.array_sort(F.collect_set("output")), ", ").alias("affected_outputs")))
    way = traces(nodes, edges, fields).withColumnRenamed("field", "root_field")
    out = alerts.join(hit, ["pipeline", "root_field"], "left").join(way, ["pipeline", "root_field"], "left")
    return out.withColumns({"affected_outputs": F.coalesce("affected_outputs", F.lit("")),
                            "lineage": F.coalesce("lineage", F.array().cast(TRACE))})


def alerts_two_hops(alerts: DataFrame, edges: DataFrame) -> DataFrame:
    """The report-view variant: outputs exactly two links away (field -> field -> output)."""
    links = edges.where(F.col("type").isin(*DATA_LINKS))
    first = links.select("pipeline", F.col("source").alias("_id"), F.col("target").alias("_mid"))
    second = links.where(F.col("type") == "produces").select("pipeline", F.col("source").alias("_mid"), F.col("target").alias("_out"))
    tagged = alerts.withColumn("_id", F.concat(F.lit("field:"), "root_field"))
    hit = (tagged.select("pipeline", "_id").distinct().join(first, ["pipeline", "_id"]).join(second, ["pipeline", "_mid"])
           .groupBy("pipeline", "_id").agg(F.array_join(F.array_sort(F.collect_set("_out")), ", ").alias("affected_outputs")))
    return tagged.join(hit, ["pipeline", "_id"], "left").drop("_id")
