"""A reachability index over lineage: chains and, per start, where each chain is entered. No pair of nodes is formed.

* Chains: every node keeps at most one link to the next and one from the one before, so the links kept form paths. Pointer doubling
  ranks all paths in as many rounds as the logarithm of the longest. A closed path is opened before its smallest node.
* Only nodes that a link leads to are placed on chains; the others can but start a way.
* Labels: a start reaches a chain from some position on to its end, so (start, chain, entry) says it all; a start has one row a
  chain, whatever the chain's length. A round follows the links that leave chains behind their entries, all at once, so rounds count
  changes of chain, not steps. Entries only move forward in a chain, so cycles end without being condensed.
* Counts of all starts: rounds are walked for placed nodes only. What a start reaches is then what its targets are and reach: one join
  of the links, one grouping, nothing written. The same labels summed by entry instead of by start tell how many starts reach a node,
  so an index of either direction answers both questions, and the one that places fewer nodes is built.
* Links from one chain to another are kept only where no later link enters as early (a staircase), and cut at every `CHUNK` positions,
  so an entry meets a bounded number of rows a pair of chains.
* A question is a join with labels: `counts` sums suffix totals of the entered chains, `nodes_of` lists nodes, `reaches` tests pairs.

Positions count down to 0 at a chain's end, as negative numbers; chains are numbered. Tables are written once a round (see `session.cut`). Self-links are
ignored; a start in a cycle does not count itself; an empty graph gives empty tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import cut

CHUNK = 256
#: Up to how many label rows of one start, all its targets' together, may be grouped in one task, and how many rows a task is to get.
GATHERED, DEALT = 1 << 22, 1 << 19
#: A sketch of 10 000 frequent items misses a count by less than this share of all rows.
SKETCH_ERROR = 3.5 / 16384


@dataclass(frozen=True)
class Index:
    """links (pipeline, source, target), core (those whose source is entered), places (pipeline, node, chain, pos) of all entered nodes,
    exits (pipeline, chain, chunk, after, upto, to, entry)."""

    links: DataFrame
    core: DataFrame
    places: DataFrame
    exits: DataFrame


@dataclass(frozen=True)
class Cover:
    """An index with what counts of all starts need: ahead (pipeline, target, chain, entry), an entered node's own place and its labels in
    one; selves (pipeline, node), the nodes that reach themselves. `turned` tells that the index is of the links turned round, `parts`
    among how many tasks label rows are dealt, `even` that no start has more than `GATHERED` of them."""

    index: Index
    ahead: DataFrame
    selves: DataFrame
    turned: bool
    parts: int
    even: bool


def _chunk(pos: Column) -> Column:
    return F.floor(pos / CHUNK)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on all `keys`, led by a hash of them: sorts compare the first key, and few pipelines or names that begin alike would tie."""
    return left.withColumn("_hash", F.xxhash64(*keys)).join(right.withColumn("_hash", F.xxhash64(*keys)), ["_hash", *keys], how).drop("_hash")


def _ranked(nodes: DataFrame, following: DataFrame) -> DataFrame:
    """(pipeline, node, to, dist, low, open): the end of each node's path, the links to it, the smallest node passed. `open` marks
    nodes of closed paths, which have no end."""
    at, done = cut(nodes.join(following, ["pipeline", "node"], "left").select(
        "pipeline", "node", F.coalesce("next", "node").alias("to"), F.col("next").isNotNull().cast("long").alias("dist"),
        F.least("node", F.coalesce("next", "node")).alias("low"), F.col("next").isNotNull().alias("open"))), []
    left = at
    while True:
        ahead = at.select("pipeline", F.col("node").alias("to"), F.col("to").alias("further"), F.col("dist").alias("more"),
                          F.col("low").alias("lower"), F.col("open").alias("goes_on"))
        moved = left.where("open").join(ahead, ["pipeline", "to"]).select(
            "pipeline", "node", F.col("further").alias("to"), (F.col("dist") + F.col("more")).alias("dist"),
            F.least("low", "lower").alias("low"), F.col("goes_on").alias("open"),
            (~F.col("goes_on") | (F.col("lower") < F.col("low"))).alias("news"))
        moved = cut(moved)
        if moved.where("news").isEmpty():  # the rest are closed paths, each of which knows its smallest node
            return at
        done.append(left.where("not open"))
        left = moved.drop("news")
        at = reduce(DataFrame.unionByName, [*done, left])


def _chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(pipeline, node, chain, pos) for every one of nodes (pipeline, node, number), by the links among them."""
    choice = links.groupBy("pipeline", "source").agg(F.min("target").alias("next"))
    following = cut(choice.groupBy("pipeline", "next").agg(F.min("source").alias("node")))
    at = _ranked(nodes.drop("number"), following)
    closed = at.where("open").select("pipeline", "node", "low")
    if not closed.isEmpty():
        opened = following.join(closed, ["pipeline", "node"], "left").where("low is null or next <> low").drop("low")
        at = _ranked(nodes.drop("number"), opened)
    ends = nodes.select("pipeline", F.col("node").alias("to"), F.col("number").alias("chain"))
    return at.join(ends, ["pipeline", "to"]).select("pipeline", "node", "chain", (-F.col("dist")).alias("pos"))


def _distinct(links: DataFrame) -> DataFrame:
    return cut(links.where(F.col("source") != F.col("target")).select("pipeline", "source", "target").distinct())


def build(links: DataFrame) -> Index:
    """The index of links (pipeline, source, target)."""
    return _index(_distinct(links))


def _index(links: DataFrame) -> Index:
    entered = cut(links.select("pipeline", F.col("target").alias("node")).distinct().withColumn("number", F.monotonically_increasing_id()))
    # nothing enters a chain before a node that no link leads to, so links from there only start ways
    core = cut(_join(links, entered.select("pipeline", F.col("node").alias("source")), ["pipeline", "source"], "left_semi"))
    places = cut(_chains(entered, core))
    here = places.withColumnsRenamed({"node": "source"})
    there = places.withColumnsRenamed({"node": "target", "chain": "to", "pos": "entry"})
    over = (core.join(here, ["pipeline", "source"]).join(there, ["pipeline", "target"])
            .where((F.col("chain") != F.col("to")) | (F.col("entry") <= F.col("pos")))
            .groupBy("pipeline", "chain", "to", "pos").agg(F.min("entry").alias("entry")))
    pair = Window.partitionBy("pipeline", "chain", "to").orderBy("pos")
    later = F.min("entry").over(pair.rowsBetween(1, Window.unboundedFollowing))
    steps = over.withColumn("later", later).where("later is null or entry < later")
    first = F.lag("pos").over(pair)
    longest = places.groupBy("pipeline", "chain").agg((F.min("pos") - 1).alias("begins"))
    steps = steps.withColumn("before", first).join(longest, ["pipeline", "chain"]).withColumn("after", F.coalesce("before", "begins"))
    exits = steps.select("pipeline", "chain", F.explode(F.sequence(_chunk(F.col("after") + 1), _chunk(F.col("pos")))).alias("chunk"),
                         "after", F.col("pos").alias("upto"), "to", "entry")
    return Index(links, core, places, cut(exits))


def labels(index: Index, starts: DataFrame | None = None) -> DataFrame:
    """(pipeline, start, chain, entry): each start (pipeline, start; all sources if none are given) reaches the chain from `entry` on."""
    if starts is None:
        ahead = _join(index.links, _ahead(index, _walked(index, index.core)), ["pipeline", "target"])
        return ahead.groupBy("pipeline", F.col("source").alias("start"), "chain").agg(F.min("entry").alias("entry"))
    asked = starts.select("pipeline", F.col("start").alias("source")).distinct()
    return _walked(index, index.links.join(asked, ["pipeline", "source"]))


def _walked(index: Index, links: DataFrame) -> DataFrame:
    """The labels of the sources of `links`, which hold all links of each, by rounds."""
    entered = index.places.select("pipeline", F.col("node").alias("target"), "chain", F.col("pos").alias("entry"))
    key = ["pipeline", "start", "chain"]
    first = links.withColumnRenamed("source", "start").join(entered, ["pipeline", "target"])
    found = [cut(first.groupBy(*key).agg(F.min("entry").alias("entry")))]
    while True:
        known = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("entry").alias("entry"))
        out = index.exits.withColumnRenamed("entry", "next")
        met = found[-1].withColumn("chunk", _chunk(F.col("entry"))).join(out, ["pipeline", "chain", "chunk"])
        met = met.where("after < entry and entry <= upto").groupBy("pipeline", "start", F.col("to").alias("chain")).agg(
            F.min("next").alias("next"))
        fresh = met.join(known, key, "left").where("entry is null or next < entry").select(*key, F.col("next").alias("entry"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            return known
        found.append(fresh)


def _ahead(index: Index, known: DataFrame) -> DataFrame:
    """(pipeline, target, chain, entry): what a way to `target` reaches, the target itself included. `known`: labels of entered nodes."""
    own = index.places.select("pipeline", F.col("node").alias("target"), "chain", F.col("pos").alias("entry"))
    both = own.unionByName(known.withColumnRenamed("start", "target"))
    return both.groupBy("pipeline", "target", "chain").agg(F.min("entry").alias("entry"))


def _spread_of(end: str) -> Column:
    return F.approx_count_distinct(F.xxhash64("pipeline", end)).alias(end)


def _most_of(end: str) -> Column:
    """Links of the node with most of them, low by `SKETCH_ERROR` of all links at the most; 0 if none stands out."""
    return F.expr(f"coalesce(get(approx_top_k(xxhash64(pipeline, {end}), 1, 10000), 0).count, 0)").alias(f"most_{end}")


def cover(links: DataFrame, collapse: bool = True) -> Cover:
    """For counts of all starts of links (pipeline, source, target), in either direction. Which end has fewer nodes is estimated: that
    decides the work only. Without `collapse`, links are read as they are each time; repeated ones then cost time, no more."""
    links = _distinct(links) if collapse else links.where(F.col("source") != F.col("target"))
    ends = links.select(F.count(F.lit(1)).alias("links"), *[f(e) for e in ("source", "target") for f in (_spread_of, _most_of)]).first()
    turned = ends["target"] > ends["source"]
    index = _index(links.select("pipeline", F.col("target").alias("source"), F.col("source").alias("target")) if turned else links)
    known = cut(_walked(index, index.core))
    selves = known.withColumnRenamed("start", "node").join(index.places, ["pipeline", "node", "chain"]).where("entry <= pos")
    ahead = cut(_ahead(index, known))
    rows = ahead.groupBy("pipeline", "target").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.avg("count"), F.lit(0.0))).first()
    most = ends["most_target" if turned else "most_source"] + ends["links"] * SKETCH_ERROR
    parts = max(links.sparkSession.sparkContext.defaultParallelism, int(ends["links"] * rows[1] / DEALT))
    return Cover(index, ahead, cut(selves.select("pipeline", "node")), turned, parts, most * rows[0] <= GATHERED)


def _marked(nodes: DataFrame, **kinds: Column) -> DataFrame:
    """(pipeline, node, nodes, and one column a kind): 1 for each node, and whether it satisfies each condition."""
    return nodes.select("pipeline", F.col("id").alias("node"), F.lit(1).alias("nodes"),
                        *[F.coalesce(c.cast("int"), F.lit(0)).alias(k) for k, c in kinds.items()]).dropDuplicates(["pipeline", "node"])


def count_all(over: Cover, nodes: DataFrame, back: bool = False, **kinds: Column) -> DataFrame:
    """(pipeline, start, nodes, and one column a kind) as in `counts`, for every start. With `back`, ways are followed against the links:
    how many of `nodes` lead to the start."""
    index, names, target = over.index, ["nodes", *kinds], ["pipeline", "target"]
    marked = _marked(nodes, **kinds)
    if over.turned == back:
        own = cut(_join(index.places, marked, ["pipeline", "node"], "left").na.fill(0, names))
        # totals never grow along a chain, so the largest belongs to the earliest entry
        onward = Window.partitionBy("pipeline", "chain").orderBy(F.desc("pos"))
        totals = own.select("pipeline", "chain", F.col("pos").alias("entry"), *[F.sum(n).over(onward).alias(n) for n in names])
        ahead = over.ahead.join(totals, ["pipeline", "chain", "entry"]).drop("entry")
        found = _join(index.links, ahead, target).select("pipeline", F.col("source").alias("start"), "chain", *names)
        # by start alone both groupings need one shuffle
        found = found.repartition(over.parts, "pipeline", "start", *([] if over.even else ["chain"]))
        found = found.groupBy("pipeline", "start", "chain").agg(*[F.max(n).alias(n) for n in names])
        found = found.groupBy("pipeline", "start").agg(*[F.sum(n).alias(n) for n in names])
    else:
        own = _join(over.selves, marked, ["pipeline", "node"])
        known = _join(_join(index.links, marked.withColumnRenamed("node", "source"), ["pipeline", "source"]), over.ahead, target)
        known = known.select("pipeline", "source", "chain", "entry", *names).repartition(over.parts, "pipeline", "source", "chain")
        known = known.groupBy("pipeline", "source", "chain").agg(F.min("entry").alias("pos"), *[F.max(n).alias(n) for n in names])
        known = known.groupBy("pipeline", "chain", "pos").agg(*[F.sum(n).alias(n) for n in names])
        so_far = Window.partitionBy("pipeline", "chain").orderBy("pos")
        found = index.places.join(known, ["pipeline", "chain", "pos"], "left").na.fill(0, names).select(
            "pipeline", F.col("node").alias("start"), *[F.sum(n).over(so_far).alias(n) for n in names])
    itself = over.selves.join(own, ["pipeline", "node"]).select(
        "pipeline", F.col("node").alias("start"), *[F.col(n).alias(f"own_{n}") for n in names])
    return _others(found, itself, names)


def _others(found: DataFrame, itself: DataFrame, names: list[str]) -> DataFrame:
    """Counts without the start itself, where it is among the counted."""
    out = found.join(itself, ["pipeline", "start"], "left")
    return out.select("pipeline", "start", *[(F.col(n) - F.coalesce(f"own_{n}", F.lit(0))).alias(n) for n in names]).where("nodes > 0")


def counts(index: Index, known: DataFrame, nodes: DataFrame, **kinds: Column) -> DataFrame:
    """(pipeline, start, nodes, and one column a kind): how many of `nodes` (pipeline, id, ...) each start of the labels `known` reaches,
    and how many of these satisfy each condition. Suffix totals of chains are looked up by entry; nothing reached is listed."""
    marked, names = _marked(nodes, **kinds), ["nodes", *kinds]
    onward = Window.partitionBy("pipeline", "chain").orderBy(F.desc("pos"))
    own = cut(index.places.join(marked, ["pipeline", "node"], "left").na.fill(0, names))
    totals = own.select("pipeline", "chain", F.col("pos").alias("entry"), *[F.sum(n).over(onward).alias(n) for n in names])
    reached = known.join(totals, ["pipeline", "chain", "entry"]).groupBy("pipeline", "start").agg(*[F.sum(n).alias(n) for n in names])
    itself = (known.join(own.withColumnRenamed("node", "start"), ["pipeline", "start", "chain"]).where("entry <= pos")
              .select("pipeline", "start", *[F.col(n).alias(f"own_{n}") for n in names]))
    return _others(reached, itself, names)


def nodes_of(index: Index, known: DataFrame) -> DataFrame:
    """(pipeline, start, node) for the labels `known`: as many rows as are reached, so ask for the starts that are needed."""
    wide = known.join(index.places, ["pipeline", "chain"]).where("pos >= entry and node <> start")
    return wide.select("pipeline", "start", "node")


def reaches(index: Index, pairs: DataFrame) -> DataFrame:
    """The pairs (pipeline, start, node) among those asked for that a way of links connects."""
    asked = pairs.select("pipeline", "start", "node").distinct().where("start <> node")
    known = labels(index, asked)
    return (asked.join(index.places, ["pipeline", "node"]).join(known, ["pipeline", "start", "chain"]).where("pos >= entry")
            .select("pipeline", "start", "node"))
