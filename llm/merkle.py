"""Merkle manifest of a table with inclusion proofs by pointer jumping.

Every row is a leaf: SHA-256 over its fields, each with its length. Leaves of one group, in order of id, are hashed in runs of
`FAN_OUT` until one node, the group's subroot, remains; the subroots, in order of group, likewise give the root.

* Places: rows are range-partitioned by (group, id) and numbered from the partitions' sizes, so a hot group or a hot id is cut
  like any other; nothing is ranked in one task.
* Levels: one aggregation a level, of at most `FAN_OUT` rows a group; each level is a `FAN_OUT`-th of the one below.
* Proofs: a node holds a pointer to an ancestor and the segment of siblings (left and right of the way) up to it, at first its
  parent and its own run. A round joins the table with itself at the pointer: the ancestor's pointer is taken over and its segment
  appended, so distances double. Leaves ride in their lowest run (all of them share its way up), so segments are held once a run.
* A high ancestor has very many followers; both sides of the self-join are cut at every `CHUNK` leaves, and an ancestor is
  repeated once for each stretch it covers, so no join key has more than a bounded number of rows.

Defined cases: a null field hashes as `-` and differs from the empty text; rows of a null id come first in their group, rows of a
null group form a group that comes first; rows that share an id are ordered by their hash, equal rows are leaves of their own;
a lone leaf is its group's subroot, a lone subroot the root; an empty table gives an empty manifest; other columns are not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import docs_of
from tidegauge.session import staged

FAN_OUT, CHUNK = 16, 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = -1  # the tree over the subroots; group k's own tree is k
KEY = ("tree", "level", "idx")
STEP = "struct<left:string,right:string>"


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of the fields one after the other: `-` for null, else byte count, colon, value."""
    def part(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf hash and the steps of its proof lead to."""
    return F.aggregate(proof, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling hashes of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows with `place`, their number from 0 in `order` (nulls first), as a table. What is collected is one number a partition."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("inside"))
    cut = staged(cut, name)
    sizes = dict(cut.groupBy("part").agg(F.count("*").alias("n")).toArrow().to_pandas().itertuples(index=False))
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((int(part), before))
        before += int(sizes[part])
    starts = spark.createDataFrame(starts, "part int, start long")
    return cut.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("inside")).drop("part", "inside", "start")


def _step(items: str, at: str) -> Column:
    """What stands left and right of position `at` in an array of hashes."""
    return F.expr(f"struct(array_join(slice({items}, 1, {at}), '') as left, "
                  f"array_join(slice({items}, {at} + 2, greatest(size({items}) - {at} - 1, 0)), '') as right)")


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above `nodes` (tree, level, idx, hash, first, last, many: nodes of that level of the tree), each as a table with the
    nodes below (`kids`). `most` is the greatest number of nodes in a tree."""
    found = []
    while most > 1:
        up = nodes.where("many > 1").withColumn("up", F.expr(f"idx div {FAN_OUT}"))
        up = up.groupBy("tree", F.col("up").alias("parent"), (F.col("level") + 1).alias("over"), "many").agg(
            F.array_sort(F.collect_list(F.struct("idx", "hash", "first", "last", "child"))).alias("kids"))
        up = staged(up.select("tree", F.col("over").alias("level"), F.col("parent").alias("idx"),
                              F.sha2(F.array_join(F.col("kids.hash"), ""), 256).alias("hash"),
                              F.array_min("kids.first").alias("first"), F.array_max("kids.last").alias("last"),
                              F.expr(f"(many + {FAN_OUT - 1}) div {FAN_OUT}").alias("many"), "kids"), "merkle-level")
        found.append(up)
        nodes = up.select("tree", "level", "idx", "hash", "first", "last", "many", F.struct(*KEY).alias("child"))
        most = -(-most // FAN_OUT)
    return found


def _links(level: DataFrame, crossing: bool) -> DataFrame:
    """Every node below `level` with its parent and its first segment. The children of the top tree's lowest level are subroots."""
    kids = level.select(F.struct(*KEY).alias("above"), F.posexplode("kids").alias("at", "kid"), F.expr("kids.hash").alias("hashes"))
    return kids.select("kid.child.*", "kid.first", "kid.last", "above", F.array(_step("hashes", "at")).alias("segment"),
                       (F.col("kid.hash") if crossing else F.lit(None).cast("string")).alias("subroot"))


def _jump(links: DataFrame) -> DataFrame:
    """One round: pointers and segments of twice the distance, as a table."""
    chunk = f"first div {CHUNK}"
    on = links.where(f"level > 1 or tree = {TOP}").select(  # a lowest run leads on only its own leaves
        F.struct(*KEY).alias("above"), F.explode(F.expr(f"sequence({chunk}, last div {CHUNK})")).alias("chunk"),
        F.col("above").alias("further"), F.col("segment").alias("more"), F.col("subroot").alias("passed"))
    moved = links.withColumn("chunk", F.expr(chunk)).join(on, ["above", "chunk"], "left")
    return staged(moved.select(*KEY, "first", "last", F.coalesce("further", "above").alias("above"),
                               F.when(F.col("more").isNull(), F.col("segment")).otherwise(F.concat("segment", "more")).alias("segment"),
                               F.coalesce("subroot", "passed").alias("subroot")), "merkle-links")


def manifest(rows: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", *carried: Column) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof (array of left and right siblings from the leaf up), and the `carried` columns."""
    extra = [c.alias(f"extra{k}") for k, c in enumerate(carried)]
    names = [f"extra{k}" for k in range(len(carried))]
    # texts are hashed once; the number makes the order of equal rows definite
    leaves = staged(rows.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), *extra,
                                F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    placed = staged(numbered(leaves, ["grp", "id", "leaf", "row"], "merkle-order").drop("row"), "merkle-placed")
    groups = numbered(placed.groupBy("grp").agg(F.min("place").alias("begins"), F.count("*").alias("size")), ["begins"], "merkle-groups")
    groups = staged(groups.withColumnRenamed("place", "tree"), "merkle-trees")
    most, trees = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()

    own = groups.select(F.col("grp").alias("own"), "begins", "size", "tree")
    leaf_rows = placed.join(own, F.col("grp").eqNullSafe(F.col("own")))
    packs = leaf_rows.groupBy("tree", "size", F.expr(f"(place - begins) div {FAN_OUT}").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("place", "leaf", "id", *names))).alias("kids"))
    lone = F.col("size") == 1
    packs = staged(packs.select(
        "tree", F.when(lone, 0).otherwise(1).cast("int").alias("level"), "idx",
        F.when(lone, F.col("kids")[0]["leaf"]).otherwise(F.sha2(F.array_join(F.col("kids.leaf"), ""), 256)).alias("hash"),
        F.array_min("kids.place").alias("first"), F.array_max("kids.place").alias("last"),
        F.expr(f"(size + {FAN_OUT - 1}) div {FAN_OUT}").alias("many"), "kids"), "merkle-packs")

    child = F.struct(*KEY).alias("child")
    bottom = packs.select(*KEY, "hash", "first", "last", "many", child)
    levels = _levels(bottom, -(-most // FAN_OUT))
    tops = bottom
    for level in levels:
        tops = tops.unionByName(level.select(*KEY, "hash", "first", "last", "many", child))
    tops = staged(tops.where("many = 1").select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "hash", "first", "last",
        F.lit(trees).cast("long").alias("many"), "child"), "merkle-subroots")
    over = _levels(tops, trees)
    root = (over[-1] if over else tops).select("hash").first()  # one row, or none in an empty table
    root = F.lit(root[0] if root else None).cast("string")

    links = [_links(level, False) for level in levels] + [_links(level, k == 0) for k, level in enumerate(over)]
    height, reach = len(links), 1
    if links:
        table = links[0]
        for other in links[1:]:
            table = table.unionByName(other)
        table = staged(table, "merkle-links")
        while reach < height:
            table = _jump(table)
            reach *= 2
        packs = packs.join(table.select(*KEY, "segment", "subroot"), list(KEY), "left")
    else:
        packs = packs.withColumn("segment", F.lit(None).cast(f"array<{STEP}>")).withColumn("subroot", F.lit(None).cast("string"))

    out = packs.withColumn("hashes", F.col("kids.leaf")).select(
        "level", "segment", "subroot", "hashes", F.posexplode("kids").alias("at", "kid"))
    way = F.coalesce("segment", F.expr(f"cast(array() as array<{STEP}>)"))
    proof = F.when(F.col("level") == 0, way).otherwise(F.concat(F.array(_step("hashes", "at")), way))
    return out.select(F.col("kid.id").alias(id_col), F.col("kid.leaf").alias("leaf"), F.coalesce("subroot", root).alias("subroot"),
                      root.alias("root"), proof.alias("proof"), *[F.col(f"kid.{n}").alias(n) for n in names])


def op13_merkle(spark, folder: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the crc32 of the id, the way is also walked from a tampered text."""
    docs = docs_of(spark, folder)
    plain = [docs[c] for c in FIELDS]
    changed = [F.translate(c, UPPER, LOWER) if name == "text" else c for name, c in zip(FIELDS, plain, strict=True)]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0  # a null id is left as it is
    rows = manifest(docs, leaf_hash(plain), "doc_id", "source", F.when(hit, leaf_hash(changed)))
    folded = fold(F.coalesce("extra0", "leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                       folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
