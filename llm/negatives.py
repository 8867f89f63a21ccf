"""Hard negatives by a secondary-sort shuffle.

Anchors are a stated set of rows. Rows are dealt to blocks by hash; every anchor visits every block once, and a block scores all its
rows against the anchors that stream by (exact integer products). What a block sends on is bounded, and exact:

1. of the rows of the anchor's label, the best `positives` of the block; the best of all blocks are the anchor's positives;
2. with these known, of the rows of other labels the first `negatives` of the block below each positive.

Positives and negatives are then packed into keys (anchor, descending score, positive before negative, id), partitioned by the anchor
and sorted within partitions by the whole key (`repartition` and `sortWithinPartitions`, the DataFrame form of
repartitionAndSortWithinPartitions). An iterator reads the sorted pairs once: a positive opens a window, a negative goes to every open
window that its score reaches and that is not full. It holds at most `positives` windows, never an anchor's pairs.

Blocks hold `BLOCK_BYTES` of vectors at most, so a task holds one block, whatever the number of rows or anchors.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no part; equal rows count once, rows
that share an id but differ are rows of their own, and a row is never its own positive; rows of another vector length than the anchor's
do not meet it; components and products beyond 64 bits stay at the limit; ties by id; anchors without a positive, and positives
without a negative in reach, give no rows; an empty table gives none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import staged

BLOCK_BYTES, SCORES = 32 << 20, 1 << 22
LIMIT = (1 << 63) - 1
_PAIR = "anchor long, anchor_row long, score long, id long"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, taken as double; null where a component is null or not finite."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.lit(float(factor)) * v)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(v)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: floats while every sum is a whole number they hold, else Python's integers, cut to 64 bits."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = max(1, -int(a.min()), int(a.max())) * max(1, -int(b.min()), int(b.max())) * a.shape[1]
    if top < 1 << 53:
        kind = np.float32 if top < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def _best(score: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `most` greatest scores that fit in every row; ties by column."""
    s = np.where(fits, score, -LIMIT - 1)
    if s.shape[1] > most:
        least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        row, col = np.nonzero(fits & (s >= least[:, None]))
    else:
        row, col = np.nonzero(fits)
    order = np.lexsort((col, ~s[row, col], row))  # ~s descends without overflow
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[keep], col[keep]


def _positives(most: int):
    def pick(score, label, ids, key, batch):
        same = (label[None] == batch["label"][:, None]) & ((ids[None] != batch["id"][:, None]) | (key[None] != batch["row"][:, None]))
        return _best(score, same, most)
    return pick


def _negatives(most: int, percent: int):
    def pick(score, label, ids, key, batch):
        other = label[None] != batch["label"][:, None]
        found = []
        for k in range(max((len(p) for p in batch["goals"]), default=0)):
            goal = [int(p[k]) if len(p) > k else None for p in batch["goals"]]
            high = np.array([-LIMIT - 1 if g is None else g for g in goal])[:, None]
            low = np.array([LIMIT if g is None else min(LIMIT, -(-percent * g // 100)) for g in goal])[:, None]  # rounded up
            found.append(np.stack(_best(score, other & (score <= high) & (score >= low), most)))
        pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]
    return pick


def _meet(pick):
    """Rows of a block come first and are held; the anchors that follow are scored against them, a bounded part at a time."""
    def stream(batches):
        at, held, block = None, [], None

        def close():
            rows = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("row", "ascending")]) if held else None
            if rows is None:
                return None
            ids, key, label = (rows.column(k).to_numpy() for k in ("id", "row", "label"))
            new = np.r_[True, (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])]  # equal rows count once
            vectors = _matrix(rows.column("vector").combine_chunks())
            return vectors[new], label[new], ids[new], key[new]

        for batch in batches:
            place = np.stack([batch.column(k).to_numpy() for k in ("block", "length")], 1)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)])
            for start, stop in zip(edges, np.r_[edges[1:], len(place)], strict=True):
                if at is None or tuple(place[start]) != at:
                    at, held, block = tuple(place[start]), [], None
                part = batch.slice(start, stop - start)
                visiting = np.asarray(part.column("visits"))
                first = int(np.argmax(visiting)) if visiting.any() else len(part)
                if first:
                    held.append(part.slice(0, first))
                if first == len(part):
                    continue
                if block is None:
                    block = close()
                    held = []
                if block is None:
                    continue
                vectors, label, ids, key = block
                step = max(1, SCORES // len(ids))
                for a in range(first, len(part), step):
                    some = part.slice(a, step)
                    mine = {k: some.column(k).to_numpy() for k in ("id", "row", "label")} | {"goals": some.column("goals").to_pylist()}
                    score = _products(_matrix(some.column("vector")), vectors)
                    r, c = pick(score, label, ids, key, mine)
                    yield pa.RecordBatch.from_arrays([pa.array(mine["id"][r]), pa.array(mine["row"][r]), pa.array(score[r, c]),
                                                      pa.array(ids[c])], names=["anchor", "anchor_row", "score", "id"])
    return stream


def _windows(most: int, percent: int):
    """Reads pairs in key order. A positive opens a window; a negative fills the windows it reaches."""
    def stream(batches):
        anchor, open_windows = None, []
        for batch in batches:
            out = []
            columns = [batch.column("key").field(k).to_pylist() for k in range(5)]
            for who, row, down, negative, other in zip(*columns, strict=True):
                if (who, row) != anchor:
                    anchor, open_windows = (who, row), []
                score = ~down
                if not negative:
                    open_windows.append([other, score, 0])
                    continue
                for window in open_windows:
                    if window[2] < most and percent * window[1] <= 100 * score:
                        window[2] += 1
                        out.append((who, window[0], window[2], other, window[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return stream


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
         positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """For every anchor and each of its best `positives` rows of the same label, the first `negatives` rows of other labels whose score is
    at most the positive's and at least `percent` of it. `vector_col` holds whole numbers (array<bigint>)."""
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("leads"))
    rows = rows.withColumn("row", F.xxhash64("label", "vector")).withColumn("length", F.size("vector"))
    rows = staged(rows, "vectors")
    spark = rows.sparkSession
    count, length = rows.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(0))).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-count * length * 8 // BLOCK_BYTES), min(width, -(-count // 512)))

    members = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, row, 7), {blocks}) as int)"))
    anchors = staged(rows.where("leads").dropDuplicates(["id", "row"]), "anchors")

    def met(leading: DataFrame, pick) -> DataFrame:
        kind = "array<bigint>"
        visits = leading.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = members.select("block", "length", F.lit(False).alias("visits"), "id", "row", "label", "vector",
                              F.lit(None).cast(kind).alias("goals"))
        both = both.unionByName(visits.select("block", "length", F.lit(True).alias("visits"), "id", "row", "label", "vector", "goals"))
        both = both.repartitionById(blocks, "block").sortWithinPartitions("block", "length", "visits")
        return both.mapInArrow(_meet(pick), _PAIR)

    best = Window.partitionBy("anchor", "anchor_row").orderBy(F.desc("score"), "id")
    no_goals = anchors.withColumn("goals", F.lit(None).cast("array<bigint>"))
    chosen = staged(met(no_goals, _positives(positives)).withColumn("at", F.row_number().over(best)).where(
        F.col("at") <= positives), "positives")
    goals = chosen.groupBy(F.col("anchor").alias("id"), F.col("anchor_row").alias("row")).agg(F.collect_set("score").alias("goals"))
    below = met(anchors.join(goals, ["id", "row"]), _negatives(negatives, percent))

    def keys(pairs, negative):
        return pairs.select(F.struct("anchor", "anchor_row", F.bitwise_not("score").alias("down"), F.lit(negative).alias("negative"),
                                     F.col("id").alias("other")).alias("key"))

    pairs = keys(chosen, False).unionByName(keys(below, True))
    pairs = pairs.repartition(F.col("key.anchor"), F.col("key.anchor_row")).sortWithinPartitions("key")
    return pairs.mapInArrow(_windows(negatives, percent), "anchor_id long, positive_id long, rank int, negative_id long, "
                            "positive_score long, negative_score long")


def op11_hard_negatives(spark, folder: str) -> DataFrame:
    """Anchors: ids divisible by 100; labels of ids divisible by 7 are moved on by one."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), scaled(F.col("embedding")).alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)


#: The same in SQL, by comparing every anchor with every row.
NEGATIVES_SQL = """
with vectors as (
    select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
    select a.vec_id as anchor_id, r.vec_id as id, r.label = a.label as same,
        cast(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
    from vectors a join vectors r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 100 = 0),
positives as (
    select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (
    select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
        cast(row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as integer) as rank
    from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
        and 80 * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
