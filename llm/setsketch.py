"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct five-word shingles. Register i of its sketch is the truncated, exponentially spaced minimum
floor(1 - log_b(min over the set of h_i)), h_i exponential: two sketches merge by their maxima, and registers agree with
a probability that follows the Jaccard similarity.

1. One pass over the texts gives the set's size, a 128-bit digest and the band keys (`rows_for` registers each). Documents of
   equal sets form a class, known by its smallest id and its digest (`UNIT`: ids may be shared by unlike texts); from here on only
   classes count, and ids come back last.
2. Representatives that share a band key are neighbours. Only those get a full sketch and their set written down.
3. Candidates are judged by the joint likelihood of their registers given both set sizes, then confirmed on the full sets.
   Nothing is linked without that.
4. Candidates come in rounds, so that a large group is never paired with itself. First each entry meets its bucket's
   smallest member and its neighbour by size. Links so far give components. Then, only across components, each entry meets
   its two likeliest partners; last, all likely partners that are still in another component. The last round leaves out
   nothing that the sketches call likely, so no link that would join two components is lost. Large buckets are compared
   block by block.

With 42 bands of six registers, two sets at a similarity of 0.85 share none with probability 2e-9 (0.8, five registers: 6e-8);
the likelihood cut-off is 4.4 standard deviations below the threshold.

Defined cases: null or empty texts and texts without words have an empty set and are linked with nothing; texts of fewer
words than a shingle have one shingle; rows that share an id are documents of their own, linked only if their sets are; a null id is
smaller than all others and yields a null component; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import NULL_ID, keyed, unkeyed
from llm.textbytes import LOWER, RollingHash, mix, row_groups, sentence_hashes, text_bytes, word_spans
from tidegauge.session import staged

WIDTH, BANDS, REGISTERS, BLOCK = 5, 42, 384, 1024
BASE = 1.001
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.default_rng(20240901)
_MULT = _rng.integers(0, 1 << 32, (2, REGISTERS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIDDLE = 32000
#: A class: its smallest id, then its digest. The smallest unit of a component has the component's smallest id.
UNIT = "struct<r:bigint,x:bigint,y:bigint>"
_FIELDS = ("r", "x", "y")


def rows_for(threshold: float) -> int:
    """Registers in a band: six at a threshold of 0.85, five at 0.8, so that a pair just there shares a band all but surely."""
    return min(REGISTERS // BANDS, max(1, int(math.log(0.325) / math.log(threshold)))) if threshold < 1 else REGISTERS // BANDS


def cut_for(threshold: float) -> float:
    """What a pair's likely similarity must reach to be confirmed: 4.4 standard deviations below the threshold."""
    return threshold - 4.4 * math.sqrt(max(threshold * (1 - threshold), 0.05) / REGISTERS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each row, and the row bounds in them."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, NOT_SPACE)
    h, row = sentence_hashes(RollingHash(low).ranges(starts, ends), first, width)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)]
    return h[keep], np.searchsorted(row[keep], np.arange(len(offsets)))


def minima(h: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """The least 32-bit value of each register over each non-empty set (rows in order)."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((count, len(full)), np.uint32)
    high, low = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
    for i in range(count):
        x = high * _MULT[0, i]
        x += low * _MULT[1, i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        out[i] = np.minimum.reduceat(x, bounds[:-1][full]) if len(full) else 0
    return out.T


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch register values of the minima, in 16 bits."""
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + _MIDDLE - 12000, 0, 65535).astype(np.uint16)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood, for rows of register pairs with known set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def score(j):
        more, less = chance(u - v * j), chance(v - u * j)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(22):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = score(x) > score(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _rows(batches):
    """All columns but the text, bytes and offsets in runs of bounded size."""
    for batch in batches:
        others = [batch.column(k) for k in batch.schema.names if k != "text"]
        data, offsets = text_bytes(batch.column("text"))
        for a, b in row_groups(offsets):
            yield [c.slice(a, b - a) for c in others], data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _digest(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums over each set's hashes (zero for an empty set)."""
    full, digest = np.flatnonzero(np.diff(bounds)), np.zeros((2, len(bounds) - 1), np.uint64)
    for i, x in enumerate((mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
        digest[i, full] = np.add.reduceat(x, bounds[:-1][full]) if len(full) else 0
    return digest.view(np.int64)


def _units(r, x, y) -> pa.StructArray:
    return pa.StructArray.from_arrays([r if isinstance(r, pa.Array) else pa.array(r), pa.array(x), pa.array(y)], names=list(_FIELDS))


def _parts(units: pa.StructArray) -> np.ndarray:
    return np.stack([units.field(k).to_numpy() for k in range(3)], 1)


def _sketch(width: int, rows: int):
    def sketch(batches):
        for ids, data, offsets in _rows(batches):
            h, bounds = shingle_sets(data, offsets, width)
            full, n = np.flatnonzero(np.diff(bounds)), len(offsets) - 1
            reg = registers(minima(h, bounds, BANDS * rows)).astype(np.uint64).reshape(len(full), BANDS, rows)
            key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(full), 0)
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + reg[:, :, i])
            digest = _digest(h, bounds)
            filled = np.zeros(n + 1, np.int32)
            filled[full + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(np.diff(bounds)), pa.array(digest[0]), pa.array(digest[1]),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(filled).astype(np.int32)), pa.array(key.ravel().view(np.int64)))],
                names=["id", "t1", "t2", "n", "d1", "d2", "bands"])
    return sketch


def _members(width: int):
    def members(batches):
        for ids, data, offsets in _rows(batches):
            h, bounds = shingle_sets(data, offsets, width)
            full = np.flatnonzero(np.diff(bounds))
            reg, digest = registers(minima(h, bounds, REGISTERS)), _digest(h, bounds)
            yield pa.RecordBatch.from_arrays(
                [_units(ids[0].take(pa.array(full)), digest[0, full], digest[1, full]), pa.array(np.diff(bounds)[full]), pa.array([r.tobytes() for r in reg], pa.binary()),
                 pa.array([h[bounds[i]:bounds[i + 1]].tobytes() for i in full], pa.binary())],
                names=["id", "n", "registers", "shingles"])
    return members


def _registers(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].view(np.uint16).reshape(len(column), REGISTERS)


def _confirm(threshold: float):
    def confirm(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in ("shingles_a", "shingles_b"))
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= round(100 * threshold) * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return confirm


def _likely(threshold: float):
    cut = cut_for(threshold)

    def likely(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(float) for k in ("n_a", "n_b"))
            j = likely_jaccard(_registers(batch.column("r_a")), _registers(batch.column("r_b")), na, nb)
            keep = (j >= cut) & (np.minimum(na, nb) >= (threshold - 1e-9) * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return likely


def _pairs_of(first: int, stop: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs to compare in one work item: all of a block, or those across its two blocks."""
    if side[first:stop].max() < 0:
        a, b = np.triu_indices(stop - first, 1)
        return a + first, b + first
    left, right = first + np.flatnonzero(side[first:stop] == 0), first + np.flatnonzero(side[first:stop] == 1)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _compare(t: pa.RecordBatch, threshold: float, most: int | None) -> pa.RecordBatch:
    """Likely pairs across components in whole work items. A pair that shares several bands is judged in its first."""
    cut, rows = cut_for(threshold), rows_for(threshold)
    item = np.stack([t.column(k).to_numpy() for k in ("key", "i", "j")])
    bounds = np.flatnonzero(np.r_[True, (item[:, 1:] != item[:, :-1]).any(0), True])
    side, band, units = t.column("side").to_numpy(), t.column("band").to_numpy(), t.column("id")
    ids, comp = _parts(units), np.unique(_parts(t.column("component")), axis=0, return_inverse=True)[1].ravel()
    n, reg = t.column("n").to_numpy().astype(float), _registers(t.column("registers"))
    found: list[tuple[np.ndarray, ...]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judge(a, b):
        for x in range(0, len(a), 1 << 14):
            i, j = a[x:x + (1 << 14)], b[x:x + (1 << 14)]
            same = reg[i] == reg[j]
            ok = same.mean(1) >= cut - 0.06
            i, j, same = i[ok], j[ok], same[ok]
            ok = same[:, :BANDS * rows].reshape(len(i), BANDS, rows).all(2).argmax(1) == band[i]
            i, j = i[ok], j[ok]
            if len(i):
                est = likely_jaccard(reg[i], reg[j], n[i], n[j])
                found.append((i[est >= cut], j[est >= cut], est[est >= cut]))

    def flush():
        if waiting:
            judge(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            waiting.clear()

    total = 0
    for first, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        a, b = _pairs_of(first, stop, side)
        ok = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) >= (threshold - 1e-9) * np.maximum(n[a], n[b]))
        waiting.append((a[ok], b[ok]))
        total += int(ok.sum())
        if total > 1 << 16:
            flush()
            total = 0
    flush()
    a, b, est = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if most and len(a):
        end, pair, j = np.r_[a, b], np.r_[np.arange(len(a)), np.arange(len(a))], np.r_[est, est]
        order = np.lexsort((pair, -j, end))
        start = np.flatnonzero(np.r_[True, end[order][1:] != end[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        keep = np.unique(pair[order[rank < most]])
        a, b = a[keep], b[keep]
    a, b = a.astype(np.int64), b.astype(np.int64)
    turned = np.zeros(len(a), bool)
    for k in (2, 1, 0):
        turned = (ids[a, k] > ids[b, k]) | ((ids[a, k] == ids[b, k]) & turned)
    low, high = np.where(turned, b, a), np.where(turned, a, b)
    return pa.RecordBatch.from_arrays([units.take(pa.array(low)), units.take(pa.array(high))], names=["a", "b"])


def _across(threshold: float, most: int | None):
    """Compares sorted work items as they stream by; holds back only the last, which may go on (2 * BLOCK rows)."""
    def stream(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            item = np.stack([batch.column(k).to_numpy() for k in ("key", "i", "j")])
            last = int(np.flatnonzero((item != item[:, -1:]).any(0))[-1]) + 1 if (item != item[:, -1:]).any() else 0
            held = batch.slice(last)
            if last:
                yield _compare(batch.slice(0, last), threshold, most)
        if held is not None:
            yield _compare(held, threshold, most)
    return stream


def _confirmed(pairs: DataFrame, members: DataFrame, threshold: float, judge: bool) -> DataFrame:
    """The pairs whose full sets reach the threshold, as a table."""
    def side(k, *cols):
        return members.select(F.col("id").alias(k), *[F.col(c).alias(f"{alias}{k}") for c, alias in cols])

    if judge:
        regs = (("n", "n_"), ("registers", "r_"))
        pairs = pairs.join(side("a", *regs), "a").join(side("b", *regs), "b").mapInArrow(
            _likely(threshold), f"a {UNIT}, b {UNIT}")
    sets = (("shingles", "shingles_"),)
    full = pairs.join(side("a", *sets), "a").join(side("b", *sets), "b")
    return staged(full.mapInArrow(_confirm(threshold), f"a {UNIT}, b {UNIT}"), "links")


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, component) of every linked id, component being the smallest id reachable. Each round points every id at the
    smallest id that it or a neighbour knows, then follows that id's own pointer; rounds end when nothing moves. `before`: the
    components of some of the links, from which the rounds then start."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = staged(both, "edges")
    comp = both.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("component"))
    if before is not None:
        comp = comp.join(before.withColumnRenamed("component", "was"), "id", "left").select("id", F.least("component", "was").alias("component"))
    comp = staged(comp, "components")
    while True:
        near = both.join(comp.select(F.col("id").alias("other"), F.col("component").alias("seen")), "other").groupBy("id").agg(
            F.min("seen").alias("seen"))
        down = comp.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        # the old root learns of the smaller one too, so whole trees move at once
        roots = down.where("component < old").groupBy(F.col("old").alias("id")).agg(F.min("component").alias("better"))
        down = down.join(roots, "id", "left").select("id", "old", F.least("component", "better").alias("component"))
        hop = down.select(F.col("id").alias("component"), F.col("component").alias("root"))
        moved = staged(down.join(hop, "component", "left").select(
            "id", F.coalesce("root", "component").alias("component"), "old"), "components")
        comp = moved.select("id", "component")
        if moved.where("component <> old").isEmpty():
            return comp


def _far(entry: DataFrame, comp: DataFrame, members: DataFrame) -> DataFrame:
    """Work items (key, i, j): blocks of a bucket that hold different components, as rows of both. A bucket's rows are cut into blocks in
    order of component, so that a large component fills blocks of its own, and those are not set against each other."""
    far = entry.join(comp, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    whole = lambda *by: Window.partitionBy("key", *by)
    far = far.withColumn("lo", F.min("component").over(whole())).withColumn("hi", F.max("component").over(whole())).where("lo <> hi")
    far = far.withColumn("block", F.floor((F.row_number().over(whole().orderBy("component", "id")) - 1) / BLOCK))
    far = far.withColumn("blocks", F.max("block").over(whole()) + 1)
    far = far.withColumn("mixed", F.min("component").over(whole("block")) != F.max("component").over(whole("block")))
    # a component's own blocks stand together, from `own` to `last`
    far = far.withColumn("own", F.min(F.when(~F.col("mixed"), F.col("block"))).over(whole("component")))
    far = far.withColumn("last", F.max(F.when(~F.col("mixed"), F.col("block"))).over(whole("component")))
    work = F.expr("transform(filter(sequence(0, blocks - 1), x -> mixed or x < own or x > last), x -> struct(least(x, block) as i, "
                  "greatest(x, block) as j, case when x = block then -1 when block < x then 0 else 1 end as side))")
    far = far.select("key", "band", "id", "component", F.explode(work).alias("w")).select("key", "band", "id", "component", "w.*")
    far = far.join(members.select("id", "n", "registers"), "id")
    return far.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _assigned(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """One row per document: id (never null), a 128-bit hash of the text (t1, t2), n, and its class and component, null for empty sets."""
    texts = keyed(docs, id_col, text_col)
    hashed = texts.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"), "text")
    sketches = staged(hashed.mapInArrow(_sketch(width, rows_for(threshold)), "id long, t1 long, t2 long, n long, d1 long, d2 long, "
                                        "bands array<long>"), "sketches")
    same = sketches.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    same = same.withColumn("unit", F.struct(F.col("rep").alias("r"), F.col("d1").alias("x"), F.col("d2").alias("y")))
    entry = same.select("n", F.col("unit").alias("id"), F.posexplode("bands").alias("band", "key"))
    bucket = Window.partitionBy("key")
    entry = staged(entry.withColumn("head", F.min("id").over(bucket.orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                   .withColumn("before", F.lag("id").over(bucket.orderBy("n", "id")))
                   .withColumn("after", F.lead("id").over(bucket.orderBy("n", "id")))
                   .where(F.col("before").isNotNull() | F.col("after").isNotNull()).drop("after"), "entries")
    # all texts of an id that stands for a class: one of them has the class's set, the others are of no class in question
    involved = entry.select(F.col("id.r").alias("id")).distinct()
    chosen = hashed.join(involved, "id", "left_semi").dropDuplicates(["id", "t1", "t2"]).select("id", "text")
    members = staged(chosen.mapInArrow(_members(width), f"id {UNIT}, n long, registers binary, shingles binary"), "members")

    ordered = lambda x: F.struct(F.least("id", x).alias("a"), F.greatest("id", x).alias("b"))
    pairs = entry.select(F.explode(F.array(ordered("head"), ordered("before"))).alias("p")).select("p.*").where("a <> b").distinct()
    links = _confirmed(pairs, members, threshold, True)
    comp = components(links)
    for most in (2, None):
        pairs = _far(entry, comp, members).mapInArrow(_across(threshold, most), f"a {UNIT}, b {UNIT}").distinct()
        links = links.unionByName(_confirmed(pairs, members, threshold, False))
        comp = components(links, comp)

    known = same.select("n", "d1", "d2", "unit").join(comp.withColumnRenamed("id", "unit"), "unit", "left").select(
        "n", "d1", "d2", "unit", F.coalesce("component", "unit").alias("component"))
    return sketches.select("id", "t1", "t2", "n", "d1", "d2").join(known, ["n", "d1", "d2"], "left").drop("d1", "d2")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
            width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (it is the document's own)."""
    out = _assigned(docs, id_col, text_col, threshold, width).select("id", "n", F.coalesce("component.r", "id").alias("component"))
    return out.select(unkeyed().alias(id_col), F.col("n").alias("n_shingles"), unkeyed("component").alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, of which one row of each near-duplicate group stays: the smallest id's; if several rows share it,
    that of the least text hash, and of rows equal in id and text any one. Documents without words are in no group and stay."""
    rows = staged(_assigned(docs, id_col, text_col, threshold, WIDTH).where("component is not null").select(
        "component", F.struct("id", "t1", "t2").alias("row")), "assigned")
    best = rows.groupBy("component").agg(F.min("row").alias("best"))
    copies = rows.groupBy("component", "row").agg(F.count(F.lit(1)).alias("copies"))
    judged = staged(copies.join(best, "component").select("row.*", "copies", (F.col("row") == F.col("best")).alias("stays")), "judged")
    on = [F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_near_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_near_t1"),
          F.xxhash64(F.lit(5), F.coalesce(docs[text_col], F.lit(""))).alias("_near_t2")]
    names = ["_near_id", "_near_t1", "_near_t2"]
    marked = docs.select("*", *on)
    listed = lambda which: judged.where(which).select(*[F.col(k).alias(n) for k, n in zip(("id", "t1", "t2"), names, strict=True)])
    repeated = listed("stays and copies > 1")
    single = marked.join(listed("not stays or copies > 1"), names, "left_anti").drop(*names)
    if repeated.isEmpty():
        return single
    return single.unionByName(marked.join(repeated, names, "left_semi").dropDuplicates(names).drop(*names))
