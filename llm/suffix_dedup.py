"""Removal of repeated byte strings by bucket-pointer refinement.

Every `length`-byte string that also starts earlier in the corpus is found exactly, and its bytes go.

1. Initial buckets. A q-gram at some offset is a string's bucket pointer: the q-gram of least hash within the string
   (leftmost of equals), so equal strings point to equal buckets at equal distance. The strings of one pointer are
   neighbours, and one record stands for all of them. A bucket with one record is a singleton and is finished.
2. Refinement. A bucket's records are sorted on the identifier of what follows at the later offsets: the hash of all
   bytes that the record's strings cover. A record whose refined bucket began earlier is finished too: all its strings
   are repeats. The first record of a refined bucket stays open only if its initial bucket holds another refined one.
3. Last refinement. Only strings of open records are sorted on their full identifier (95 bits of hash, offset by offset).
   Each but the first is a repeat. The records' updates of step 2 are reused here: nothing finished is looked at again.

Each step is one shuffle of fixed-size records; equal keys are read as a sorted stream, never held as a group. A batch
settles its own repeats before the shuffle, as one range a run. The text is shuffled once, by document and compressed, for step 3
and the cut. A document is an id and, where unlike texts share the id, a hash of its text (`row`, else 0).

Defined cases: null text has no bytes; texts under `length` bytes have no strings and lose nothing; rows that share an id never
count as earlier than each other: each loses what a smaller id has or what it repeats itself, equal rows the same; a null id sorts
before all others; a text of a gibibyte or more is an error; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import keyed, unkeyed
from llm.textbytes import CHUNK, RollingHash, combine, mix, row_groups, sliding_min, text_bytes
from tidegauge.session import staged

LENGTH, Q = 100, 48
_POSITION = np.uint64((1 << 24) - 1)
_FINISHED = np.uint64(63)


def pointers(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Records of the strings of these rows: initial bucket, refined identifier, first and last start (in `data`)."""
    grams = RollingHash(data)
    h = grams.windows(q)
    key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(key, length - q + 1)
    starts = np.arange(len(least))
    ends = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    inside = starts + length <= ends
    starts, at = starts[inside], (least[inside] & _POSITION).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts, starts)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last, at = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], at[new]
    shape = ((at - first) * 256 + (last - first)).astype(np.uint64)
    return h[at], combine(grams.ranges(first, last + length), shape), first, last


def batch_pointers(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """The same for a batch of any size: in pieces of bounded memory, a long text in overlapping ones."""
    parts = []
    for a, b in row_groups(offsets):
        base, end = int(offsets[a]), int(offsets[b])
        for x in range(base, max(end - length + 1, base + 1), CHUNK):
            stop = min(x + CHUNK + length - 1, end)
            own = offsets[a:b + 1] - x if b - a > 1 or end - base <= CHUNK else np.array([0, stop - x])
            m, c, s, e = pointers(data[x:stop], np.clip(own, 0, stop - x), length, q)
            parts.append((m, c, s + x, e + x))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(4))


def _pack(batches):
    """Texts as zstd blocks: what the block codec of a shuffle leaves is a third more."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(packed, pa.binary())], names=["id", "row", "packed"])


def unpacked(batch: pa.RecordBatch):
    """Slices of a batch with the bytes and offsets of their texts, in runs of bounded size."""
    expand, rows, texts, size = zstandard.ZstdDecompressor(), 0, [], 0
    for x in batch.column("packed"):
        texts.append(expand.decompress(x.as_py()))
        size += len(texts[-1])
        if size >= CHUNK:
            yield batch.slice(rows, len(texts)), *text_bytes(pa.array(texts, pa.large_binary()))
            rows, texts, size = rows + len(texts), [], 0
    if texts:
        yield batch.slice(rows, len(texts)), *text_bytes(pa.array(texts, pa.large_binary()))


def by_id(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row hashes, bytes and offsets of a batch, rows in order of both."""
    ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("id", "row"))
    texts = batch.column("text")
    order = np.lexsort((rows, ids))
    if (order[1:] < order[:-1]).any():
        ids, rows, texts = ids[order], rows[order], texts.take(pa.array(order))
    data, offsets = text_bytes(texts)
    if len(data) and int(np.diff(offsets).max()) >= 1 << 30:
        raise ValueError("a text of a gibibyte or more")
    return ids, rows, data, offsets


def later_than_first(key: np.ndarray, ids: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks what has an equal key at an earlier place (a smaller id, or the same document and an earlier start), among records
    in order of id, row and start."""
    order = np.argsort(key, kind="stable")
    k, i, r, s = key[order], ids[order], rows[order], start[order]
    head = np.r_[True, k[1:] != k[:-1]][:len(k)]
    own = head | np.r_[True, (i[1:] != i[:-1]) | (r[1:] != r[:-1])][:len(k)]
    out = np.zeros(len(key), bool)
    if len(k):
        first, mine = np.flatnonzero(head)[np.cumsum(head) - 1], np.flatnonzero(own)[np.cumsum(own) - 1]
        out[order] = (i > i[first]) | (s > s[mine]) & (i == i[first])
    return out


def pieces(owner: np.ndarray, start: np.ndarray, end: np.ndarray, most: int):
    """The same ranges, none longer than `most`."""
    if not len(owner) or int((end - start).max()) <= most:
        return owner, start, end
    many = -(-(end - start) // most)
    nth = np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    owner, first, stop = np.repeat(owner, many), np.repeat(start, many) + nth * most, np.repeat(end, many)
    return owner, first, np.minimum(first + most, stop)


def runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Joins touching ranges of one owner; input in order of owner and start, ends not falling."""
    if not len(owner):
        return owner, start, end
    cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])])
    return owner[cut], start[cut], end[np.r_[cut[1:] - 1, len(owner) - 1]]


def _initial(length: int, q: int):
    def records(batches):
        for batch in batches:
            ids, rows, data, offsets = by_id(batch)
            m, c, s, e = batch_pointers(data, offsets, length, q)
            owner = np.searchsorted(offsets, s, "right") - 1
            s, e = s - offsets[owner], e - offsets[owner]
            again = later_than_first(combine(m, c), ids[owner], rows[owner], s)
            o2, s2, e2 = pieces(*runs(owner[again], s[again], e[again] + length), (1 << 28) - 1)
            keep = ~again
            m, c, own, s, e = m[keep], c[keep], owner[keep], s[keep].astype(np.uint64), e[keep].astype(np.uint64)
            # 36 bits of bucket and 56 of identifier, then 30 of start and 6 of count; a finished range has its length
            # (28 bits) for the identifier and a count of 63
            head = ((m >> np.uint64(28)) << np.uint64(28)) | (c >> np.uint64(36))
            tail = (((c >> np.uint64(8)) & np.uint64((1 << 28) - 1)) << np.uint64(36)) | (s << np.uint64(6)) | (e - s)
            head2 = mix(ids[o2].astype(np.uint64) + s2.astype(np.uint64))
            tail2 = ((e2 - s2).astype(np.uint64) << np.uint64(36)) | (s2.astype(np.uint64) << np.uint64(6)) | _FINISHED
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[head, head2].view(np.int64)), pa.array(np.r_[tail, tail2].view(np.int64)),
                                              pa.array(ids[np.r_[own, o2]]), pa.array(rows[np.r_[own, o2]])], names=["head", "tail", "id", "row"])
    return records


def _refine(length: int):
    """Reads records sorted by bucket, identifier, document and place. Gives ranges of repeats, and open records (first and last
    start). Holds one record back: the first of a bucket that has shown one identifier so far. A record of the least id of its
    identifier is a repeat only of an earlier one of its own document; the first of each such document is open."""
    def stream(batches):
        last_m = last_c = last_d = None
        own0 = at0 = 0
        held = None
        for batch in batches:
            head = batch.column("head").to_numpy().view(np.uint64)
            tail = batch.column("tail").to_numpy().view(np.uint64)
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            passed = (tail & np.uint64(63)) == _FINISHED
            start = ((tail >> np.uint64(6)) & np.uint64((1 << 30) - 1)).astype(np.int64)
            out = [(ids[passed], rows[passed], start[passed], start[passed] + (tail[passed] >> np.uint64(36)).astype(np.int64), False)]
            head, tail, ids, rows, start = (x[~passed] for x in (head, tail, ids, rows, start))
            if len(head):
                m, c_hi, c_lo = head >> np.uint64(28), head, tail >> np.uint64(36)
                end = start + (tail & np.uint64(63)).astype(np.int64)
                pm, pc = (m[:1] + np.uint64(1), (c_hi[:1], c_lo[:1])) if last_m is None else (last_m, last_c)
                new_m = np.r_[pm, m[:-1]] != m
                new_c = new_m | (np.r_[pc[0], c_hi[:-1]] != c_hi) | (np.r_[pc[1], c_lo[:-1]] != c_lo)
                before = (ids[0], rows[0]) if last_d is None else last_d
                new_d = new_c | (np.r_[before[0], ids[:-1]] != ids) | (np.r_[before[1], rows[:-1]] != rows)
                place = np.arange(len(head))
                where, mine = (np.maximum.accumulate(np.where(x, place, -1)) for x in (new_c, new_d))
                own1, at1 = np.where(where < 0, own0, ids[where]), np.where(mine < 0, at0, start[mine])
                again = (ids > own1) | ((ids == own1) & (start > at1))
                out.append((ids[again], rows[again], start[again], end[again] + length, False))
                first = np.flatnonzero(new_c)
                group = np.cumsum(new_m)[first]  # group 0 goes on from the batch before
                kinds = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 1)
                if kinds[0]:
                    if held is not None:
                        out.append((*held, True))
                    held = None
                is_open = (kinds[group] > 1) | (group == 0)
                top = int(np.cumsum(new_m)[-1])
                if top > 0:
                    held = None
                    if kinds[top] == 1:
                        k = first[-1:]
                        held = (ids[k], rows[k], start[k], end[k])
                f = np.r_[first[is_open], np.flatnonzero(new_d & ~new_c & (ids == own1))]
                out.append((ids[f], rows[f], start[f], end[f], True))
                last_m, last_c, last_d = m[-1:], (c_hi[-1:], c_lo[-1:]), (ids[-1], rows[-1])
                own0, at0 = own1[-1], at1[-1]
            cat = [np.concatenate([x[k] for x in out]) for k in range(4)]
            flag = np.concatenate([np.full(len(x[0]), x[4]) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(cat[0]), pa.array(cat[1]), pa.array(cat[2].astype(np.int32)),
                                              pa.array(cat[3].astype(np.int32)), pa.array(flag)], names=["id", "row", "start", "stop", "open"])
    return stream


def spread_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] values each."""
    total = int(count.sum())
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total) if total else np.zeros(0, np.int64)


def _strings(length: int):
    """The strings of open records with their hashes; repeats within the batch come out as ranges."""
    half = length // 2

    def grams(batches):
        for batch in batches:
            found = [[np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3]
            for part, data, offsets in unpacked(batch):
                opened = part.column("opened")
                lists = opened.flatten()
                ids, rows = (part.column(k).to_numpy(zero_copy_only=False) for k in ("id", "row"))
                owner = np.repeat(np.arange(len(part)), np.asarray(pa.compute.list_value_length(opened)))
                size = np.diff(offsets)[owner]
                f = np.minimum(lists.field("start").to_numpy().astype(np.int64), size - length)
                count = np.clip(np.minimum(lists.field("stop").to_numpy(), size - length) - f + 1, 0, None) * (size >= length)
                at, own = spread_out(f, count), np.repeat(owner, count)
                s, rolling = at + offsets[own], RollingHash(data)
                found.append([rolling.ranges(s, s + length), rolling.ranges(s, s + half), at, ids[own], rows[own]])
            h, more, at, own, row = (np.concatenate(x) for x in zip(*found, strict=True))
            # 64 bits of the string's hash and 31 of its first half's
            more = more & np.uint64((1 << 31) - 1)
            order = np.lexsort((at, row, own))
            h, more, at, own, row = (x[order] for x in (h, more, at, own, row))
            again = later_than_first(combine(h, more), own, row, at)
            new = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])][:len(own)]
            o2, s2, e2 = runs((np.cumsum(new) - 1)[again], at[again], at[again] + length)
            own2, row2 = own[new][o2], row[new][o2]
            h, more, at, own, row = (x[~again] for x in (h, more, at, own, row))
            # below the place: the hash's further bits, or the length of a finished range and a one
            low = np.r_[more.astype(np.int64) << 1, ((e2 - s2) << 1) | 1]
            key = np.r_[h, mix(own2.astype(np.uint64) + s2.astype(np.uint64))].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.r_[own, own2]), pa.array(np.r_[row, row2]),
                                              pa.array((np.r_[at, s2] << 32) | low)], names=["key", "id", "row", "place"])
    return grams


def _repeats(length: int):
    """Reads strings sorted by hash, document and place; gives the range of each that has an earlier one."""
    def stream(batches):
        last = None  # hash, further bits, id and row of the string before
        own0 = at0 = 0
        for batch in batches:
            key, ids, rows, place = (batch.column(k).to_numpy() for k in ("key", "id", "row", "place"))
            at, low = place >> 32, place & 0xFFFFFFFF
            passed = (low & 1) == 1
            out = [(ids[passed], rows[passed], at[passed], (at + (low >> 1))[passed])]
            key, low, ids, rows, at = (x[~passed] for x in (key, low, ids, rows, at))
            if len(key):
                was = last or (~key[0], low[0], ids[0], rows[0])
                head = (np.r_[was[0], key[:-1]] != key) | (np.r_[was[1], low[:-1]] != low)
                own = head | (np.r_[was[2], ids[:-1]] != ids) | (np.r_[was[3], rows[:-1]] != rows)
                where, mine = (np.maximum.accumulate(np.where(x, np.arange(len(key)), -1)) for x in (head, own))
                own1, at1 = np.where(where < 0, own0, ids[where]), np.where(mine < 0, at0, at[mine])
                again = (ids > own1) | ((ids == own1) & (at > at1))
                out.append((ids[again], rows[again], at[again], at[again] + length))
                last, own0, at0 = (key[-1], low[-1], ids[-1], rows[-1]), own1[-1], at1[-1]
            cat = [np.concatenate([x[k] for x in out]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.int32)),
                                              pa.array(cat[3].astype(np.int32))], names=["id", "row", "start", "stop"])
    return stream


def documents(texts: DataFrame) -> DataFrame:
    """`keyed` texts with `row`: 0, or where unlike texts share an id a hash of the text."""
    hashes = texts.select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = staged(hashes.where("low <> high").select("id", F.lit(True).alias("shared")), "shared-ids")  # its size chooses the join
    return texts.join(shared, "id", "left").select("id", F.when(F.col("shared"), F.xxhash64("text")).otherwise(0).alias("row"), "text")


def repeat_ranges(texts: DataFrame, length: int = LENGTH, q: int = Q) -> tuple[DataFrame, DataFrame]:
    """Ranges (id, row, start, stop) of repeated bytes of `documents`, overlapping ones included; and the texts, dealt by document
    as the ranges are."""
    if not q < length < q + 63:
        raise ValueError("q must be below length, and by less than 63: six bits hold a record's count")
    own = ["id", "row"]
    records = texts.mapInArrow(_initial(length, q), "head long, tail long, id long, row long")
    dealt = records.repartition(F.shiftrightunsigned("head", 28)).sortWithinPartitions(
        "head", F.shiftrightunsigned("tail", 36), *own, "tail")
    # ids are never null here; saying so keeps an inner join below from adding the filter to its own copy of the plan
    some = "id is not null and row is not null"
    found = dealt.mapInArrow(_refine(length), "id long, row long, start int, stop int, open boolean").where(some)
    spans = F.collect_list(F.when(F.col("open"), F.struct("start", "stop")))
    flags = found.groupBy(*own).agg(spans.alias("opened"),
                                    F.collect_list(F.when(~F.col("open"), F.struct("start", "stop"))).alias("closed"))
    by = texts.mapInArrow(_pack, "id long, row long, packed binary").where(some).repartition(*own)
    # both lists go along in both uses of `flags`, so that its exchange is one and is used twice; so is that of the texts
    opened = by.join(flags.where(F.size("opened") > 0), own)
    strings = opened.mapInArrow(_strings(length), "key long, id long, row long, place long")
    sorted_strings = strings.repartition("key").sortWithinPartitions("key", F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), *own, "place")
    late = sorted_strings.mapInArrow(_repeats(length), "id long, row long, start int, stop int")
    late = late.groupBy(*own).agg(F.collect_list(F.struct("start", "stop")).alias("late"))
    return flags.join(late, own, "full"), by


def _cut(digest_only: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest_only else "kept_text"]

    def cut(batches):
        for batch in batches:
            for part, data, offsets in unpacked(batch):
                yield group(part, data, offsets)

    def group(batch, data, offsets):
        n = len(batch)
        delta = np.zeros(len(data) + 1, np.int32)
        for name in ("closed", "late"):
            col = batch.column(name)
            lists = col.flatten()
            own = np.repeat(np.arange(n), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)))
            size = np.diff(offsets)[own]
            np.add.at(delta, offsets[own] + np.minimum(lists.field("start").to_numpy(), size), 1)
            np.add.at(delta, offsets[own] + np.minimum(lists.field("stop").to_numpy(), size), -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        before = np.r_[False, gone[:-1]][:len(gone)]
        before[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
        total = np.r_[0, np.cumsum(gone)][offsets]
        begun = np.r_[0, np.cumsum(gone & ~before)][offsets]
        kept, kept_at = data[~gone].tobytes(), offsets - total
        texts = [kept[kept_at[i]:kept_at[i + 1]] for i in range(n)]
        last = [hashlib.sha256(x).hexdigest() if digest_only else x.decode("utf-8", "ignore") for x in texts]
        return pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (np.diff(offsets), np.diff(total), np.diff(begun))),
                                           pa.array(last, pa.string())], names=names)
    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q,
                   digest: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the kept text (bytes that are no whole character after
    the cut are left out) or with `digest` the SHA-256 of all kept bytes."""
    ranges, texts = repeat_ranges(documents(keyed(docs, id_col, text_col)), length, q)
    last = "kept_sha256 string" if digest else "kept_text string"
    out = texts.join(ranges, ["id", "row"], "left").mapInArrow(
        _cut(digest), f"id long, n_bytes long, n_removed long, n_spans long, {last}")
    return out.select(unkeyed().alias(id_col), *out.columns[1:])
