"""Benchmark decontamination with a generalised suffix automaton over words.

Items are dealt by hash into groups of about `group_chars` characters, one automaton a group, so what is broadcast and held by a
task has a fixed bound however large the benchmark grows. One group, the usual case, is one pass without a shuffle; more groups
are as many passes, whose hits are written down and joined to the texts by a 128-bit hash. Documents stream through: at each word the automaton's state is the longest suffix of the text that occurs
in an item, and its length says whether a window ends here. Words outside the items' vocabulary reset the match, so only
runs of known words that are long enough are walked; that skips nothing, as no window contains an unknown word.

A window is `width` consecutive words of an item, or a whole shorter item (not an empty one). Spans of hit words are removed
by `decontaminate`; a document with more than `max_coverage` of its words hit is dropped.

Defined cases: null text has no words; a null item has no window; items that share an id count once, a null id as empty
text; an empty benchmark hits nothing; rows are judged one by one, so repeated ids each keep their own result; other columns
pass through `decontaminate` untouched."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.textbytes import LOWER, RollingHash, row_groups, text_bytes, word_spans
from tidegauge.session import staged

WIDTH, MAX_COVERAGE, GROUP_CHARS = 10, 0.5, 1 << 20
HITS = "struct<starts:array<int>,stops:array<int>,names:array<string>>"
KEYS, FOUND = ("__text_hash_1", "__text_hash_2"), "__benchmark_hits"
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, hashes of the words, and each row's first word number."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, WORD_BYTES)
    return starts, ends, RollingHash(low).ranges(starts, ends), first


class SuffixAutomaton:
    """Suffix automaton of many word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[int]]], width: int = WIDTH):
        self.width, self.next, self.link, self.length = width, [{}], [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._grow(last, w)
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.least = min([width, *(len(words) for _, words in items if words)])
        for name, words in items:
            state = 0
            for at, w in enumerate(words):
                state = self.next[state][w]
                if at >= width - 1:
                    state = self.of_width(state)
                    self.windows.setdefault(state, set()).add(name)
            if 0 < len(words) < width:
                self.whole.setdefault(state, []).append((len(words), name))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if up := self.whole.get(self.link[state]):
                self.whole[state] = self.whole.get(state, []) + up

    def _grow(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            other = self.next[at][word]
            self.link[new] = other if self.length[other] == self.length[at] + 1 else self._split(at, other, word)
        return new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, other: int, word: int) -> int:
        """A state of its own for the strings of `other` that end a path through `at`."""
        twin = self._state(dict(self.next[other]), self.length[at] + 1, self.link[other])
        self.link[other] = twin
        while at >= 0 and self.next[at].get(word) == other:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def of_width(self, state: int) -> int:
        """The state that holds the last `width` words of a match in `state`."""
        while self.length[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def walk(self, words: list[int], hit):
        """Streams a run of words; hit(start, stop, names) for each window that ends in it."""
        state = matched = 0
        for at, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(w)
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            if matched >= self.width:
                state = self.of_width(state)
                matched = self.width
                hit(at - self.width, at, self.windows.get(state, ()))
            for size, name in self.whole.get(state, ()):
                if size <= matched:
                    hit(at - size, at, (name,))


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH,
             group_chars: int = GROUP_CHARS) -> Iterator[tuple[np.ndarray, SuffixAutomaton] | None]:
    """First None if there are several groups; then one (sorted vocabulary, automaton) for each group of items in turn."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = int(total // group_chars) + 1
    part = F.pmod(F.xxhash64("name", "text"), F.lit(groups))
    if groups > 1:
        yield None
    for k in range(groups):
        rows = items.where(part == k).collect()  # a group of bounded size
        data, offsets = text_bytes(pa.array([r.text for r in rows], pa.string()))
        _, _, hashes, first = words_of(data, offsets)
        if len(hashes):
            vocabulary, ids = np.unique(hashes, return_inverse=True)
            yield vocabulary, SuffixAutomaton([(r.name, ids[first[i]:first[i + 1]].tolist()) for i, r in enumerate(rows)], width)


def _runs_of_known(ids: np.ndarray, row: np.ndarray, least: int):
    """Runs (first, stop) of known words of one row that are long enough."""
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return []
    cut = np.flatnonzero(np.r_[True, (np.diff(known) > 1) | (np.diff(row[known]) != 0)])
    start, stop = known[cut], known[np.r_[cut[1:] - 1, len(known) - 1]] + 1
    long = stop - start >= least
    return zip(start[long].tolist(), stop[long].tolist(), strict=True)


def look_up(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each word's number in the vocabulary, or -1. A bit table passes over most unknown words."""
    table = np.zeros(1 << 18, bool)
    table[(vocabulary >> np.uint64(46)).astype(np.int64)] = True
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(table[(hashes >> np.uint64(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    out[maybe] = np.where(vocabulary[at] == hashes[maybe], at, -1)
    return out


def hits_in(texts: pa.Array, matcher, known: pa.Array | None = None):
    """For each row in turn: its bytes, word starts, word ends, hit flags and the names of the items found; by a matcher, or as
    `known` from earlier passes."""
    before = known.to_pylist() if known is not None else None
    data, offsets = text_bytes(texts)
    for a, b in row_groups(offsets):
        part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, hashes, first = words_of(part, own)
        row = np.repeat(np.arange(b - a), np.diff(first))
        delta = np.zeros(len(hashes) + 1, np.int64)
        names: dict[int, set[str]] = {}
        for i in range(a, b) if before else ():
            if before[i]:
                base = first[i - a]
                np.add.at(delta, base + np.array(before[i]["starts"], np.int64), 1)
                np.add.at(delta, base + np.array(before[i]["stops"], np.int64), -1)
                names[i - a] = set(before[i]["names"])
        if matcher is not None:
            vocabulary, automaton = matcher
            ids = look_up(vocabulary, hashes)
            for start, stop in _runs_of_known(ids, row, automaton.least):
                found = names.setdefault(int(row[start]), set())

                def hit(x, y, items, start=start, found=found):
                    delta[start + x] += 1
                    delta[start + y] -= 1
                    found.update(items)

                automaton.walk(ids[start:stop].tolist(), hit)
        flags = np.cumsum(delta[:-1]) > 0
        for i in range(b - a):
            w = slice(first[i], first[i + 1])
            yield part[own[i]:own[i + 1]], starts[w] - own[i], ends[w] - own[i], flags[w], names.get(i, set())


def without(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> str:
    """The text without its hit words and what lies between them."""
    out, at = [], 0
    for is_hit, group in groupby(range(len(flags)), key=flags.__getitem__):
        if is_hit:
            group = list(group)
            out.append(text[at:starts[group[0]]].tobytes())
            at = ends[group[-1]]
    return b"".join([*out, text[at:].tobytes()]).decode()


def _text_key(text: Column) -> dict[str, Column]:
    return dict(zip(KEYS, (F.xxhash64(text), F.xxhash64(F.lit("second"), text)), strict=True))


def located(docs: DataFrame, text: Column, benchmark: DataFrame, width: int, group_chars: int):
    """`docs` as they are and a broadcast matcher; or, for several groups, `docs` with a column of all passes' hits and None."""
    found = automata(benchmark, width=width, group_chars=group_chars)
    nothing = (np.zeros(0, np.uint64), SuffixAutomaton([], width))
    first = next(found, nothing)
    context, passes = docs.sparkSession.sparkContext, []
    if first is not None:
        return docs, context.broadcast(None if first is nothing else first)
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text")).withColumns(_text_key(F.col("text"))).dropDuplicates(list(KEYS))
    for matcher in found:
        shared = context.broadcast(matcher)

        def spans(batches, shared=shared):
            for batch in batches:
                keep, rows = [], []
                for i, (_, _, _, flags, names) in enumerate(hits_in(batch.column("text"), shared.value)):
                    if names:
                        edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
                        keep.append(i)
                        rows.append({"starts": np.flatnonzero(edge == 1).tolist(), "stops": np.flatnonzero(edge == -1).tolist(), "names": sorted(names)})
                at = pa.array(keep, pa.int64())
                kind = pa.struct([("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in KEYS), pa.array(rows, kind)], names=[*KEYS, FOUND])

        passes.append(staged(texts.mapInArrow(spans, f"{KEYS[0]} long, {KEYS[1]} long, {FOUND} {HITS}"), "benchmark-hits"))
        shared.unpersist()
    if not passes:
        return docs, context.broadcast(None)
    every = passes[0]
    for part in passes[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(*KEYS).agg(F.struct(*[F.flatten(F.collect_list(f"{FOUND}.{k}")).alias(k) for k in ("starts", "stops", "names")]).alias(FOUND))
    keyed = docs.withColumns(_text_key(F.coalesce(text, F.lit(""))))
    return keyed.join(merged, list(KEYS), "left").select(*docs.columns, FOUND), None


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
           group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, kept_text (null if nothing is hit)."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain, shared = located(plain, F.col("text"), benchmark, width, group_chars)

    def judge(batches):
        for batch in batches:
            rows = []
            found = batch.column(FOUND) if shared is None else None
            for text, starts, ends, flags, names in hits_in(batch.column("text"), shared and shared.value, found):
                n = int(flags.sum())
                rows.append((len(flags), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0,
                             without(text, starts, ends, flags) if n else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")] + [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)],
                names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept_text"])

    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(judge, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
                                  "contaminated boolean, kept_text string")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH,
                  max_coverage: float = MAX_COVERAGE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The documents, all columns, without hit spans; those with more than `max_coverage` of their words hit are dropped.
    A column n_chars, if there, follows the new text."""
    names = docs.columns
    at = names.index(text_col)
    rows, shared = located(docs, docs[text_col], benchmark, width, group_chars)

    def clean(batches):
        for batch in batches:
            found = batch.column(FOUND) if shared is None else None
            texts, keep = batch.column(at).to_pylist(), []
            for i, (text, starts, ends, flags, _) in enumerate(hits_in(batch.column(at), shared and shared.value, found)):
                n = int(flags.sum())
                keep.append(n <= max_coverage * len(flags))
                if n and keep[-1]:
                    texts[i] = without(text, starts, ends, flags)
            arrays = list(batch.columns)[:len(names)]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:len(names)]).filter(pa.array(keep, pa.bool_()))

    out = rows.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
