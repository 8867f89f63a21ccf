"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut before every run of word marks, which no piece crosses, and its distinct words are laid end to end. The
suffix array of that text (prefix doubling up to the longest piece) is searched for every piece of the vocabulary at once, by
binary search for both ends of its range; the suffixes in the range are the piece's occurrences. These edges, sorted by
position, form a lattice: edge (position, length) -> piece. Relaxing it gives the segmentation. For the BPE model at hand
that is contraction by score, as the library merges: again and again each word's best-scored edge that spans two neighbouring
symbols (leftmost of equals) joins them. A shortest path over the same edges would give other ids than the library.
All words of a batch are relaxed together; long ones one by one with a heap. Characters without an edge fall back to bytes.

The work is done in runs of bounded size inside each task, without shuffle. Vocabulary size is fixed by the model file, which is
read on the driver and broadcast.

Defined cases: null or empty text has no ids; rows are encoded one by one, so repeated ids each keep their own result; the word
mark itself reads as a space after decoding, as in the library; byte pieces that are no valid UTF-8 decode to U+FFFD; an empty
table gives an empty result; `encode` keeps only the id column."""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textbytes import row_groups, text_bytes

MARK, EDGE = "▁", 0x110000
LONG_WORD, RUN_CHARS, RUN_BYTES, KNOWN, NONE = 48, 1 << 20, 1 << 23, 1 << 19, 1 << 30
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ids = np.array(plain, np.int64)
        self.lengths = np.array([len(self.names[i]) for i in plain])
        self.longest = int(self.lengths.max())
        # rank 0 is the best score; each piece's rank orders contractions
        score = np.array([sp.get_score(i) for i in plain])
        self.rank = np.empty(len(plain), np.int64)
        self.rank[np.argsort(-score, kind="stable")] = np.arange(len(plain))
        self.codes = np.full((len(plain), self.longest), -1, np.int64)
        for row, i in enumerate(plain):
            self.codes[row, :self.lengths[row]] = [ord(c) for c in self.names[i]]
        self.spoken = [n.replace(MARK, " ") for n in self.names]
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.byte_of = {i: b for b, i in self.byte_ids.items()}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` codes, by prefix doubling from keys of three codes."""
    here = np.bincount(codes, minlength=EDGE + 1) > 0
    rank = np.cumsum(here)[codes]  # from 1, so that the end is below all; three of them fit a key
    key, width = np.zeros(len(rank), np.int64), 3
    for k in range(width):
        key <<= np.int64(21)
        key[:len(rank) - k] += rank[k:]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]])
        ahead = np.zeros(len(rank), np.int64)
        ahead[:max(0, len(rank) - width)] = rank[width:]
        key = rank * np.int64(len(rank) + 2) + ahead
        width *= 2


def occurrences(pieces: Pieces, codes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one place of every piece in the suffix array, by binary search of all pieces at once."""
    padded = np.r_[codes, np.full(pieces.longest, -2)]

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces.ids), np.int64), np.full(len(pieces.ids), len(suffixes))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            at, wanted = suffixes[middle], pieces.codes[open_]
            seen = padded[at[:, None] + np.arange(pieces.longest)]
            differs = (seen != wanted) & (wanted >= 0)
            first = differs.argmax(1)
            rows = np.arange(len(open_))
            equal = ~differs[rows, first]
            right = np.where(equal, after, seen[rows, first] < wanted[rows, first])
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    return search(False), search(True)


def lattice(pieces: Pieces, codes: np.ndarray) -> np.ndarray:
    """Table (position, length) -> rank of the piece there, or NONE. Writing each edge to its address sorts the edges by position."""
    suffixes = suffix_array(codes, pieces.longest)
    low, high = occurrences(pieces, codes, suffixes)
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    place = suffixes[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))]
    table = np.full((len(codes) + 1, pieces.longest + 1), NONE, np.int32)
    table[place, pieces.lengths[piece]] = pieces.rank[piece]
    return table


def relax_long(table: np.ndarray, start: int, stop: int) -> list[int]:
    """Symbol starts of one long word after all contractions, by a heap of edges."""
    longest = table.shape[1] - 1
    after = {i: i + 1 for i in range(start, stop)}
    before = {i + 1: i for i in range(start, stop - 1)}
    heap: list[tuple[int, int, int]] = []

    def offer(i):
        middle = after[i]
        if middle < stop and after[middle] - i <= longest and table[i, after[middle] - i] < NONE:
            heapq.heappush(heap, (int(table[i, after[middle] - i]), i, after[middle]))

    for i in range(start, stop):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after.get(i)
        if middle is None or middle >= stop or after.get(middle) != end:
            continue  # one of the two is gone or has grown
        after[i] = end
        del after[middle]
        if end < stop:
            before[end] = i
        offer(i)
        if i in before and before[i] in after:
            offer(before[i])
    return sorted(after)


def relax(table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Symbol starts of all words after all contractions. bounds: word starts, and the end; words touch (edges between them have
    no piece)."""
    longest = table.shape[1] - 1
    size = np.diff(bounds)
    done = [np.array(relax_long(table, bounds[w], bounds[w + 1])) for w in np.flatnonzero(size > LONG_WORD)]
    done.append(bounds[:-1][size == 1])
    live = np.flatnonzero((size > 1) & (size <= LONG_WORD))
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(bounds[w], bounds[w + 1]) for w in live]]) if len(live) < 64 else (
        np.repeat(bounds[live] - np.r_[0, np.cumsum(size[live])[:-1]], size[live]) + np.arange(int(size[live].sum())))
    count, ends = size[live], bounds[live + 1]
    while len(count):
        first = np.r_[0, np.cumsum(count)[:-1]]
        last = first + count - 1
        next_ = np.r_[starts[1:], 0]
        next_[last] = ends
        after = np.r_[next_[1:], 0]
        span = after - starts
        span[last] = 0
        rank = np.where((span > 0) & (span <= longest), table[starts, np.clip(span, 0, longest)], NONE).astype(np.int64)
        best = np.minimum.reduceat((rank << np.int64(24)) | (np.arange(len(rank)) - np.repeat(first, count)), first)
        more = (best >> np.int64(24)) < NONE
        gone = np.zeros(len(starts), bool)
        gone[(first + (best & np.int64((1 << 24) - 1)) + 1)[more]] = True
        still = np.repeat(more, count)
        done.append(starts[~still])
        starts = starts[still & ~gone]
        count, ends = count[more] - 1, ends[more]
        single = count == 1
        if single.any():
            alone = np.repeat(single, count)
            done.append(starts[alone])
            starts, count, ends = starts[~alone], count[~single], ends[~single]
    return np.sort(np.concatenate(done))


def encode_words(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and how many each has."""
    flat, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(words):
        run, size = [], 0
        while at < len(words) and (not run or size + len(words[at]) < RUN_CHARS):
            run.append(words[at])
            size += len(words[at]) + 1
            at += 1
        ids, count = _encode_run(pieces, run)
        flat.append(ids)
        sizes.append(count)
    return np.concatenate(flat), np.concatenate(sizes)


def _encode_run(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # an edge code after each word keeps pieces from crossing
    bounds = np.r_[0, np.cumsum(size + 1)]
    codes = np.full(int(bounds[-1]), EDGE, np.int64)
    inside = np.ones(len(codes), bool)
    inside[bounds[1:] - 1] = False
    codes[inside] = flat
    table = lattice(pieces, codes)
    # each word with its edge is one stretch; the edge stays a symbol of its own, as no piece contains it
    starts = relax(table, bounds)
    span = np.diff(np.r_[starts, len(codes)])
    by_rank = np.empty(len(pieces.ids), np.int64)
    by_rank[pieces.rank] = pieces.ids
    rank = table[starts, np.minimum(span, pieces.longest)]
    edge = codes[starts] == EDGE
    word = np.cumsum(edge)[~edge]
    ids = np.where(rank < NONE, by_rank[np.minimum(rank, len(by_rank) - 1)], -1)[~edge]
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        raw = [_bytes(pieces, int(c)) for c in codes[starts[~edge][lost]]]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(r) for r in raw]
        place = np.cumsum(width) - width
        word, ids = np.repeat(word, width), np.repeat(ids, width)
        for at, r in zip(place[lost].tolist(), raw, strict=True):
            ids[at:at + len(r)] = r
    return ids.astype(np.int32), np.bincount(word, minlength=len(words))


def _bytes(pieces: Pieces, code: int) -> list[int]:
    raw = chr(code).encode("utf-8", "surrogatepass")
    return [pieces.byte_ids[b] for b in raw] if pieces.byte_ids else [pieces.unknown]


class Numbers(dict):
    """Words in order of appearance, each with its number."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts; keeps at most about KNOWN words with their ids from run to run."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self):
        self.number = Numbers()
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's bounds in them."""
        if len(self.number) > KNOWN:
            self._forget()
        number, old = self.number, len(self.number)
        used: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                used.extend(map(number.__getitem__, WORDS.findall(MARK + t.replace(" ", MARK))))
            ends.append(len(used))
        new, count = encode_words(self.pieces, list(number)[old:])
        self.ids = np.concatenate([self.ids, new])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])
        word = np.array(used, np.int64)
        n = self.bounds[word + 1] - self.bounds[word]
        total = np.r_[0, np.cumsum(n)]
        place = np.repeat(self.bounds[word] - total[:-1], n) + np.arange(int(total[-1]))
        return self.ids[place], total[np.array(ends)]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of the ids, without the leading space that encoding adds."""
    if not len(ids):
        return ""
    if not pieces.is_byte[ids].any():
        text = "".join(map(pieces.spoken.__getitem__, ids.tolist()))
    else:
        raw = b"".join(bytes([pieces.byte_of[i]]) if i in pieces.byte_of else pieces.spoken[i].encode("utf-8", "surrogatepass") for i in ids.tolist())
        text = raw.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pieces, ids, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives
    the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches):
        pieces = Pieces(shared.value)
        encoder = Encoder(pieces)
        for batch in batches:
            column = batch.column("text")
            _, offsets = text_bytes(column)
            for a, b in row_groups(offsets, RUN_BYTES):
                texts = column.slice(a, b - a).to_pylist()
                ids, bounds = encoder.texts(texts)
                each = [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32())),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([decode_ids(pieces, x) == t.replace(MARK, " ") for x, t in zip(each, texts, strict=True)], pa.bool_())],
                    names=["id", "n_pieces", "ids", "ids_sha256", "round_trip"])

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, n_pieces long, ids array<int>, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`rows` with a column `decoded`; null ids decode to null."""
    shared = rows.sparkSession.sparkContext.broadcast(_model(model_path))

    @F.pandas_udf("string")
    def text_of(ids):
        pieces = Pieces(shared.value)
        return ids.map(lambda x: None if x is None else decode_ids(pieces, np.asarray(x, np.int64)))

    return rows.withColumn("decoded", text_of(F.col(ids_col)))
