"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of 4, 5 and 6 bytes (so inflected forms share a term), as 64-bit hashes.
Training looks at a bounded sample of labelled rows (about `TRAIN_ROWS`, by the id's hash; texts of one class that differ
in nothing but case and white space count once). Every term
falls into one of `BUCKETS` buckets by its hash, none is left out beforehand, and a second-order factorization machine learns
a factor vector for each bucket whose inner products weigh pairs: a group's name that is neutral alone can count next to an
insult. Pairs weigh by one over the row's number of terms, so that a long text does not drown in them. Own weights are learned
first, for terms whose presence alone departs from independence of the class by `SURPRISE` deviations (in three texts or more);
the others have none, but have factors. Model and sample have fixed bounds: one task fits the sample's bucket numbers and hands the
model (`BUCKETS` times `RANK` + 1 numbers) to the driver, which broadcasts it. Scoring needs no shuffle.

Defined cases: null or empty text scores as a text without terms; without labels of both classes every score is the base
rate (0 if there is none); rows are scored one by one; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, fold, one_each
from llm.decontaminate import WORD_BYTES
from llm.textbytes import LOWER, RollingHash, mix, row_groups, text_bytes, word_spans

TRAIN_ROWS, BUCKETS, RANK, BEGINNINGS = 12_000, 1 << 18, 4, (4, 5, 6)
ALONE_STEPS, STEPS, RATE, PENALTY, SURPRISE = 150, 50, 0.05, 0.6, 4.5


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the row of each."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, WORD_BYTES)
    rolling = RollingHash(low)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out, owner = [rolling.ranges(starts, ends)], [row]
    for size in BEGINNINGS:
        longer = ends - starts > size
        s = starts[longer]
        out.append(mix(rolling.ranges(s, s + size) + np.uint64(size)))
        owner.append(row[longer])
    return np.concatenate(out), np.concatenate(owner)


def _groups(batch):
    data, offsets = text_bytes(batch.column("text"))
    for a, b in row_groups(offsets):
        yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(label, text) of about `most` ids of the learning folds, one document of each; of texts that are equal but for case and white
    space, one of each class."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(fold(F.col("id"), 5) != 0)
    first = bounded_sample(known, "id", most)  # about `most` rows of three numbers: may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(first), "id")
    rows = one_each(rows)
    whole = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    return rows.withColumn("whole", whole).dropDuplicates(["label", "whole"]).select("label", "text")


def _present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, in order."""
    h, row = terms(data, offsets)
    pairs = np.unique(row.astype(np.int64) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


class FactorizationMachine:
    """w0 + sum of w_i + sum over pairs of <v_i, v_j> / number of terms, for the terms present."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 3):
        self.bias, self.weights, self.seed = 0.0, np.zeros(size, np.float32), seed
        self.factors = np.zeros((rank, size), np.float32)  # of a term that no text has shown: nothing

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> FactorizationMachine:
        """The same from a 0/1 matrix."""
        return self.fit_pairs(*np.nonzero(x), y, steps, rate, penalty)

    def fit_pairs(self, row: np.ndarray, term: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE,
                  penalty: float = PENALTY) -> FactorizationMachine:
        """Adam on the weighted logistic loss over distinct (row, term) pairs in order of rows: `ALONE_STEPS` for the weights,
        then `steps` for all."""
        n, share = len(y), np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 1e-6
        self.bias = float(np.log(share / (1 - share)))
        if not len(row) or y.min() == y.max():
            return self
        seen = np.bincount(term, minlength=len(self.weights))
        used = np.flatnonzero(seen)
        seen, size = seen[used], len(used)
        number = np.zeros(len(self.weights), np.int32)
        number[used] = np.arange(size)
        term, row = number[term], row.astype(np.int32)
        by_term = row[np.argsort(term, kind="stable").astype(np.int32)]
        term_at, row_at = np.r_[0, np.cumsum(seen)[:-1]], np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        filled, many = row[row_at], np.maximum(1, np.bincount(row, minlength=n)).astype(np.float32)

        def of_rows(values):
            out = np.zeros(n, np.float32)
            out[filled] = np.add.reduceat(values[term], row_at)
            return out

        def of_terms(values):
            return np.add.reduceat(values[by_term], term_at)

        # the rarer class counts for more, by the root of the classes' ratio
        heavy = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)
        heavy /= heavy.sum()
        far = np.abs(of_terms((y - share).astype(np.float32))) - 0.5
        alone = (far >= SURPRISE * np.sqrt(seen * share * (1 - share))) & (seen >= 3)
        own = alone[term]
        own_row, own_term = row[own], term[own]
        # a factor grows where its pairs outweigh several texts' errors: less would learn single texts by heart
        tight = np.float32(penalty * 25 / 3 * np.mean(np.abs(share - y) * heavy))
        w, v = np.zeros(size, np.float32), np.random.default_rng(self.seed).normal(0, 0.02, self.factors[:, used].shape).astype(np.float32)
        state = {}

        def step(name, t, g):
            m, q = state.get(name, (0.0, 0.0))
            state[name] = m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
            return rate * (m / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-8)

        for t in range(1, ALONE_STEPS + steps + 1):
            paired = t > ALONE_STEPS
            sums = [of_rows(f) for f in v] if paired else []
            z = self.bias + np.bincount(own_row, w[own_term], n)
            for f, s in zip(v, sums):
                z += 0.5 * (s * s - of_rows(f * f)) / many
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * heavy).astype(np.float32)
            self.bias -= step("bias", t, float(error.sum()))
            w = w - step("w", t, np.bincount(own_term, error[own_row], size).astype(np.float32) + np.float32(penalty / n) * w)
            if paired:
                each = error / many
                total = of_terms(each)
                for k, s in enumerate(sums):
                    v[k] -= step(k, t - ALONE_STEPS, of_terms(each * s) + (tight - total) * v[k])
        self.weights[used], self.factors[:, used] = w, v
        return self

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        z = np.full(rows, self.bias) + np.bincount(row, self.weights[term], rows)
        many = np.maximum(1, np.bincount(row, minlength=rows))
        for f in self.factors:
            z += 0.5 * (np.bincount(row, f[term], rows) ** 2 - np.bincount(row, f[term] ** 2, rows)) / many
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _encode(batches):
    """label, buckets, and a number that orders rows by what they hold: sums of floats depend on the order."""
    for batch in batches:
        for part, data, offsets in _groups(batch):
            row, term = _present(data, offsets)
            bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=len(part)))].astype(np.int32)
            total = np.r_[np.uint64(0), np.cumsum(mix(term.astype(np.uint64)))]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))], names=["label", "mark", "terms"])


def _fit(batches):
    """The machine of one sorted stream of encoded rows, as its three arrays."""
    label, count, term = [], [], []
    for batch in batches:
        label.append(batch.column("label").to_numpy())
        count.append(np.asarray(pa.compute.list_value_length(batch.column("terms"))))
        term.append(batch.column("terms").flatten().to_numpy().copy())
    y, n, t = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (label, count, term))
    term.clear()
    model = FactorizationMachine(BUCKETS).fit_pairs(np.repeat(np.arange(len(y), dtype=np.int32), n), t, y.astype(float))
    yield pa.RecordBatch.from_pylist([{"bias": model.bias, "weights": model.weights.astype(np.float32).tobytes(),
                                       "factors": model.factors.astype(np.float32).tobytes()}])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fitted in one task over the sample, which has a bound: the driver only receives the model, and a lost executor costs a retry."""
    known = sample(docs, labels, id_col, text_col, label_col, most).mapInArrow(_encode, "label int, mark long, terms array<int>")
    found = known.repartition(1).sortWithinPartitions("label", "mark").mapInArrow(_fit, "bias double, weights binary, factors binary").collect()
    model = FactorizationMachine(BUCKETS)
    if found:
        model.bias = found[0].bias
        model.weights = np.frombuffer(found[0].weights, np.float32)
        model.factors = np.frombuffer(found[0].factors, np.float32).reshape(RANK, BUCKETS)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def judge(batches):
        model = shared.value
        for batch in batches:
            p = [model.scores(*_present(data, offsets), len(part)) for part, data, offsets in _groups(batch)]
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p),
                                              pa.array((p >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(id_col).alias("id"), (fold(docs[id_col], 5) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(judge, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents, all columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    at = docs.columns.index(text_col)

    def keep(batches):
        model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for a, b in row_groups(offsets):
                row, term = _present(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(model.scores(row, term, b - a) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
