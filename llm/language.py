"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on a bounded sample of labelled rows (about `TRAIN_ROWS`, by the id's hash); every
task folds its texts into one (language, bucket) table first, so what the driver adds up has languages x 2**BITS cells at
most. The matrix of log probabilities is broadcast (2**BITS rows, one column a language). Scoring is a sparse product: a
batch's n-grams, hashed in numpy, pick rows of the matrix, which are summed per document.

`score` is the posterior of the predicted language, from evidence tempered by the number of n-grams.

Defined cases: null text or a text without a letter is `und` with score 0; without any labelled row every text is `und`;
equal posteriors go to the language first in order; rows are judged one by one; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, fold
from llm.textbytes import mix, row_groups, text_bytes

BITS, SIZES, TRAIN_ROWS, ALPHA, TEMPER = 15, (1, 2, 3), 20_000, 0.5, 32.0
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of lower-cased texts and the document of each. N-grams stay inside a text; white
    space counts as one kind of edge, characters that are no letters are left out of the alphabet."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in lowered])
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = (codes >= 97) & ((codes <= 122) | (codes >= 170))
    codes = np.where(letter, codes, np.uint64(32))
    dull = codes == np.uint64(32)
    # runs of spaces shrink to one, so layout does not count
    keep = ~(dull & np.r_[False, dull[:-1] & (row[1:] == row[:-1])])
    codes, row = codes[keep], row[keep]
    out, owner, h = [], [], np.zeros(len(codes), np.uint64)
    for k in range(1, max(SIZES) + 1):
        n = len(codes) - k + 1
        if n <= 0:
            break
        h = h[:n] * np.uint64(0x100000001B3) + codes[k - 1:]
        if k in SIZES:
            inside = row[:n] == row[k - 1:]
            if k == 1:
                inside &= codes != np.uint64(32)
            out.append((mix(h[inside] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64))
            owner.append(row[:n][inside])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _texts(batch):
    """Texts in runs of bounded size."""
    column = batch.column("text")
    _, offsets = text_bytes(column)
    for a, b in row_groups(offsets, 1 << 20):
        yield a, b, column.slice(a, b - a).to_pylist()


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (bucket, language) with the log prior in the last row. `labelled` has
    text and lang."""
    def counts(batches):
        table: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _texts(batch):
                bucket, owner = grams(texts)
                own = np.array(langs[a:b], object)
                for lang in set(langs[a:b]):
                    seen[lang] = seen.get(lang, 0) + int((own == lang).sum())
                    have = table.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    have += np.bincount(bucket[(own == lang)[owner]], minlength=1 << BITS)
        names = list(table)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[n] for n in names], pa.int64()),
                                          pa.array([table[n].tobytes() for n in names], pa.binary())], names=["lang", "rows", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()), np.zeros(1 << BITS, np.int64))
        return pa.table({"lang": table.column("lang").slice(0, 1), "rows": pa.array([pa.compute.sum(table.column("rows")).as_py()]),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, rows long, counts binary"
    rows = sorted(labelled.select("text", "lang").mapInArrow(counts, schema).groupBy("lang").applyInArrow(merge, schema).collect())
    if not rows:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    n = np.array([np.frombuffer(r.counts, np.int64) for r in rows], float).T
    log = np.log(n + ALPHA) - np.log((n + ALPHA).sum(0))
    prior = np.log(np.array([r.rows for r in rows], float) / sum(r.rows for r in rows))
    return [r.lang for r in rows], np.vstack([log, prior]).astype(np.float32)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = TRAIN_ROWS) -> DataFrame:
    """About `most` labelled rows of the learning folds, chosen by the hash of id and text; of equal rows one."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where((fold(F.col("id"), 4) != 2) & F.col("lang").isNotNull())
    return bounded_sample(rows.where("text is not null"), ["id", "text"], most).dropDuplicates(["id", "text", "lang"]).select("text", "lang")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    names, log = fit(training_rows(docs, id_col, text_col, lang_col, train_rows))
    shared = docs.sparkSession.sparkContext.broadcast((names, log))

    def predict(batches):
        languages, matrix = shared.value
        order = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            best, sure = [], []
            for _, _, texts in _texts(batch):
                texts = [t or "" for t in texts]
                letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
                if not languages:
                    best.append(np.full(len(texts), UNKNOWN, object))
                    sure.append(np.zeros(len(texts)))
                    continue
                bucket, owner = grams(texts)
                sums = np.stack([np.bincount(owner, matrix[bucket, k], len(texts)) for k in range(len(languages))], 1)
                n = np.bincount(owner, minlength=len(texts))
                z = sums / np.maximum(1, n / TEMPER)[:, None] + matrix[-1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                top = p.argmax(1)
                best.append(order[np.where(letters, top, len(languages))])
                sure.append(np.where(letters, p[np.arange(len(top)), top], 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(np.concatenate(best) if best else [], pa.string()),
                 pa.array(np.concatenate(sure) if sure else [], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).alias("id"), (fold(docs[id_col], 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
