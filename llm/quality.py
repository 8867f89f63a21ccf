"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text are Spark column expressions.
2. Boosted trees of small depth are grown on a bounded sample of labelled rows (about `TRAIN_ROWS`, by the id's hash; only the
   sample's dozen numbers a row reach the driver). Every path from a root to a node is a conjunctive rule.
3. A lasso-penalised logistic regression over the rules keeps few of them; its penalty is chosen on a part of the sample.
4. The kept rules are compiled into one Spark column: the score of any table is a projection, without shuffle or Python.

Defined cases: null or empty text has all statistics 0 and is scored like any other; without labels of both classes every
score is the base rate (0.5 if there is no label); other columns are not read; rows are scored one by one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, fold, one_each

TRAIN_ROWS, TREES, DEPTH, BINS, SHRINK = 12_000, 30, 3, 24, 0.4
STATISTICS = ("chars", "words", "word_size", "distinct_words", "distinct_lines", "symbols", "pipes", "shouts", "capitals", "digits", "stops")


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]+", "")


def with_statistics(rows: DataFrame) -> DataFrame:
    """Adds the statistics of column `text` (never null here); shares are of characters, words or lines."""
    text, chars, words = F.col("text"), F.greatest(F.lit(1), F.col("chars")), F.greatest(F.lit(1), F.col("words"))
    rows = rows.withColumns({"chars": F.length(text), "_words": F.filter(F.split(text, r"\s+"), lambda w: w != ""),
                             "_lines": F.split(text, "\n"), "_marks": _only(text, "#$%&*|!.~^="),
                             "capitals": F.length(_only(text, "A-ZÀ-ÖØ-Þ")), "digits": F.length(_only(text, "0-9"))})
    rows = rows.withColumns({"words": F.size("_words"), "_kinds": F.size(F.array_distinct("_words")),
                             "distinct_lines": F.size(F.array_distinct("_lines")) / F.size("_lines"),
                             "_stops": F.length(_only(F.col("_marks"), ".")), "_pipes": F.length(_only(F.col("_marks"), "|")),
                             "_shouts": F.length(_only(F.col("_marks"), "!")), "_all": F.length("_marks")})
    rows = rows.withColumns({"word_size": chars / words, "distinct_words": F.col("_kinds") / words, "pipes": F.col("_pipes") / words,
                             "shouts": F.col("_shouts") / words, "capitals": F.col("capitals") / chars, "digits": F.col("digits") / chars,
                             "stops": F.col("_stops") / words,
                             "symbols": (F.col("_all") - F.col("_stops") - F.col("_pipes") - F.col("_shouts")) / words})
    return rows.select(*[c for c in rows.columns if c[0] != "_" and c not in STATISTICS],
                       *[F.col(s).cast("double").alias(s) for s in STATISTICS])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above the cut, cut) for each condition


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], columns: np.ndarray, depth: int, least: int,
         path: Rule = ()) -> list[tuple[Rule, float | None]]:
    """All paths of one regression tree; leaves carry their Newton step, inner nodes None."""
    step = residual.sum() / (weight.sum() + 1.0)
    best = (1e-6, None)
    if depth and len(x) >= 2 * least:
        base = residual.sum() ** 2 / (weight.sum() + 1.0)
        for k in columns:
            for cut in cuts[k]:
                up = x[:, k] > cut
                n = int(up.sum())
                if least <= n <= len(x) - least:
                    r, w = residual[up].sum(), weight[up].sum()
                    gain = r * r / (w + 1) + (residual.sum() - r) ** 2 / (weight.sum() - w + 1) - base
                    if gain > best[0]:
                        best = (gain, (int(k), float(cut)))
    if best[1] is None:
        return [(path, step)]
    k, cut = best[1]
    out: list[tuple[Rule, float | None]] = [(path, None)]
    for above in (False, True):
        part = (x[:, k] > cut) == above
        out += grow(x[part], residual[part], weight[part], cuts, columns, depth - 1, least, (*path, (k, above, cut)))
    return out


def rules_of(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[Rule]:
    """Paths of stochastically boosted trees, each rule once."""
    rng, f = np.random.default_rng(seed), np.zeros(len(y))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        columns = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        for path, step in grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, columns, DEPTH, max(5, len(y) // 400)):
            if path:
                found[tuple(sorted(path))] = None
            if step is not None:
                f += SHRINK * step * holds(path, x)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient over the distinct rows; the intercept is free."""
    z, at, n = np.unique(z, axis=0, return_inverse=True, return_counts=True)
    y, n = np.bincount(at.ravel(), y, len(z)), n.astype(float)
    z1, total = np.hstack([np.ones((len(z), 1)), z]), n.sum()
    rate = 4.0 * total / (np.linalg.norm(z1 * np.sqrt(n)[:, None], 2) ** 2 + 1e-9)
    w = v = np.zeros(z1.shape[1])
    for t in range(steps):
        g = z1.T @ (n / (1 + np.exp(-np.clip(z1 @ v, -30, 30))) - y) / total
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - rate * penalty)
        v, w = new + t / (t + 3) * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the weighted rules that the lasso keeps."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return float(np.log(share / (1 - share))), []
    rules = rules_of(x, y)
    z = np.stack([holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    judge = np.arange(len(y)) % 4 == 0

    def loss(penalty):
        b, w = lasso_logistic(z[~judge], y[~judge], penalty)
        s = np.clip(b + z[judge] @ w, -30, 30)
        return float(np.mean(np.log1p(np.exp(-s * (2 * y[judge] - 1)))))

    penalty = min((3e-2, 1e-2, 3e-3, 1e-3, 3e-4), key=loss)
    b, w = lasso_logistic(z, y, penalty, 800)
    return b, [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The probability of label 1 as a column over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        met = F.lit(True)
        for k, above, cut in rule:
            met = met & ((F.col(STATISTICS[k]) > F.lit(cut)) if above else (F.col(STATISTICS[k]) <= F.lit(cut)))
        total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int):
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(fold(F.col("id"), 3) != 1)
    first = bounded_sample(known, "id", most)  # about `most` rows of three numbers: may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(first), "id")
    rows = one_each(rows)
    numbers = sorted(with_statistics(rows).drop("text").select("h", "label", *STATISTICS).collect())
    x = np.array([r[2:] for r in numbers], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.label for r in numbers], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = compiled(*train(docs, labels, id_col, text_col, label_col, train_rows))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = with_statistics(plain).select(F.col("id"), (fold(F.col("id"), 3) == 1).alias("held_out"), model.alias("score"))
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
