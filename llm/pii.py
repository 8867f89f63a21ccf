"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators are regular expressions that favour recall; their spans may overlap. Four of them are exact rules (email, ip, card,
phone) whose checked matches always stand. The others propose what the rules miss: written-out emails, digit runs that fail the
card check, phone numbers without a plus, secrets after a name, and long tokens of mixed letters and digits. Boosted trees score
each candidate from its format (length, digits, letters, separators, kinds of characters) and from its context (a naming word,
white space or a bracket just before). They are grown on binned features: Spark folds all training candidates into one row of
counts per feature vector, at most `CELLS` rows whatever the corpus, and boosting reads only that table. There is no label for
personal data, so the checked rules teach: what they confirm is positive, and so is a secret named as such; rule candidates that
fail their checks and plain words are negative. The threshold of each generator is calibrated on the same table to a wanted
precision. Trees become column expressions.

Java has no match positions in SQL, so a text is split by the pattern too: gaps and matches alternate, and running sums of their
lengths in code points are the positions. Patterns use possessive repeats and may not start inside a run that the attempt before
it has seen, so time stays linear in the text.

Defined cases: null or empty text has no span; base spans of one kind never overlap, others may; rows are judged one by one;
other columns are not read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
MASK = "[REDACTED]"

# The base patterns of the contract, made linear: possessive repeats, and no start inside a run already tried.
_LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ \-][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
#: Generators of further candidates.
EXTRA = {
    "written_email": r"(?i)(?<![a-z0-9._+\-])[a-z0-9._+\-]++ ?[\[(]?(?:at|@)[\])]? ?[a-z0-9\-]++ ?[\[(](?:dot|\.)[\])] ?[a-z]{2,12}+",
    "number": r"(?<![0-9.+\-])\(?[0-9]{2,5}+[)]?(?:[ .\-]\(?[0-9]{2,5}+[)]?){2,4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?[a-z0-9+/_\-]{8,}+",
    "mixed": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
}
ROUNDS, DEPTH, RATE, PRECISION, TRAIN_ROWS = 30, 2, 0.3, 0.9, 20_000
#: Bins of each feature: cut points, closed on the left.
FEATURES = {"size": (8, 12, 16, 20, 32), "digits": (1, 8, 10, 14), "letters": (1, 8), "marks": (1, 3), "at": (1,), "named": (1,), "edge": (1,)}
CELLS = 6 * 5 * 3 * 3 * 2 * 2 * 2


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, stop, match), leftmost and not overlapping; positions in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    placed = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop"),
                                              x["match"].alias("match")))).alias("out")), lambda acc: acc["out"])
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + (lambda d: F.when(
        (n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))(F.substr(number, i, F.lit(1)).try_cast("int")))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` (id, text) with an array column for each base kind (checked spans), and `extra` and `failed`: unchecked candidates
    as (kind, start, stop, match, before)."""
    text = F.col("text")
    # a cheap look first: most texts have no such character and skip the pattern
    has = {"email": text.contains("@"), "phone": text.contains("+"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"),
           "ip": text.rlike(r"[0-9]\.[0-9]"), "written_email": text.rlike(r"(?i)[\[(](?:dot|\.)[\])]"), "number": text.rlike("[0-9]{2}[)]?[ .-]"),
           "secret": text.rlike(r"[:=]"), "mixed": text.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]")}
    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    out = docs.withColumns({f"_{k}": F.when(has[k], spans(text, p)).otherwise(none) for k, p in (PATTERNS | EXTRA).items()})

    def told(kind, array):
        return F.transform(array, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["match"].alias("match"),
                                                     F.substr(text, F.greatest(F.lit(1), s["start"] - 11), F.least(s["start"], F.lit(12))).alias("before")))

    def checked(kind, good):
        if good:
            return F.filter(f"_{kind}", lambda s: valid(kind, s["match"]))
        return F.filter(f"_{kind}", lambda s: ~valid(kind, s["match"]) & (F.length(digits(s["match"])) >= 8))

    out = out.withColumns({k: checked(k, True) for k in KINDS})
    failed = [told(f"not_{k}", checked(k, False)) for k in ("ip", "card", "phone")]
    out = out.withColumns({"extra": F.concat(*[told(k, F.col(f"_{k}")) for k in EXTRA]), "failed": F.concat(*failed),
                           "sure": F.concat(*[told(k, F.col(k)) for k in KINDS])})
    return out.select("id", "text", *KINDS, "extra", "failed", "sure")


def cells(c: Column) -> dict[str, Column]:
    """Binned format and context features of a candidate struct."""
    match = c["match"]
    before = F.lower(c["before"])
    raw = {"size": F.length(match), "digits": F.length(digits(match)), "letters": F.length(F.regexp_replace(match, "[^A-Za-z]+", "")),
           "marks": F.length(F.regexp_replace(match, "[A-Za-z0-9]+", "")), "at": F.length(F.regexp_replace(match, "[^@]+", "")),
           "named": (before.rlike(r"(?:mail|phone|tel|call|card|token|key|secret|ssn|iban|contact|pass)[^a-z]{0,4}$")
                     | F.lower(match).rlike("^(?:token|secret|pass|pwd|api|access)")).cast("int"),
           "edge": ((F.length(before) == 0) | before.rlike(r"[\s(\[<:\"'=]$")).cast("int")}
    return {k: sum((F.when(raw[k] >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)) for k, cuts in FEATURES.items()}


def _table(found: DataFrame) -> DataFrame:
    """Candidates of a training sample, folded to counts per generator and feature vector: positives and negatives."""
    lab = [("sure", lambda c: F.lit(1)), ("failed", lambda c: F.lit(0)),
           ("extra", lambda c: F.when(c["kind"] == "secret", 1).when(c["kind"] == "mixed", 0).otherwise(None))]

    def labelled(name, y):
        return F.transform(name, lambda c: F.struct(c.alias("c"), y(c).cast("int").alias("y")))

    both = F.concat(*[labelled(*x) for x in lab])
    rows = found.select(F.explode(both).alias("x")).where("x.y is not null")
    rows = rows.select(F.col("x.c.kind").alias("kind"), "x.y", *[v.alias(k) for k, v in cells(F.col("x.c")).items()])
    return rows.groupBy("kind", *FEATURES).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


Tree = tuple  # (feature, cut, left, right) or (value,)


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    best = (1e-9, None)
    score = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
    everything = np.ones(len(x), bool)
    for k in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, k])[1:]:
            up = x[:, k] >= cut
            gain = score(up) + score(~up) - score(everything)
            if gain > best[0]:
                best = (gain, (k, int(cut), up))
    if best[1] is None:
        return (float(RATE * grad.sum() / (hess.sum() + 1)),)
    k, cut, up = best[1]
    return (k, cut, _tree(x[~up], grad[~up], hess[~up], depth - 1), _tree(x[up], grad[up], hess[up], depth - 1))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] >= tree[1], _value(tree[3], x), _value(tree[2], x))


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, list[Tree], float]:
    """Bias, trees and the calibrated threshold: the lowest score from which on the counted precision is `PRECISION`."""
    n = pos + neg
    if not pos.sum() or not neg.sum():
        return (20.0 if pos.sum() else -20.0), [], 0.5
    bias = float(np.log(pos.sum() / neg.sum()))
    z, trees = np.full(len(x), bias), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(x, pos - n * p, n * p * (1 - p), DEPTH))
        z += _value(trees[-1], x)
    p = 1 / (1 + np.exp(-z))
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(pos[order]) / np.cumsum(n[order])
    good = np.flatnonzero(precision >= PRECISION)
    return bias, trees, float(max(0.5, p[order[good[-1]]] if len(good) else 1.0))


def compiled(bias: float, trees: list[Tree], cell: dict[str, Column]) -> Column:
    """The boosted score as a column."""
    names = list(FEATURES)

    def column(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        return F.when(cell[names[tree[0]]] >= tree[1], column(tree[3])).otherwise(column(tree[2]))

    return 1 / (1 + F.exp(-sum((column(t) for t in trees), F.lit(bias))))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, key_col: str | None = None) -> DataFrame:
    """id, text, an array of spans for each base kind, and `more`: spans that the trees add, as (kind, start, stop)."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # hashing needs a plain column: `id` may be a whole row
    taught = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col if key_col is None else key_col).alias("key"))
    rows = _table(candidates(bounded_sample(taught, ["key", "text"], train_rows).withColumn("id", F.lit(0)))).collect()  # at most CELLS rows a generator
    rows = sorted(rows)
    x = np.array([r[1:-2] for r in rows], float).reshape(-1, len(FEATURES))
    bias, trees, threshold = boost(x, np.array([r.pos for r in rows], float), np.array([r.neg for r in rows], float))
    found = candidates(plain)
    # what failed a rule's check only teaches, and what lies inside a sure span adds nothing
    new = F.filter("extra", lambda c: ~F.exists("sure", lambda b: (b["start"] <= c["start"]) & (b["stop"] >= c["stop"])))
    # the candidates' features are made once, as an array of structs; the trees then only compare small numbers
    made = F.transform(new, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"),
                                                                       F.struct(*[v.alias(k) for k, v in cells(c).items()]).alias("f")))
    found = found.withColumn("_made", made)
    kept = F.filter("_made", lambda c: compiled(bias, trees, {k: c["f"][k] for k in FEATURES}) >= threshold)
    return found.select("id", "text", *KINDS, F.transform(kept, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))).alias("more"))


def _listed(arrays: list[tuple[str, int]], more: bool) -> Column:
    """kind:start:end of all spans by start, then kind in the listed order, comma-joined."""
    def ranked(kind, rank):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    parts = [ranked(*x) for x in arrays]
    if more:
        parts.append(F.transform("more", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = [(k, i) for i, k in enumerate(KINDS)]
    return detect(docs, id_col, text_col).select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base, False).cast("binary"), 256).alias("base_sha256"), _listed(base, True).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with every span replaced by `MASK`; overlapping spans become one. A column n_chars, if there,
    follows the new text. The documents' own columns are kept in one struct, so that no name can clash."""
    names, spot = docs.columns, docs.schema[text_col].dataType
    packed = docs.select(F.struct(*[docs[c].alias(c) for c in names]).alias("doc"), docs[text_col].alias("text"))
    found = detect(packed, "doc", "text", key_col=f"doc.{id_col}")
    every = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for k in (*KINDS, "more")]))
    text, piece = F.col("text"), lambda a, b: F.substr(F.col("text"), a + 1, b - a)
    walked = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(MASK))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col(f"id.{text_col}").isNotNull(), F.when(F.size(every) > 0, walked).otherwise(text)).cast(spot)
    found = found.select(F.col("id").alias("doc"), new.alias("new"))
    kept = {text_col: F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return found.select(*[kept.get(c, F.col("doc")[c]).alias(c) for c in names])
