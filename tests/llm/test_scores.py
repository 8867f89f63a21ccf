"""Scores of the learned operators recomputed in plain Python: statistics and rules, pairs of terms one by one, n-gram sums."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm import language, quality, textbytes, toxicity
from llm.queries import QUERIES
from tests.llm.brute import FOLDER, fold, lower

M = (1 << 64) - 1


LARGER = "/root/testdata/sf0.01"  # with enough toxic documents for own weights


def documents(folder=FOLDER):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & M
    return x ^ (x >> 32)


def tables(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def statistics(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    lines, n, c = text.split("\n"), max(1, len(words)), max(1, len(text))
    count = lambda marks: sum(text.count(m) for m in marks)
    capitals = sum("A" <= x <= "Z" or "À" <= x <= "Ö" or "Ø" <= x <= "Þ" for x in text)
    return {"chars": len(text), "words": len(words), "word_size": c / n, "distinct_words": len(set(words)) / n,
            "distinct_lines": len(set(lines)) / len(lines), "symbols": count("#$%&*~^=") / n, "pipes": count("|") / n,
            "shouts": count("!") / n, "capitals": capitals / c, "digits": sum("0" <= x <= "9" for x in text) / c, "stops": count(".") / n}


def test_quality_scores_are_sums_of_met_rules(spark):
    docs, labels = tables(spark)
    bias, rules = quality.train(docs, labels, "doc_id", "text", "quality", quality.TRAIN_ROWS)
    got = {r.doc_id: r.score for r in QUERIES["op2_quality"](spark, FOLDER).collect()}
    assert rules and len(got) == docs.count()
    for d in documents():
        s = statistics(d["text"])
        met = sum(w for rule, w in rules if all((s[quality.STATISTICS[k]] > cut) == above for k, above, cut in rule))
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-bias - met)), abs=1e-9)


def test_statistics_of_awkward_texts(spark):
    texts = ["", "   \n\t ", "A!|b..\n\nA!|b..\n", "É È ß | ## 12 12", "x" * 50_000, "a b c\vd"]
    rows = quality.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).collect()
    for r in rows:
        assert [r[s] for s in quality.STATISTICS] == pytest.approx([statistics(texts[r.id])[s] for s in quality.STATISTICS])


def buckets(text):
    """Distinct buckets of the words and their beginnings."""
    codes = [int(c) for c in textbytes._BYTE_CODES]
    base, found = int(textbytes.BASE), set()
    for word in set(re.findall(rb"[0-9a-z\x80-\xff]+", lower(text).encode())):
        for size in (None, *(k for k in toxicity.BEGINNINGS if k < len(word))):
            h = mix(sum(codes[b] * pow(base, i, 1 << 64) for i, b in enumerate(word[:size])) & M)
            found.add((h if size is None else mix((h + size) & M)) % toxicity.BUCKETS)
    return sorted(found)


def test_toxicity_scores_weigh_every_pair_of_terms(spark):
    docs, labels = tables(spark, LARGER)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, LARGER).collect()}
    texts = sorted(documents(LARGER), key=lambda d: len(d["text"] or ""))
    assert len(got) == len(texts) and model.weights.any() and model.factors.any()
    for d in texts[::25]:
        at = buckets(d["text"])
        v = model.factors[:, at].astype(float)
        pairs = np.triu(v.T @ v, 1).sum()
        z = model.bias + float(model.weights[at].astype(float).sum()) + pairs / max(1, len(at))
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def grams(text):
    """Bucket counts of all n-grams."""
    s = re.sub(" +", " ", "".join(c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in text.lower()) + " ")
    found = Counter(s[i:i + k] for k in language.SIZES for i in range(len(s) - k + 1))
    del found[" "]
    out = Counter()
    for gram, n in found.items():
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) & M
        out[mix((h + len(gram) * 0x9E3779B97F4A7C15) & M) >> (64 - language.BITS)] += n
    return out


def test_language_scores_are_posteriors_of_plain_counts(spark):
    counts, seen = defaultdict(Counter), Counter()
    docs = {(d["doc_id"], d["text"], d["lang"]) for d in documents()}
    for doc_id, text, lang in docs:
        if fold(doc_id, 4) != 2 and lang is not None and text is not None:
            counts[lang].update(grams(text))
            seen[lang] += 1
    cells, names = 1 << language.BITS, sorted(counts)
    total = {g: sum(counts[g].values()) + language.ALPHA * cells for g in names}
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, FOLDER).collect()}
    assert len(names) > 1 and len(got) == len(docs)
    for doc_id, text, _ in docs:
        if not any(map(str.isalpha, text or "")):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        mine = grams(text)
        n = max(1.0, sum(mine.values()) / language.TEMPER)
        z = [sum(k * math.log((counts[g][b] + language.ALPHA) / total[g]) for b, k in mine.items()) / n
             + math.log(seen[g] / sum(seen.values())) for g in names]
        p = [math.exp(x - max(z)) for x in z]
        assert got[doc_id].lang_pred == names[int(np.argmax(z))]
        assert got[doc_id].score == pytest.approx(max(p) / sum(p), abs=1e-4)
