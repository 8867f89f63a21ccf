"""Learned operators: held-out accuracy, what they may look at, and awkward input."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from llm import language, pii, quality, toxicity
from llm.queries import QUERIES
from tests.llm import brute
from tests.llm.brute import awkward, fold

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}


@pytest.mark.parametrize("name,label,modulus,held,least", [("op2_quality", "quality", 3, 1, 0.97), ("op3_toxicity", "toxic", 5, 0, 0.92)])
def test_held_out_accuracy(spark, labels, name, label, modulus, held, least):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == pq.read_metadata(f"{FOLDER}/documents.parquet").num_rows
    for r in rows:
        assert r.held_out == (fold(r.doc_id, modulus) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) >= least


def test_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = QUERIES["op8_language_id"](spark, FOLDER).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.99


def test_language_on_awkward_rows(spark):
    rows = language.identify(awkward(spark, 500)).collect()
    of = {r.doc_id: r for r in rows}
    assert len(rows) == 18 and of[1].lang_pred == of[2].lang_pred == of[3].lang_pred == of[15].lang_pred == "und" and of[2].score == 0
    assert of[4].lang_pred in ("en", "fr")
    none = language.identify(awkward(spark, 20).where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identify(awkward(spark, 20).limit(0)).count() == 0


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, operator, label):
    docs = awkward(spark, 500)
    schema = f"doc_id long, {label} int, text string"
    for rows in ([], [(4, 1, "x")], [(4, 1, "x"), (6, 0, None), (7, 0, None), (None, 1, None), (8, None, None), (4, 1, "x"), (10, 1, None), (11, 0, None)]):
        out = operator.score(docs, spark.createDataFrame(rows, schema)).collect()
        assert len(out) == 18 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert operator.score(docs.limit(0), spark.createDataFrame([], schema)).count() == 0


def test_pairs_count_for_more_than_their_terms():
    """Two terms that are harmless alone and toxic together: the factors learn what weights cannot."""
    rng = np.random.default_rng(2)
    x = (rng.random((4000, 6)) < 0.4).astype(np.float32)
    y = x[:, 0] * x[:, 1]
    model = toxicity.FactorizationMachine(6).fit(x, y, steps=600, penalty=1e-5)
    both = model.scores(np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1]), 3)
    assert both[0] > 0.5 > max(both[1], both[2])


def test_a_pair_of_terms_that_are_neutral_alone_is_learned(spark):
    """From texts to scores: each of four words is as frequent in clean as in toxic texts, two of their pairs are toxic."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(800):
        a, b = k % 2, k // 2 % 2
        words = [f"grp{a}", f"slr{b}", *(f"w{i}" for i in rng.integers(0, 300, 20))]
        rows.append((k, " ".join(rng.permutation(words)), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    of = {k: y for k, _, y in rows}
    held = toxicity.score(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).where("held_out").collect()
    assert len(held) > 100 and np.mean([r.predicted == of[r.doc_id] for r in held]) > 0.95


def test_only_copies_leave_the_training_sample(spark):
    """Texts that share words, any of them, all stay; copies up to case and white space count once a class."""
    texts = [f"the same common words and then {w}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    rows = [(k, t, k % 2) for k, t in enumerate(texts)] + [(100 + k, "  " + t.upper().replace(" ", "\n "), k % 2) for k, t in enumerate(texts)]
    rows += [(200, texts[0], 1)]
    learn = [(t, y) for k, t, y in rows if fold(k, 5) != 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic", 1000).collect()
    key = lambda t, y: (" ".join(t.lower().split()), y)
    assert sorted(key(r.text, r.label) for r in got) == sorted({key(t, y) for t, y in learn})


def test_rules_are_few_and_compiled(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    bias, rules = quality.fit(x, y)
    assert rules and len(rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r.p for r in df.select(quality.compiled(bias, rules).alias("p")).collect()])
    assert ((got >= 0.5) == (y == 1)).mean() > 0.98


def test_boosting_separates_and_calibrates():
    x = np.array([[a, b, 0, 0, 0, 0, 0] for a in range(6) for b in range(5)], float)
    pos, neg = np.where((x[:, 0] > 2) & (x[:, 1] > 1), 30.0, 1.0), np.where((x[:, 0] > 2) & (x[:, 1] > 1), 1.0, 30.0)
    bias, trees, threshold = pii.boost(x, pos, neg)
    p = 1 / (1 + np.exp(-(bias + sum(pii._value(t, x) for t in trees))))
    assert (((p >= threshold) == (pos > neg)).all()) and 0.5 <= threshold <= 1


def test_named_secrets_are_added(spark):
    found = "".join(r.spans for r in QUERIES["op7_pii"](spark, FOLDER).collect())
    assert "secret:" in found


def test_pipeline(spark):
    """Every stage on the one before: only documents of the input, each decision in effect, final ids as the library's."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    table, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, stage(spark, table, folder).cache()
        seen[name] = table
        assert name == "sentencepiece" or table.schema.simpleString() == docs.schema.simpleString()
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in table.collect()}
        assert set(new) <= set(old)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(before, labels).where("score >= 0.5").collect()}
            assert set(new) == set(old) - bad
        if name == "near_duplicates":
            root = brute.components({k: brute.shingles(r.text) for k, r in old.items()}, 80)
            assert set(new) == {k for k in root if root[k] == k}
        if name == "decontamination":
            hits = {k: brute.contamination(r.text, items) for k, r in old.items()}
            assert set(new) == {k for k, (n, hit, *_) in hits.items() if hit <= n / 2}
            assert all((new[k].text == old[k].text) == (hits[k][1] == 0) for k in new)
        if name == "personal_data":
            assert set(new) == set(old) and all((new[k].text != old[k].text) >= bool(brute.personal(old[k].text)) for k in new)
        if name == "sentencepiece":
            assert all(new[k].ids == sp.encode(old[k].text) for k in new) and set(new) == set(old)
    final = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == {r.doc_id: r.ids for r in seen["sentencepiece"].collect()}


def test_long_secrets_and_tokens_are_masked_whole(spark):
    """A key of 400 characters and a token of 5 000: nothing of them is left in the clear."""
    key, token = "kY7" * 133 + "z", "a1B2" * 1250
    rows = [(k, f"first line {k}\napi_key={key}\nthen {token} and the end") for k in range(30)]
    rows += [(100 + k, f"mail me at some{k}@example.com or +1 555 123 45{k % 10}7 now, card 4111 1111 1111 1111") for k in range(30)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 100").collect()
    assert all("kY7" not in r.text for r in out)
    for pattern, text in ((pii.EXTRA["mixed"], token), (pii.EXTRA["secret"], f"api_key={key}")):
        found = spark.createDataFrame([(f"x {text} y",)], "t string").selectExpr("t").select(pii.spans(pii.F.col("t"), pattern).alias("s")).first().s
        assert [(s.start, s.stop) for s in found] == [(2, 2 + len(text))]


def test_samples_of_shared_ids_stay_bounded(spark):
    """One labelled id under many documents brings one row, whatever their number; nothing goes through one task."""
    docs = spark.range(3000).select(pii.F.lit(7).cast("long").alias("doc_id"), pii.F.concat(pii.F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100).count() == 1
    from llm.common import bounded_sample
    some = bounded_sample(spark.range(20000), "id", 500)
    assert 350 < some.count() < 650 and "GlobalLimit" not in some._jdf.queryExecution().toString()
