"""Operators with exact results against plain Python, on the supplied small tables and on awkward rows."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, pii, sentencepieces, setsketch, simhash, suffix_dedup, token_counts
from llm.queries import QUERIES
from tests.llm import brute
from tests.llm.brute import FOLDER, awkward, sha


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- suffix dedup

def test_repeats_are_removed(spark, docs):
    assert by_id(QUERIES["op1_suffix_dedup"](spark, FOLDER)) == brute.repeats(docs)


def test_repeats_on_awkward_rows(spark):
    table = awkward(spark, 3000)
    rows = suffix_dedup.remove_repeats(table, digest=True).collect()
    assert len(rows) == table.count()
    want = brute.repeats(dict(texts_of(table)).items())  # rows that share an id do not count as earlier than each other
    assert {tuple(r) for r in rows} == {(k, *v) for k, v in want.items()}


def test_unlike_rows_that_share_an_id_keep_their_own_marks(spark):
    line = lambda k, n=120: " ".join(f"{k}w{i * i % 997}" for i in range(n))
    rows = [(1, line(1)), (5, line(7) + line(1)[100:500] + line(8)), (5, line(9)), (5, line(9)), (5, line(7)[:300] + line(10) + line(10)[20:400]),
            (6, line(9)[:200] + line(7)), (None, line(11)), (None, line(12) + line(11)[:250]), (None, line(12)), (2, line(11)), (2, line(12)[50:])]
    rank = lambda i: -1 if i is None else i

    def want(i, text):
        text, gone = text.encode(), set()
        before = {x.encode()[k:k + 100] for j, x in rows if rank(j) < rank(i) for k in range(len(x) - 99)}
        for k in range(len(text) - 99):
            piece = text[k:k + 100]
            if piece in before:
                gone |= set(range(k, k + 100))
            before.add(piece)
        kept = bytes(b for k, b in enumerate(text) if k not in gone)
        return i, len(text), len(gone), sum(k - 1 not in gone for k in gone), sha(kept)

    for parts in (1, 4):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), digest=True).collect()
        assert sorted(map(tuple, got), key=str) == sorted((want(*r) for r in rows), key=str)


@pytest.mark.parametrize("length,q", [(20, 8), (30, 12), (64, 32)])
def test_repeats_of_other_lengths(spark, length, q):
    texts = [(i, ("abcab" * 20)[i:] + "z" * i + "the quick brown fox jumps over the lazy dog" * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert by_id(suffix_dedup.remove_repeats(df, length=length, q=q, digest=True)) == brute.repeats(texts, length)


def test_repeated_rows_are_not_earlier_than_each_other(spark):
    """Two and three rows of one id and text: what nothing earlier has stays in each, wherever batches and partitions end."""
    line = lambda k: " ".join(f"{k}w{i * i % 997}" for i in range(120))
    rows = [(1, line(1))] * 2 + [(2, line(2) + line(2)[:150])] * 3 + [(3, line(3))] + [(4, "x" + line(3))] * 2 + [(5, line(1)[:300] + line(5))] * 2
    want = {(k, *v) for k, v in brute.repeats(dict(rows).items()).items()}
    assert {w[2] for w in want if w[0] in (1, 3)} == {0}
    for parts, size in ((1, "10000"), (5, "10000"), (1, "1"), (5, "3")):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            got = suffix_dedup.remove_repeats(df, digest=True).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_kept_text_without_repeats(spark):
    line = "".join(chr(97 + i * i % 26) for i in range(150))
    df = spark.createDataFrame([(1, "a" + line), (2, line + "b")], "doc_id long, text string")
    assert by_id(suffix_dedup.remove_repeats(df))[2][-1] == "b"


# ---- near-duplicates

def test_unlike_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    text = lambda k: " ".join(f"{k}w{i * i % 9973}" for i in range(400))
    near = lambda k: text(k) + " and one more"
    rows = [(1, text("a")), (1, text("q")), (2, near("a")), (3, near("q")), (None, text("n")), (None, text("m")), (8, near("n")), (9, near("m")),
            (5, text("z")), (5, text("z"))]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, t1 int, component int").repartition(3)
    got = sorted((str(r.doc_id), r.component_id) for r in setsketch.classes(df).collect())
    assert got == sorted([("1", 1), ("1", 1), ("2", 1), ("3", 1), ("None", None), ("None", None), ("8", None), ("9", None), ("5", 5), ("5", 5)], key=str)
    kept = setsketch.keep_one(df).collect()
    assert sorted((str(r.doc_id), r.text[:1]) for r in kept) == [("1", "a"), ("1", "q"), ("5", "z"), ("None", "m"), ("None", "n")]
    assert setsketch.keep_one(df).columns == df.columns


def test_components(spark, docs):
    sets = {k: brute.shingles(t) for k, t in docs}
    root = brute.components(sets, 85)
    want = {k: (len(s), root[k], root[k] == k) for k, s in sets.items()}
    assert by_id(QUERIES["op9_near_dedup"](spark, FOLDER)) == want


def test_components_on_awkward_rows(spark):
    got = [tuple(r) for r in setsketch.classes(awkward(spark, 3000), threshold=0.85).collect()]
    assert len(got) == 18
    of = {r[0]: r for r in got}
    assert of[1] == (1, 0, 1, True) and of[2] == (2, 0, 2, True) and of[3] == (3, 0, 3, True)
    assert of[8][2] == 7 and not of[8][3] and of[7][3]
    assert of[4][2] is None and of[5][2] is None  # their copy without an id comes first
    assert sum(r[0] == 5 for r in got) == 2


def test_a_chain_and_a_large_group_of_near_copies(spark):
    """Links between different texts are kept though only some pairs of a group are near."""
    words = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(60):  # each differs from the one before by one word, so the ends are far apart
        words = [*words]
        words[(k * 3) % 200] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"q{i if i != k else -k}" for i in range(300))) for k in range(40)]
    rows += [(200 + k, " ".join(f"q{i}" for i in range(300))) for k in range(5)]
    sets = {k: brute.shingles(t) for k, t in rows}
    root = brute.components(sets, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(setsketch.classes(df))
    assert {k: v[1] for k, v in got.items()} == root
    kept = {r.doc_id for r in setsketch.keep_one(df).collect()}
    assert kept == {k for k in root if root[k] == k}


def test_sketches_estimate_the_similarity():
    import numpy as np
    rng = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.85, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both:2 * n - both]
        reg = [setsketch.registers(setsketch.minima(np.sort(x), np.array([0, n]), setsketch.REGISTERS)) for x in (a, b)]
        est = setsketch.likely_jaccard(*reg, np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(est - j) < 0.09
        merged = setsketch.registers(setsketch.minima(np.unique(np.r_[a, b]), np.array([0, len(set(a) | set(b))]), setsketch.REGISTERS))
        assert (merged == np.maximum(*reg)).all()


# ---- decontamination

def items_of(path=f"{FOLDER}/benchmark.parquet"):
    return [(r["item_id"], r["text"]) for r in pq.read_table(path).to_pylist()]


def test_contamination(spark, docs):
    items = items_of()
    got = by_id(QUERIES["op10_decontamination"](spark, FOLDER))
    assert got == {k: brute.contamination(t, items) for k, t in docs}


def test_contamination_with_short_null_and_repeated_items(spark):
    items = [(1, "alpha beta"), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven"), (4, "gamma"),
             (5, "Two three four five six seven eight nine ten eleven twelve"), (None, "delta delta delta"), (6, "alpha beta"), (7, "x y x y x y x y x y x y")]
    texts = ["alpha beta gamma", "zero one two three four five six seven eight nine ten eleven twelve", "delta delta", "Delta, DELTA; delta delta",
             "x y x y x y x y x y x", "y x y x y x y x y x y", None, "", "alpha, gamma beta"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.contamination(t, [("" if n is None else n, x) for n, x in items]) for i, t in enumerate(texts)}
    assert by_id(decontaminate.report(df, bench).drop("kept_text")) == want
    assert by_id(decontaminate.report(df, bench, group_chars=40).drop("kept_text")) == want  # several automata
    empty = decontaminate.report(df, bench.limit(0)).collect()
    assert not any(r.contaminated for r in empty) and len(empty) == len(texts)


def test_spans_go_and_full_copies_are_dropped(spark):
    table = awkward(spark, 1000)
    item = " ".join(f"item{i}" for i in range(12))
    extra = spark.createDataFrame([(50, f"before this, {item} and after that come many more plain words so that it stays clean enough for us", "en", "s", 1, "x", 1, 0.1, "k"),
                                   (51, item + " too", "en", "s", 1, "x", 1, 0.1, "k")], brute.SCHEMA)
    out = decontaminate.decontaminate(table.unionByName(extra), spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == table.columns and 51 not in rows and out.count() == table.count() + 1
    assert rows[50].text.startswith("before this,  and after") and rows[50].n_chars == len(rows[50].text)
    assert rows[2].text is None and rows[4].text == dict(texts_of(table))[4]


# ---- personal data

def of_base(text):
    spans = brute.personal(text)
    return (*[sum(k == s[3] for s in spans) for k in pii.KINDS], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))


def test_personal_data(spark, docs):
    got = by_id(QUERIES["op7_pii"](spark, FOLDER))
    assert {k: v[:5] for k, v in got.items()} == {k: of_base(t) for k, t in docs}
    for k, text in docs:
        listed = got[k][5].split(",") if got[k][5] else []
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in brute.personal(text)} <= set(listed)


def test_personal_data_on_awkward_rows(spark):
    table = awkward(spark, 2000)
    rows = pii.report(table).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(of_base(t) for _, t in texts_of(table))
    odd = ["🙂 a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 +1(23)4567890-", "+12345678901234567890 4111-1111-1111-1111 00012.1.1.1", "a@b a@b.c. @x.y ..@..a.b"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {k: v[:5] for k, v in by_id(pii.report(df)).items()} == {i: of_base(t) for i, t in enumerate(odd)}


def test_redaction_masks_whole_spans_and_keeps_columns(spark):
    table = awkward(spark, 500)
    out = pii.redact(table)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == table.columns and out.count() == table.count()
    text = rows[13].text
    assert text.count(pii.MASK) >= 4 and "bob@" not in text and "4111 1111" not in text and "10.0.0.256" in text
    assert rows[13].n_chars == len(text) and rows[2].text is None and rows[4].text == dict(texts_of(table))[4]


# ---- SimHash

def test_edited_texts(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(order)
    for i, (k, text) in enumerate(order):
        after_id, after = order[(i + 1) % len(order)]
        half = len(text) // 2
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == sha(text[:len(text) - half] + after[:half])
        apart = bin(int(got[k].fingerprint, 16) ^ int(got[after_id].fingerprint, 16)).count("1")
        assert got[k].near_next == 1 - apart / 64
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_the_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PER_BUCKET", 2)
    monkeypatch.setattr(simhash, "RANGES", 3)
    ids = [None, -40, -7, 0, 1, 2, 3, 50, 51, 52, 400, 401, 1000, 1001, 5000, 5001, 5002, 9999]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    rows = simhash.with_next(simhash.keyed(df)).where("copied = 0").collect()
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert {r.text: r.next_text for r in rows} == {f"text {a}": f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def vote(text):
    """A text's fingerprint, term by term and bit by bit."""
    import re
    import xxhash
    sums, total = [0] * 64, 0
    for word in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()):
        weight, h = min(12, len(word)) ** 2, xxhash.xxh64_intdigest(word.encode(), seed=42)
        total += weight
        for k in range(64):
            sums[k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * sums[k] > total)


def test_fingerprints_are_the_votes_of_all_terms(spark, docs):
    texts = dict(docs)
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        own, other = vote(text), vote(text[:len(text) - half] + after[:half])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (f"{own:016x}", f"{other:016x}")
        assert got[i].near_edited == 1 - (own ^ other).bit_count() / 64


@pytest.mark.parametrize("ids", [[-9 * 10**18, 0, 9 * 10**18], [*range(40), 10**15], [-(1 << 63) + 1, (1 << 63) - 1], [*range(-20, 20), None, None]])
def test_next_documents_of_widely_spread_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(simhash, "PER_BUCKET", 2)
    df = spark.createDataFrame([(i, f"text {k} of {i}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    rows = simhash.with_next(simhash.keyed(df)).where("copied = 0").collect()
    order = sorted(((-r.id, r.text) for r in rows))
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.text: r.next_text for r in rows} == want


def test_fingerprints_on_awkward_rows(spark):
    table = awkward(spark, 2000)
    rows = simhash.edited_likeness(table).collect()
    assert len(rows) == table.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, r)
    assert of[1].fingerprint == of[2].fingerprint == "0" * 16 and of[4].fingerprint == of[5].fingerprint == of[None].fingerprint
    assert of[7].fingerprint == of[8].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert simhash.edited_likeness(one).collect()[0].near_next == 1.0


def test_block_tables_find_all_near_fingerprints(spark):
    import random
    rng = random.Random(4)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 6))) for p in prints for _ in range(2)]
    df = spark.createDataFrame([(p,) for p in prints + prints[:20]] + [(None,)], "fingerprint long")
    for radius, blocks in ((3, 6), (2, 4), (0, 3)):
        want = {(a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        got = [tuple(r) for r in simhash.near_pairs(df, radius, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want


# ---- tokens

def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df, texts in ((QUERIES["op5_token_counts"](spark, FOLDER), docs), (token_counts.count_tokens(awkward(spark, 3000)), texts_of(awkward(spark, 3000)))):
        want = sorted((-1 if k is None else k, len((t or "").encode()), n, n > 512) for k, t in texts for n in [len(whole.encode(t or "", add_special_tokens=False))])
        assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in df.collect()) == want


def test_counts_of_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = token_counts.count_tokens(awkward(spark, 300), path).where("doc_id > 6").collect()
    texts = dict(texts_of(awkward(spark, 300)))
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(whole.encode(t or "", add_special_tokens=False)) for k, t in texts.items() if k and k > 6}


def test_sentence_pieces(spark, docs):
    import public_tokenizers
    import sentencepiece
    import numpy as np
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = awkward(spark, 2000)
    both = table.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 1000))
    texts = texts_of(both)
    rows = sentencepieces.decode(sentencepieces.encode(both)).collect()
    want = sorted((-1 if k is None else k, sp.encode(t or "")) for k, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    for r in rows:
        assert r.decoded == sp.decode(r.ids) and r.round_trip and r.n_pieces == len(r.ids)
        assert r.ids_sha256 == sha(np.array(r.ids, "<i4").tobytes())


def test_pieces_of_hard_texts():
    import random
    import sentencepiece
    from llm.sentencepieces import Encoder, Pieces, _model, decode_ids
    pieces, sp = Pieces(_model(None)), sentencepiece.SentencePieceProcessor(model_proto=_model(None))
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "▁x▁▁", "=" * 40, "\0a\0", "<s> </s> <unk> <0x0A>", "a" * 3000, " " * 100 + "x",
             "".join(rng.choice("abc =-\n") for _ in range(5000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000)), "é ﬁ ½ 🙂"]
    encoder = Encoder(pieces)
    for part in (texts, texts[::-1]):  # the second run finds its words known
        ids, bounds = encoder.texts(part)
        for i, t in enumerate(part):
            own = ids[bounds[i]:bounds[i + 1]]
            assert own.tolist() == sp.encode(t) and decode_ids(pieces, own) == sp.decode(own.tolist())


# ---- empty tables

def test_empty_tables(spark):
    docs = awkward(spark, 10).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.remove_repeats(docs), setsketch.classes(docs), setsketch.keep_one(docs), decontaminate.report(docs, bench),
               decontaminate.decontaminate(docs, bench), pii.report(docs), pii.redact(docs), simhash.edited_likeness(docs),
               token_counts.count_tokens(docs), sentencepieces.encode(docs), simhash.near_pairs(docs.select(F.lit(1).alias("fingerprint")))):
        assert df.count() == 0
