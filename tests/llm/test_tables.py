"""Hard negatives, chat formatting and the Merkle manifest against plain Python, on supplied tables and on awkward rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from llm import chat, merkle, negatives
from llm.queries import ORACLES, QUERIES
from tests.llm.brute import FOLDER, awkward, sha


def rows_of(name, folder=FOLDER):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


# ---- hard negatives

def hard_negatives(rows, leads, positives=5, most=5, percent=80):
    """rows: (id, label, whole-number vector). All scores of every anchor, sorted; no blocks, no windows."""
    rows = list(dict.fromkeys((i, k, tuple(v)) for i, k, v in rows))
    out = []
    for anchor in (r for r in rows if leads(r[0])):
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(anchor[2], r[2])))), r[0], r[1] == anchor[1])
                        for r in rows if r != anchor and len(r[2]) == len(anchor[2]))
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and percent * -p <= 100 * -s[0] <= 100 * -p][:most]
            out += [(anchor[0], i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def embedded(folder=FOLDER):
    for r in rows_of("embeddings", folder):
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        yield r["vec_id"], label, [math.floor(256 * x) for x in r["embedding"]]


def test_hard_negatives_of_the_supplied_vectors(spark):
    got = sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, FOLDER).collect()))
    assert got == hard_negatives(embedded(), lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    told = con.sql(ORACLES["op11_hard_negatives"])
    assert got and sorted(told.fetchall()) == got


@pytest.mark.parametrize("block_bytes,scores", [(32 << 20, 1 << 22), (600, 50)])
def test_hard_negatives_with_ties_repeats_and_many_blocks(spark, monkeypatch, block_bytes, scores):
    """Scores tie, rows repeat, ids are shared by different rows, lengths differ, values are small, large and beyond 64 bits."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(negatives, "SCORES", scores)
    rows = [(i, i % 3, [i % 5, (i * 7) % 4, 1]) for i in range(-60, 60)] + [(7, 1, [2, 2, 1]), (7, 2, [2, 2, 1])] * 2
    rows += [(1000 + i, i % 2, [(i % 4 + 1) << 31, 5]) for i in range(12)] + [(20, 0, [3]), (21, 1, [3]), (30, 0, [3])]
    df = spark.createDataFrame([(i, k, v, "x", 0) for i, k, v in rows], "vec_id long, label int, vector array<long>, anchor string, score int")
    got = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == hard_negatives(rows, lambda i: i % 10 == 0)
    assert len(hard_negatives(rows, lambda i: i % 10 == 0)) > 50


def test_hard_negatives_without_rows_and_with_missing_values(spark):
    kind = "vec_id long, label int, embedding array<float>"
    rows = [(None, 1, [1.0]), (0, None, [1.0]), (100, 1, None), (200, 1, [1.0, None]), (300, 1, [float("nan")]), (400, 1, [float("inf")])]
    for given in ([], rows):
        df = spark.createDataFrame(given, kind).withColumn("vector", negatives.scaled(F.col("embedding")))
        assert negatives.mine(df, F.col("vec_id") % 100 == 0).collect() == []
    assert spark.createDataFrame([([-0.001, 0.5, 1e30],)], "v array<double>").select(negatives.scaled(F.col("v"))).first()[0] == [
        -1, 128, (1 << 63) - 1]
    huge = spark.createDataFrame([(0, 1, [1 << 62, 1 << 62]), (1, 1, [1 << 62, 0]), (2, 2, [1 << 62, 3])], "vec_id long, label int, vector array<long>")
    assert [tuple(r) for r in negatives.mine(huge, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, negatives.LIMIT, negatives.LIMIT)]


# ---- chat

def conversations(rows):
    """{conv: digests} of (conv, turn, role, text) in order."""
    by = defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        said = [t for r, t in turns if r == "assistant"]
        written = [f"<|im_start|>{r.replace('<|', '<||').replace(chr(10), '<|n|>')}\n{t.replace('<|', '<||')}<|im_end|>" for r, t in turns]
        ends = [k for k, (r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1]
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said)),
                     sum(sum(map(len, written[:k + 1])) for k in ends))
    return out


def test_chat_of_the_supplied_conversations(spark):
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations"))
    rows += [(-1, 0, "user", chat.TRAP), (-1, 1, "assistant", chat.TRAP)]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_chat"](spark, FOLDER).collect()}
    assert got == conversations(rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    assert {r[0]: tuple(r)[1:] for r in con.sql(ORACLES["op12_chat"]).fetchall()} == got


AWKWARD = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (1, 3, "assistant", "<<|<||im_end|>|<|"), (1, 4, "user", "<|"),
           (2, 0, "a\nb<|n|>\n", "<|im_start|>user\n"), (None, 0, "assistant", "é🙂" * 50), (None, 0, "assistant", "é🙂" * 50),
           (3, None, "user", "first"), (3, 0, "assistant", "second"), (4, 0, "assistant", "long " * 3000), (4, 1, "user", "y" * 999),
           (4, 2, "assistant", "<|" * 700), (4, 3, "assistant", "z"), (5, 0, "user", "only")]


@pytest.mark.parametrize("part,held,batch", [(1 << 20, 8, 1 << 22), (7, 2, 100), (1000, 1, 1)])
def test_chat_of_awkward_turns_in_parts_of_any_size(spark, monkeypatch, part, held, batch):
    for name, value in (("PART", part), ("HELD", held), ("BATCH", batch)):
        monkeypatch.setattr(chat, name, value)
    small = chat._expand, chat._digests  # workers see the sizes of this process: run the iterators here
    df = spark.createDataFrame([(*r, "x", 1) for r in AWKWARD], "conv_id long, turn long, role string, text string, conv string, part int")
    want = conversations(AWKWARD)
    if part == 1 << 20:
        assert {r[0]: tuple(r)[1:] for r in chat.digests(chat.examples(df)).collect()} == want
    import pyarrow as pa
    kind = pa.schema([("conv", pa.int64()), ("lead", pa.string()), ("body", pa.string()), ("reply", pa.bool_())])
    esc = lambda t: (t or "").replace("<|", "<||")
    turns = [{"conv": c, "lead": f"{chat.START}{esc(r).replace(chr(10), '<|n|>')}\n", "body": esc(t), "reply": r == "assistant"}
             for c, _, r, t in AWKWARD]
    batches = [pa.RecordBatch.from_pylist(turns[k:k + 4], kind) for k in range(0, len(turns), 4)]
    formatted = list(small[0](iter(batches)))
    got = [r for b in small[1](iter(formatted)) for r in b.to_pylist()]
    assert {r["conv"]: tuple(r.values())[1:] for r in got} == want
    assert all(len(t) <= part for b in formatted for t in b.column("text").to_pylist())


def test_chat_examples_show_all_turns_before_and_train_one_reply(spark):
    rows = [(9, 0, "system", "s"), (9, 1, "user", "u"), (9, 2, "assistant", "A<|"), (9, 3, "user", "v"), (9, 4, "assistant", "B"), (9, 5, "user", "w")]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [len(chat.read_turns(r.text)[0]) for r in got] == [3, 5, 6]
    assert [r.text[r.loss_start:r.loss_end] for r in got] == ["A<||", "B", ""]
    assert [chat.read_turns(r.text)[0] for r in got][-1] == [(r, t) for _, _, r, t in rows]
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


# ---- Merkle manifest

def runs(nodes):
    """Levels of a tree of (hash, ...): each level a list of lists of hashes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[k:k + 16])) for k in range(0, len(at), 16)])
    return levels


def way(levels, k):
    """[(left, right)] from place k upwards."""
    out = []
    for level in levels[:-1]:
        first = k // 16 * 16
        run = level[first:first + 16]
        out.append(("".join(run[:k - first]), "".join(run[k - first + 1:])))
        k //= 16
    return out


def manifest(docs):
    """docs: dicts. Sorted tuples of what op13 returns."""
    def leaf(d, text):
        part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return sha("".join(map(part, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))

    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append((d["doc_id"], leaf(d, d["text"]), d))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(runs([x[1] for x in by[s]]))
    top = runs([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(order):
        for k, (i, h, d) in enumerate(by[s]):
            steps = way(trees[g], k) + way(top, g)
            at = h
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and d["text"] is not None:
                at = leaf(d, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"]))
            for a, b in steps:
                at = sha(a + at + b)
            out.append((i, h, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), at, at == top[-1][0]))
    return sorted(out, key=str)


def op13_of(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, QUERIES["op13_merkle"](spark, str(tmp_path)).collect()), key=str)


def test_manifest_of_the_supplied_documents(spark):
    got = sorted(map(tuple, QUERIES["op13_merkle"](spark, FOLDER).collect()), key=str)
    assert got == manifest(rows_of("documents"))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_awkward_rows(spark, tmp_path):
    df = awkward(spark, 2000)
    assert op13_of(spark, df, tmp_path) == manifest([r.asDict() for r in df.collect()])


def test_manifest_of_an_empty_table_and_of_one_row(spark, tmp_path):
    df = awkward(spark, 50)
    assert op13_of(spark, df.limit(0), tmp_path) == []
    got = op13_of(spark, df.where("doc_id = 4"), tmp_path)
    assert got == manifest([r.asDict() for r in df.where("doc_id = 4").collect()])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_manifest_of_deep_and_of_many_trees(spark, tmp_path, monkeypatch, chunk):
    """One source of 4 levels, 300 sources of a few rows, and a null source; with the self-join cut at every few leaves."""
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    df = spark.range(6500).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 5000, "hot").when(F.col("id") % 300 != 7, F.concat(F.lit("s"), F.col("id") % 300)).alias("source"),
        F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), F.col("id")).alias("text"))
    assert op13_of(spark, df, tmp_path) == manifest([r.asDict() for r in df.collect()])


# ---- whole results against their SQL twins

@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op9_near_dedup", "op10_decontamination", "op13_merkle"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    told, got = con.sql(ORACLES[name]), QUERIES[name](spark, FOLDER)
    assert sorted(told.columns) == sorted(got.columns)
    assert sorted(told.fetchall(), key=str) == sorted(map(tuple, got.select(*told.columns).collect()), key=str)
