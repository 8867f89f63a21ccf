"""SimHash fingerprints and the search for near ones, in DataFrame operations only.

A text's terms are its lower-cased words; each votes with the square of its length (up to `LONGEST`) on the 64 signed bits of
its hash, so long, telling words outweigh short, common ones. Votes are added two to a long (32 bits each, room for 2**25
words), so a text's votes are 32 sums that the code generator keeps in one pass without arrays.

Near fingerprints share at least `BLOCKS - radius` of `BLOCKS` blocks. One table a choice of such blocks, with the chosen
blocks permuted to the front as its key, finds every pair within the radius by equality; `near_pairs` works on distinct
fingerprints only, so equal texts never multiply, and reports a pair in its first table.

`with_next` puts each document beside the one that follows in descending id without sorting the corpus through one task: ids
fall into ranges of about `PER_BUCKET` documents, cut at quantiles and quantiles within those (at most `RANGES` times `RANGES`
ranges, which larger corpora fill more), and each range gets a copy of the next one's first document. Whole texts are shuffled once.

Defined cases: null or empty text has no votes and the fingerprint of all zeros; equal texts have equal fingerprints; a null id
comes after all others; rows that share an id follow each other by text; a single document follows itself; other columns are
not read; an empty table gives an empty result."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import keyed, unkeyed
from tidegauge.session import staged

BITS, BLOCKS, RADIUS, LONGEST, PER_BUCKET, RANGES = 64, 6, 3, 12, 1024, 256
_LANES = 0x0000000100000001


def votes(word: Column) -> list[Column]:
    """Sums over words: total weight, then 32 pairs of bit votes."""
    size = F.least(F.coalesce(F.length(word), F.lit(0)), F.lit(LONGEST)).cast("long")
    weight, h = size * size, F.xxhash64(word)
    return [F.sum(weight).alias("total"),
            *[F.sum(weight * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(BITS // 2)]]


def sign_bits() -> Column:
    """The fingerprint of summed votes: a bit is set if more than half the weight says so."""
    low = [F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(BITS // 2)]
    high = [F.shiftrightunsigned(F.col(f"v{k}"), 32) for k in range(BITS // 2)]
    bits = [F.when(v * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
            for k, v in enumerate([*low, *high])]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def text_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and `fingerprint` (long); keys tell rows apart."""
    terms = rows.select(*keys, F.explode_outer(words(F.coalesce(F.col(text_col), F.lit("")))).alias("word"))
    return terms.groupBy(*keys).agg(*votes(F.col("word"))).select(*keys, sign_bits().alias("fingerprint"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance) of all pairs a < b of distinct values of column `fingerprint` within the radius; equal values are no pair.
    Membership stays with the caller: group documents by fingerprint."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned(F.col("f"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = list(combinations(range(blocks), blocks - radius))
    distinct = prints.select(F.col("fingerprint").alias("f")).where("f is not null").distinct()
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[block[i] for i in c]).alias("key")) for t, c in enumerate(chosen)])
    entries = staged(distinct.select("f", F.explode(table).alias("e")).select("f", "e.*"), "blocks")
    a, b = entries.withColumnRenamed("f", "a"), entries.withColumnRenamed("f", "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.shiftrightunsigned(apart, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) == 0 for lo, hi in zip(edges, edges[1:], strict=False)]
    first = F.lit(-1)
    for t in reversed(range(len(chosen))):
        met = F.lit(True)
        for i in chosen[t]:
            met = met & same[i]
        first = F.when(met, t).otherwise(first)
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & (F.col("t") == first))
    return pairs.select("a", "b", F.bit_count(apart).alias("distance"))


def _ranged(texts: DataFrame) -> DataFrame:
    """The texts with `bucket`, which never falls as ids rise: quantiles of the ids, and quantiles within those, however the ids are
    spread. At most `RANGES` by `RANGES` buckets, so what is joined and collected has a bound."""
    n = texts.count()
    k = min(RANGES, max(1, math.ceil(math.sqrt(n / PER_BUCKET))))
    if k == 1:
        return texts.withColumn("bucket", F.lit(0))
    cuts = [i / k for i in range(1, k)]
    # how many of the cut points an id has reached
    reached = lambda points: F.size(F.filter(points, lambda e: e <= F.col("id")))
    coarse = texts.agg(F.percentile_approx("id", cuts)).first()[0]
    placed = texts.withColumn("_of", reached(F.array(*[F.lit(e) for e in coarse])))
    fine = staged(placed.groupBy("_of").agg(F.percentile_approx("id", cuts).alias("_cuts")), "ranges")
    return placed.join(F.broadcast(fine), "_of").withColumn("bucket", F.col("_of") * k + reached(F.col("_cuts"))).drop("_of", "_cuts")


def with_next(texts: DataFrame) -> DataFrame:
    """`keyed` texts as (bucket, row, copied, id, text, next_text): each with the text that follows in descending id. `copied` rows
    are the first of the next bucket, there for lookups only."""
    texts = _ranged(texts)
    heads = staged(texts.groupBy("bucket").agg(F.max("id").alias("head")), "heads")  # one row a bucket
    follow = heads.withColumn("to", F.lead("bucket").over(Window.orderBy("bucket")))
    # a range's first document also goes to the range above, whose last one it follows; the very first goes to the lowest range
    ends = heads.agg(F.min("bucket").alias("to"), F.max("head").alias("head")).where("to is not null")
    copies = follow.where("to is not null").select(F.col("head").alias("id"), "to").unionByName(ends.select(F.col("head").alias("id"), "to"))
    copies = staged(copies, "copies").groupBy("id").agg(F.collect_list("to").alias("to"))  # two at most
    places = F.concat(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copied"))),
                      F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda t: F.struct(t.alias("bucket"), F.lit(1).alias("copied"))))
    dealt = texts.join(copies, "id", "left").select("id", "text", F.explode(places).alias("p")).select("p.*", "id", "text")
    order = Window.partitionBy("bucket").orderBy("copied", F.desc("id"), "text")
    return dealt.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its half-replaced edit and of the next document: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = with_next(keyed(docs, id_col, text_col)).select("bucket", "row", "copied", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    quarter = [F.conv(F.substr(digest, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long").alias(f"d{i}") for i in range(4)]
    keys = ["bucket", "row", "copied", "id", "n_chars", "d0", "d1", "d2", "d3"]
    # all numbers, so the grouping stays in the fast hash map; it needs no exchange, being finer than the bucket
    rows = rows.select(*keys[:5], *quarter, "text", "edited")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    sides = rows.select(*keys, F.explode(both).alias("s")).select(*keys, "s.*")
    prints = fingerprints(sides, [*keys, "side"], "t").groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("other"))
    order = Window.partitionBy("bucket").orderBy("row")
    prints = prints.withColumn("after", F.lead("own").over(order)).where("copied = 0")
    return prints.select(unkeyed().alias(id_col), "n_chars", F.concat(*[text_of(F.col(f"d{i}")) for i in range(4)]).alias("edited_sha256"),
                         text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"),
                         likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
