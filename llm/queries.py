"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.chat import CHAT_SQL, op12_chat
from llm.common import docs_of
from llm.merkle import op13_merkle
from llm.negatives import NEGATIVES_SQL, op11_hard_negatives
from llm.twins import MERKLE_SQL, NEAR_SQL, OVERLAP_SQL, SUFFIX_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark, folder):
    from llm.suffix_dedup import remove_repeats
    return remove_repeats(docs_of(spark, folder), digest=True)


@query
def op10_decontamination(spark, folder):
    from llm.decontaminate import report
    return report(docs_of(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")).drop("kept_text")


@query
def op9_near_dedup(spark, folder):
    from llm.setsketch import classes
    return classes(docs_of(spark, folder), threshold=0.85)


@query
def op5_token_counts(spark, folder):
    from llm.token_counts import count_tokens
    return count_tokens(docs_of(spark, folder))


@query
def op8_language_id(spark, folder):
    from llm.language import identify
    return identify(docs_of(spark, folder))


@query
def op3_toxicity(spark, folder):
    from llm.toxicity import score
    return score(docs_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query
def op2_quality(spark, folder):
    from llm.quality import score
    return score(docs_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query
def op7_pii(spark, folder):
    from llm.pii import report
    return report(docs_of(spark, folder))


@query
def op4_simhash(spark, folder):
    from llm.simhash import edited_likeness
    return edited_likeness(docs_of(spark, folder))


@query
def op6_sentencepiece(spark, folder):
    from llm.sentencepieces import encode
    return encode(docs_of(spark, folder)).drop("ids")


query(op11_hard_negatives)
query(op12_chat)
query(op13_merkle)
ORACLES["op11_hard_negatives"] = NEGATIVES_SQL
ORACLES["op12_chat"] = CHAT_SQL
ORACLES["op13_merkle"] = MERKLE_SQL
ORACLES["op1_suffix_dedup"] = SUFFIX_SQL
ORACLES["op9_near_dedup"] = NEAR_SQL
ORACLES["op10_decontamination"] = OVERLAP_SQL
