"""Token counts without ids: pieces are counted once per distinct pre-token and joined to pre-token frequencies.

Each Arrow batch is cut into pre-tokens, as the tokenizer's own pre-tokenizer cuts; its distinct pre-tokens form a small
table whose piece counts are looked up once, and that table is joined to the batch's (document, pre-token, frequency) rows,
whose products are summed per document. The join stays inside the task: a corpus-wide table of distinct pre-tokens grows
with the corpus, and shuffling (document, pre-token) rows to it would move more than the texts themselves. A task keeps at
most `KNOWN` counts from batch to batch.

Special strings inside a text are one token each, as the library's default has it. No token is added, cut or padded.

Defined cases: null or empty text has 0 bytes and 0 tokens; rows are counted one by one, so repeated ids each keep their
own result; other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textbytes import row_groups, text_bytes

KNOWN, LIMIT = 1 << 20, 512
#: Below this, `regex` and the library class characters alike; other texts go through the library's own pre-tokenizer.
PLAIN = "԰"


class PieceCounter:
    """Counts tokens of texts with the tokenizer of a `tokenizers` JSON file."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        cutter = parts.get("pre_tokenizer") or {}
        self.byte_level = (parts.get("normalizer") is None and cutter.get("type") == "ByteLevel"
                           and not cutter.get("add_prefix_space") and cutter.get("use_regex", True))
        import public_tokenizers
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = parts.get("added_tokens") or []
        self.plain_specials = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.byte_level and max(text, default="") < PLAIN:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pre_tokens: set[str]) -> None:
        new = [p for p in pre_tokens if p not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = list(pre_tokens)
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, map(len, encoded), strict=True))

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        frequencies: list[Counter] = []
        for i, text in enumerate(texts):
            tokens: list[str] = []
            if not self.byte_level or (not self.plain_specials and self.special.search(text)):
                total[i] = len(self.tokenizer.encode(text, add_special_tokens=False))
            elif self.special and self.special.search(text):
                parts = self.special.split(text)
                total[i] = len(parts) - 1
                for part in parts:
                    tokens += self.pre_tokens(part)
            else:
                tokens = self.pre_tokens(text)
            frequencies.append(Counter(tokens))
        distinct = set().union(*frequencies)
        self.learn(distinct)
        pieces = self.known
        total += np.fromiter((sum(pieces[p] * n for p, n in f.items()) for f in frequencies), np.int64, len(texts))
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. The tokenizer's file is read on the driver; its text (a few
    MB whatever the corpus) goes to the tasks."""
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        counter = PieceCounter(shared.value)
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            n = [counter.counts(texts.slice(a, b - a).to_pylist()) for a, b in row_groups(offsets)]
            tokens = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(tokens),
                                              pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
