"""Tokenizers for budgets and windows: words, or a public byte-level vocabulary.

A tokenizer has ``encode(text) -> list`` and ``decode(tokens) -> text``. Texts go to it
in Arrow batches; its file, if any, is read once in each worker.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


BLANKS = " \t\n\r\f"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class Words:
    """Words with the blanks before them (blank, tab, line ends); decoding gives the text again."""

    def encode(self, text: str) -> list:
        return re.findall(r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+$", text)

    def decode(self, tokens: list) -> str:
        return "".join(tokens)


class BytePairs:
    """A vocabulary file of "base64 rank" lines; loaded where it is used."""

    def __init__(self, path: str):
        self.path, self._coder = path, None

    def __getstate__(self):
        return {"path": self.path, "_coder": None}

    def _loaded(self):
        if self._coder is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._coder

    def encode(self, text: str) -> list:
        return self._loaded().encode_ordinary(text)

    def decode(self, tokens: list) -> str:
        return self._loaded().decode(tokens)


def count_tokens(c: Column, tokenizer: Tokenizer) -> Column:
    """Tokens of a text; null for null."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(tokenizer.encode(t)), na_action="ignore").astype("Int64")

    return run(c)


def first_tokens(tokenizer: Tokenizer) -> Callable[[Column, int], Column]:
    """A function that cuts a text to its first n tokens, for budgets of prompts."""

    def cut(c: Column, n: int) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: tokenizer.decode(tokenizer.encode(t)[:n]), na_action="ignore")

        return run(c)

    return cut


def windows(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer, size: int = 1200, overlap: int = 100) -> DataFrame:
    """``(key, chunk_order_index, tokens, content)``: windows of ``size`` tokens that start
    every ``size - overlap``; the last may be the overlap alone. Contents are trimmed; null
    and empty texts have none."""
    kind, step = docs.schema[key].dataType.simpleString(), size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = tokenizer.encode(t) if t else []
                for i, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + size]
                    out.append((k, i, len(part), tokenizer.decode(part).strip(BLANKS)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()))], [key, "chunk_order_index", "tokens", "content"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_order_index int, tokens int, content string")
