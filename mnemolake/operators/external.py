"""External functions: encoders and language models, with a cache in front.

A cache hit must not reach the function. Catalyst runs a Python function for
every row whatever condition surrounds it, so hits and misses are two branches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in: counts of words in md5 buckets, scaled to length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def hex_vector(text):
    """A 16-dimensional word-hash vector made of built-in functions only."""
    digits = F.array_join(F.transform(words(text), lambda w: F.substring(F.md5(w), 1, 1)), "")
    # Bound to a name by the outer transform, so that it is worked out once.
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.length(s) - F.length(F.replace(s, F.lower(F.hex(i)), F.lit("")))).cast("double"))
    return F.transform(F.array(digits), counts)[0]


def encode(rows: DataFrame, text: str, encoder: Encoder, name: str = "vec") -> DataFrame:
    """Rows with a vector of the text, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode(s.fillna("").tolist()).astype(np.float32)), index=s.index)

    return rows.withColumn(name, run(F.col(text)))


def rule_llm(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a completion: the longest words of the prompt."""
    return ["; ".join(sorted(set(re.findall(r"[^\W\d_]{5,}", p.lower())), key=lambda w: (-len(w), w))[:3]) for p in prompts]


def _alone(function: Callable[[list[str]], list[str]], prompt: str, attempts: int) -> tuple[str | None, str | None]:
    """Response and error of one prompt."""
    error = None
    for _ in range(max(1, attempts)):
        try:
            return function([prompt])[0], None
        except Exception as e:  # noqa: BLE001
            error = str(e)[:200]
    return None, error


def complete(rows: DataFrame, key: str, prompt: str, cache: DataFrame, function: Callable[[list[str]], list[str]] = rule_llm, partitions: int | None = None, attempts: int = 1) -> DataFrame:
    """``(key, response, cached, error)`` of the distinct prompts: cached ones as
    stored in ``cache (key, response)``, the others by the function, at most
    ``partitions`` calls at a time. Where a batch fails its prompts are tried one by one,
    ``attempts`` times each; a failure is an error column, not a text."""
    distinct = rows.select(key, prompt).dropDuplicates([key])
    stored = cache.select(key, "response").dropDuplicates([key])
    hits = distinct.join(stored, key).select(key, "response", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    todo = distinct.join(stored, key, "left_anti")
    if partitions:
        todo = todo.repartition(partitions, key)

    @F.pandas_udf("response string, error string")
    def call(s: pd.Series) -> pd.DataFrame:
        prompts = s.fillna("").tolist()
        try:
            return pd.DataFrame({"response": function(prompts), "error": None}, index=s.index)
        except Exception:  # noqa: BLE001
            return pd.DataFrame([_alone(function, p, attempts) for p in prompts], columns=["response", "error"], index=s.index)

    made = todo.withColumn("r", call(F.col(prompt))).select(key, "r.response", F.lit(False).alias("cached"), "r.error")
    return hits.unionByName(made)
