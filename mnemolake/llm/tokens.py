"""Token counts under a public tokenizer.

The vocabulary is a file of ranks ("base64 rank" a line, byte-level BPE); its
path is a parameter, the default being the 50k byte BPE of the installed public
tokenizers. Nothing is trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once in each worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def count_tokens(items: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, tokens)`` of a table ``(id, text)``; rows with a null text are left
    out, an empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            counts = [len(x) for x in coder.encode_ordinary_batch(batch.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], ["id", "tokens"])

    kind = items.schema["id"].dataType.simpleString()
    return items.select("id", "text").mapInArrow(run, f"id {kind}, tokens long")
