"""Splitting oversized items at natural boundaries (problem 5).

Every gap between two tokens has a strength: paragraph end 4, line end 3,
sentence end 2, blank 1, none 0. A sparse table answers "where is the strongest
gap of this window, the rightmost of equals" in constant time. Each piece ends at
the strongest gap of the upper half of the permissible lengths; where that half
has no sentence end, of all permissible lengths. The next piece begins the
overlap's number of tokens before the cut. The tables are per text, so texts are
independent and nothing but the pieces is shuffled.

A token is a maximal run of ASCII letters and digits, or any other single
character except space, tab, CR and LF; a function from a text to token spans
may be given instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^ \t\r\n]")
# Marks that end a sentence, with or without a blank behind, and marks that may close it.
_ENDS, _ENDS_ALONE, _CLOSERS = ".!?…", "。！？｡", "\"'”’»)]」』）"
PARAGRAPH, LINE, SENTENCE, BLANK = 4, 3, 2, 1


def token_spans(text: str) -> np.ndarray:
    """Start and end of each token, an array of n rows."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return np.array(spans, np.int64).reshape(-1, 2)


def strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """Strength of the gap behind each token; behind the last it is the highest."""
    n = len(spans)
    out = np.zeros(n, np.int8)
    starts, ends = spans[:, 0].tolist(), spans[:, 1].tolist()
    for i in range(n - 1):
        a, b = ends[i], starts[i + 1]
        if a < b:
            gap = text[a:b]
            lines = gap.count("\n") or gap.count("\r")
            if lines:
                out[i] = PARAGRAPH if lines > 1 else LINE
                continue
            out[i] = BLANK
        elif text[a - 1] not in _ENDS_ALONE and text[a - 1] not in _CLOSERS:
            continue
        k = i
        while k and text[ends[k] - 1] in _CLOSERS and ends[k - 1] == starts[k]:
            k -= 1
        last = text[ends[k] - 1]
        if last in _ENDS_ALONE or last in _ENDS and a < b:
            # A closing mark may still follow.
            if not (a == b and text[b] in _CLOSERS):
                out[i] = SENTENCE
    if n:
        out[-1] = PARAGRAPH
    return out


class RangeMaximum:
    """Sparse table: index of the largest value of a range, rightmost of equals."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values))]
        width = 1
        while 2 * width <= min(longest, len(values)):
            low = self.levels[-1]
            left, right = low[:-width], low[width:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def query(self, first: int, last: int) -> int:
        k = (last - first + 1).bit_length() - 1
        a, b = self.levels[k][first], self.levels[k][last - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def cuts(gaps: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges ``[first, end)`` of the pieces."""
    n = len(gaps)
    if n <= limit:
        return [(0, n)]
    table = RangeMaximum(gaps, limit)
    pieces, at = [], 0
    while n - at > limit:
        least = max(overlap + 1, limit // 2)
        best = table.query(at + least - 1, at + limit - 1)
        if gaps[best] < SENTENCE and least > overlap + 1:
            best = table.query(at + overlap, at + limit - 1)
        pieces.append((at, best + 1))
        at = best + 1 - overlap
    return [*pieces, (at, n)]


def split_texts(items: DataFrame, limit: int = 1200, overlap: int = 100, spans: Callable[[str], np.ndarray] = token_spans) -> DataFrame:
    """``(id, piece, tokens, start, stop, content)`` of a table ``(id, text)``.

    ``piece`` counts from 0, ``start`` and ``stop`` are code points of the text:
    ``content`` is ``text[start:stop]``, and the pieces without their overlaps
    are the text again. A null text has no piece, a text of at most ``limit``
    tokens (the empty one too) is one piece, as it is. Repeated rows are split
    each."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                at = spans(text)
                whole = cuts(strengths(text, at), limit, overlap) if len(at) > limit else [(0, len(at))]
                for k, (a, b) in enumerate(whole):
                    start = 0 if a == 0 else int(at[a, 0])
                    stop = len(text) if b == len(at) else int(at[b, 0])
                    out.append((key, k, b - a, start, stop, text[start:stop]))
            cols = list(zip(*out)) or [[]] * 6
            types = (batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ["id", "piece", "tokens", "start", "stop", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return items.select("id", "text").mapInArrow(run, f"id {kind}, piece int, tokens int, start int, stop int, content string")


def split_chunks(chunks: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Pieces of text_chunks with fresh tokens and chunk_order_index.

    A chunk delivered twice counts once. The index counts the pieces of all
    chunks of a document, in the order of their old index (null last) and id; a
    chunk without document is one of its own. Only counts are windowed."""
    once = chunks.where("chunk_id is not null and content is not null").select("chunk_id", "full_doc_id", "user_uuid", "noted_at", "chunk_order_index", F.col("content").alias("text")).dropDuplicates(["chunk_id"])
    key = F.struct("chunk_id", "full_doc_id", "user_uuid", "noted_at", "chunk_order_index").alias("id")
    pieces = split_texts(once.select(F.to_json(key).alias("id"), "text"), limit, overlap)
    pieces = pieces.select(F.from_json("id", "chunk_id string, full_doc_id string, user_uuid string, noted_at string, chunk_order_index int").alias("c"), "piece", "tokens", "content").select("c.*", "piece", "tokens", "content")
    heads = pieces.where("piece = 0").select("chunk_id", F.coalesce("full_doc_id", "chunk_id").alias("doc"), F.col("chunk_order_index").alias("old"))
    several = heads.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select("doc")
    counts = pieces.groupBy("chunk_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc").orderBy(F.col("old").asc_nulls_last(), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.join(several, "doc").join(counts, "chunk_id").select("chunk_id", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("int").alias("before"))
    out = pieces.join(before, "chunk_id", "left")
    return out.select("chunk_id", "full_doc_id", "user_uuid", "noted_at", (F.col("piece") + F.coalesce("before", F.lit(0))).alias("chunk_order_index"), "piece", "tokens", "content")


def oversized(chunks: DataFrame, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """``(chunk_id)`` of the chunks that the splitter cuts."""
    items = chunks.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return split_texts(items, limit, overlap).where("piece = 1").select(F.col("id").alias("chunk_id")).distinct()
