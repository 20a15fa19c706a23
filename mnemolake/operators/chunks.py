"""Fixed token windows, separator chunks and chunk upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import first_occurrence


def token_windows(docs: DataFrame, key: str, tokens, size: int, overlap: int) -> DataFrame:
    """``(key, chunk_order_index, tokens, content)``: windows of ``size`` tokens that
    start every ``size - overlap``; the last may be the overlap alone."""
    step = size - overlap
    rows = docs.select(F.col(key), tokens.alias("_t")).where(F.size("_t") > 0)
    starts = rows.select(key, "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(step))).alias("chunk_order_index", "_s"))
    part = F.slice("_t", F.col("_s") + 1, size)
    return starts.select(key, "chunk_order_index", F.size(part).alias("tokens"), F.trim(F.array_join(part, " ")).alias("content"))


def split_by_separators(words: list[str], separators: set[str], size: int, overlap: int, legacy: bool = False) -> list[list[str]]:
    """Token lists: cut behind separators, pieces merged up to the size, a piece
    beyond the size cut hard. ``legacy`` puts the overlap before a chunk and then
    cuts it to the size, which loses tokens; otherwise room is left for it."""
    pieces, piece = [], []
    for w in words:
        piece.append(w)
        if w in separators or w[-1:] in separators:
            pieces.append(piece)
            piece = []
    if piece:
        pieces.append(piece)
    room = size if legacy else max(1, size - overlap)
    chunks: list[list[str]] = []
    for p in pieces:
        for part in [p[i : i + room] for i in range(0, len(p), room)]:
            if chunks and len(chunks[-1]) + len(part) <= room:
                chunks[-1] = chunks[-1] + part
            else:
                chunks.append(part)
    if overlap <= 0:
        return chunks
    out: list[list[str]] = []
    for i, c in enumerate(chunks):
        # The tail of what came out continues over chunks shorter than the overlap.
        before = [] if i == 0 else (chunks[i - 1] if legacy else out[-1])[-overlap:]
        out.append((before + c)[:size])
    return out


def separator_chunks(docs: DataFrame, key: str, text: str, separators: list[str], size: int, overlap: int, legacy: bool = False) -> DataFrame:
    """``(key, chunk_order_index, tokens, content)`` over whitespace tokens."""
    marks = set(separators)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(split_by_separators((t or "").split(), marks, size, overlap, legacy)):
                    out.append((k, i, len(c), " ".join(c)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()))], [key, "chunk_order_index", "tokens", "content"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_order_index int, tokens int, content string")


def keyed_chunks(chunks: DataFrame, order: str) -> DataFrame:
    """One row a content: id ``chunk-`` and md5; of equal contents the last wins."""
    return first_occurrence(chunks.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content"))), ["chunk_id"], F.desc(order))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` in place of ``existing`` ones with the key."""
    return existing.join(new, keys, "left_anti").unionByName(new)


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet (resume, idempotent ingest)."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")
