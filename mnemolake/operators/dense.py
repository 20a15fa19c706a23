"""Vector arithmetic and exact search.

Searches are a stated query set against all rows: the vectors are compared block
by block in Arrow batches with the query matrix, which is broadcast only up to
``MAX_QUERY_VALUES`` numbers; beyond, both sides are cut into blocks and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_k

MAX_QUERY_VALUES = 8_000_000
VECTORS_OF_PART = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Dot product over norms; epsilon is added to the denominator."""
    of = lambda p: dot(p.a, p.b) / (norm(p.a) * norm(p.b) + epsilon)
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of)[0]


def masked_mean(parts: DataFrame, key: str, vec: str, valid: str, position: str) -> DataFrame:
    """Mean of the valid component vectors of a key, scaled to length 1; the first
    component's vector where none is valid. Computed per dimension."""
    usable = parts.select(key, position, valid, F.posexplode(vec).alias("dim", "x"))
    first = F.min_by("x", position)
    mean = usable.groupBy(key, "dim").agg(F.coalesce(F.avg(F.when(F.col(valid), F.col("x").cast("double"))), first.cast("double")).alias("x"))
    made = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("vec"))
    length = norm(F.col("vec"))
    return made.withColumn("vec", F.when(length > 0, F.transform("vec", lambda x: x / length)).otherwise(F.col("vec")))


def _matrix(col: pa.Array, metric: str) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def _best(names: pa.Array, q: np.ndarray, keys: pa.Array, x: np.ndarray, k: int, threshold: float | None, exclude_self: bool) -> pa.RecordBatch:
    """The k best of ``x`` for each query, and all that tie with the k-th."""
    m = q @ x.T
    if exclude_self:
        at = pc.index_in(keys, names)
        same = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        m[at.fill_null(0).to_numpy(zero_copy_only=False)[same], same] = -np.inf
    if threshold is not None:
        m[m < threshold] = -np.inf
    kth = np.partition(m, max(0, m.shape[1] - k), axis=1)[:, max(0, m.shape[1] - k)]
    r, c = np.nonzero((m >= kth[:, None]) & np.isfinite(m))
    return pa.RecordBatch.from_arrays([names.take(pa.array(r)), keys.take(pa.array(c)), pa.array(m[r, c])], ["query", "id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """``(query, id, score, rank)`` of tables ``(id, vec)``: exact top k by dot
    product or cosine, scores at or above the threshold, ties to the smaller id.

    Up to ``MAX_QUERY_VALUES`` numbers the queries are broadcast, and each batch of
    vectors sends at most k candidates a query on. More queries are cut into blocks of
    that size; blocks of queries meet parts of the vectors in the cells of a grid."""
    spark = vectors.sparkSession
    dim = (queries.select(F.size("vec").alias("d")).first() or [0])[0]
    count = queries.count()
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"query {kind}, id {kind}, score double"
    blocks = -(-count * max(1, dim) // MAX_QUERY_VALUES)
    if blocks > 1:
        return top_k(_in_cells(vectors, queries, blocks, k, metric, threshold, exclude_self, schema), ["query"], k, F.desc(F.round("score", 9)), "id")
    held = queries.select("id", "vec").toArrow().combine_chunks() if count else None
    if held is None:
        return top_k(vectors.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0), ["query"], k, F.desc("score"), "id")
    names = held.column("id").combine_chunks()
    shared = spark.sparkContext.broadcast((names, _matrix(held.column("vec").combine_chunks(), metric)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _best(own, q, batch.column("id"), _matrix(batch.column("vec"), metric), k, threshold, exclude_self)

    return top_k(vectors.select("id", "vec").mapInArrow(score, schema), ["query"], k, F.desc(F.round("score", 9)), "id")


def _in_cells(vectors: DataFrame, queries: DataFrame, blocks: int, k: int, metric: str, threshold: float | None, exclude_self: bool, schema: str) -> DataFrame:
    parts = max(1, -(-vectors.count() // VECTORS_OF_PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    ask = queries.select("id", "vec", own(blocks).alias("block"), every(parts).alias("part"), F.lit(True).alias("asks"))
    filed = vectors.select("id", "vec", every(blocks).alias("block"), own(parts).alias("part"), F.lit(False).alias("asks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cell = table.column("block").to_numpy().astype(np.int64) << 32 | table.column("part").to_numpy()
        asks = table.column("asks").to_numpy()
        for c in np.unique(cell):
            q, x = (table.take(pa.array(np.flatnonzero((cell == c) & flag))) for flag in (asks, ~asks))
            if not len(q) or not len(x):
                continue
            names, keys = q.column("id").combine_chunks(), x.column("id").combine_chunks()
            yield _best(names, _matrix(q.column("vec").combine_chunks(), metric), keys, _matrix(x.column("vec").combine_chunks(), metric), k, threshold, exclude_self)

    return filed.union(ask).repartition(blocks * parts, "block", "part").mapInArrow(meet, schema)
