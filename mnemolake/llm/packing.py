"""Filling fixed-capacity containers with items (problem 7).

Shortest-pack-first over the length histogram. Only the histogram (at most
``capacity`` rows) reaches the driver. Lengths are placed from the longest to the
shortest; a length goes into the packs with the most room, as many at a time as
there are packs of one pattern or items of the length, else into new packs; packs
whose room is just the length come first, which leaves less unused. The
result are patterns with counts, so the work depends on the capacity, not on the
number of items. Each length then has an ordered list of slots, and items find
theirs by their rank within the length.

Ranks are taken in buckets of a length with the buckets' offsets added, as many as
keep a bucket near ``BUCKET_ROWS`` items, so that no length is ever sorted in one task. The slot table has at most 3 capacity
patterns (a length starts two and splits one), which bounds the broadcast.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

BUCKET_ROWS = 200_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, number of packs)`` that hold all items."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    heap: list[int] = []

    def put(left: int, pattern: tuple[int, ...], packs: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(heap, -left)
        room[left].append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        items = histogram[length]
        while items:
            while heap and -heap[0] not in room:
                heapq.heappop(heap)
            if not heap or -heap[0] < length:
                # A new pack is the shortest, so the next items of the length follow into it.
                each = capacity // length
                for n, packs in ((each, items // each), (items % each, 1)):
                    if n and packs:
                        put(capacity - n * length, (length,) * n, packs)
                break
            left = length if length in room else -heap[0]
            pattern, packs = room[left].pop()
            if not room[left]:
                del room[left]
            used = min(packs, items)
            if packs > used:
                put(left, pattern, packs - used)
            put(left - length, (*pattern, length), used)
            items -= used
    return [entry for left in sorted(room) for entry in room[left]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of its slot runs, the first container of each run
    and the position inside the container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    base = 0
    for lengths, packs in patterns:
        for position, length in enumerate(lengths):
            runs.setdefault(length, []).append((filled[length], base, position))
            filled[length] += packs
        base += packs
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pieces(counted: DataFrame, capacity: int) -> DataFrame:
    """``(id, piece, start, tokens)``: an item beyond the capacity is cut into
    full pieces and a rest, every other is one piece; items without tokens or id
    have none, repeated ids count once."""
    whole = counted.where(F.col("id").isNotNull() & (F.col("tokens") > 0)).groupBy("id").agg(F.max("tokens").alias("n"))
    last = F.floor((F.col("n") - 1) / F.lit(capacity))
    rows = whole.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("tokens"))


def pack(counted: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(container, position, id, piece, start, tokens)`` for a table
    ``(id, tokens)``: every token of every item lies in one container, no
    container holds more than ``capacity`` tokens, and only items beyond the
    capacity are cut. An empty table gives an empty one."""
    spark = counted.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.keep(pieces(counted, capacity), "pieces")
    histogram = {r["tokens"]: r["n"] for r in cut.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    buckets = spark.createDataFrame([(n, -(-items // BUCKET_ROWS)) for n, items in histogram.items()], "tokens long, buckets long")
    cut = cut.join(F.broadcast(buckets), "tokens").withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.col("buckets"))).drop("buckets")
    sizes = cut.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    table = spark.sparkContext.broadcast(slots(pack_histogram(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "piece")) - 1
    ranked = cut.withColumn("inside", inside).join(offsets, ["tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "rank"))
            container, position = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                first, base, where = table.value[int(value)]
                run = np.searchsorted(first, rank[mine], "right") - 1
                container[mine] = base[run] + rank[mine] - first[run]
                position[mine] = where[run]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(position.astype(np.int32)), batch.column("id"), batch.column("piece"), batch.column("start"), batch.column("tokens")], ["container", "position", "id", "piece", "start", "tokens"])

    kind = counted.schema["id"].dataType.simpleString()
    return ranked.select("id", "piece", "start", "tokens", "rank").mapInArrow(place, f"container long, position int, id {kind}, piece long, start long, tokens long")


def report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items, tokens and the share of unused space."""
    total = packed.agg(F.max("container").alias("m"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    containers = F.coalesce(F.col("m") + 1, F.lit(0))
    return total.select(containers.alias("containers"), "pieces", "tokens", (1 - F.col("tokens") / (containers * capacity)).alias("unused"))
