"""Streams over operations and notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.notes import NoteStore, overlap_decision


def once(stream: DataFrame, key: str, time: str, late: str = "10 days") -> DataFrame:
    """Rows of a stream without repeats of a key inside the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def action_counts(stream: DataFrame, time: str, action: str, window: str = "1 day", late: str = "10 days") -> DataFrame:
    """Operations by window and action; a window is final once the watermark has
    passed its end."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), action).agg(F.count("*").alias("n"))


def snapshot_upsert(target: str, keys: list[str]):
    """A ``foreachBatch`` function that writes each batch as its own version, so
    that a replayed batch replaces itself; ``latest_rows`` reads the newest."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(keys).withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/version_batch={epoch}")

    return write


def complete_table(target: str):
    """A ``foreachBatch`` function that replaces a table by the complete result."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return write


def latest_rows(table: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest version of each key."""
    from ..operators.rank import first_occurrence

    return first_occurrence(table, keys, F.desc(version))


def note_stream(stream: DataFrame, key: str = "user_uuid", time: str | None = None) -> DataFrame:
    """The decision fold as a stateful stream: rows (key, memory_id, text) in, an
    operation for each out; a key's store is its state, which grows with its notes.
    Rows of one batch are taken in the order of ``time`` where it is named."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, texts = (list(x) for x in state.get) if state.exists else ([], [])
        store = NoteStore({i: set(t.split(" ")) for i, t in zip(ids, texts)})
        # What arrived together is taken in the order of its time.
        held = list(batches)
        for pdf in [pd.concat(held).sort_values([time, "memory_id"])] if held and time else held:
            out = []
            for mid, text in zip(pdf["memory_id"], pdf["text"]):
                words = set((text or "").lower().split())
                action, target, _ = overlap_decision(words, store)
                if action in ("create", "update"):
                    store.put(mid if action == "create" else target, words)
                out.append((group[0], mid, action, target))
            yield pd.DataFrame(out, columns=[key, "memory_id", "action", "target_id"])
        state.update((list(store.notes), [" ".join(sorted(w)) for w in store.notes.values()]))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, memory_id string, action string, target_id string", "ids array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
