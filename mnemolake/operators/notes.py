"""Memory notes: points, neighbours, point-in-time views, the decision fold."""

from __future__ import annotations

import heapq
import sys
from array import array
from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import first_occurrence, ranked, spread


def points(notes: DataFrame) -> DataFrame:
    """``(memory_id, pos, point_type, point)``: facts, summary, keywords, content in
    this order; facts and keywords cut at semicolons, blanks left out."""
    cut = lambda c, kind: F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("point_type"), x.alias("point")))
    one = lambda c, kind: F.filter(F.array(F.struct(F.lit(kind).alias("point_type"), F.trim(c).alias("point"))), lambda s: s.point != "")
    every = F.concat(cut(F.col("facts"), "fact"), one(F.coalesce("summary", F.lit("")), "summary"), cut(F.col("keywords"), "keyword"), one(F.coalesce("content", F.lit("")), "content"))
    return notes.select("memory_id", F.posexplode(every).alias("pos", "p")).select("memory_id", "pos", "p.*")


def vector_text(notes: DataFrame) -> DataFrame:
    """``(memory_id, text)``: the labelled blocks that a note is encoded from."""
    block = lambda name, c: F.concat(F.lit(f"{name}: \n"), F.coalesce(c, F.lit("")))
    return notes.select("memory_id", F.concat_ws("\n\n", block("Keywords", F.col("keywords")), block("Facts", F.col("facts")), block("Summary", F.col("summary")), block("Content", F.col("content"))).alias("text"))


def neighbour_fill(hits: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """The hits of a question and their related notes, which inherit the hit's
    score and come behind all hits; each note once, k in all."""
    own = hits.select("question", "memory_id", "score", F.lit(0).alias("depth"), "rank", F.lit(-1).alias("at"))
    related = hits.select("question", F.col("memory_id").alias("parent"), "score", "rank").join(notes.select(F.col("memory_id").alias("parent"), F.posexplode("related_memories").alias("at", "memory_id")), "parent")
    related = related.join(notes.select("memory_id").distinct(), "memory_id", "left_semi").select("question", "memory_id", "score", F.lit(1).alias("depth"), "rank", "at")
    once = first_occurrence(own.union(related), ["question", "memory_id"], "depth", "rank", "at")
    return ranked(once, ["question"], "depth", "rank", "at", "memory_id", name="fill_rank").where(F.col("fill_rank") <= k)


def as_of(questions: DataFrame, items: DataFrame, key: str, question_at: str, item_at: str) -> DataFrame:
    """Items a question may see: those of its key not later than itself."""
    return questions.join(items, key).where(F.col(item_at) <= F.col(question_at))


def operation_index(ops: DataFrame, key: str, *order) -> DataFrame:
    """Position of each operation in its key's log, from 0."""
    out = spread(ops, [key], list(order))
    return out.withColumn("op_index", F.col("position") - 1).drop("position")


class NoteStore:
    """Notes as bags of distinct words, with an index from words to notes.

    Shared words are counted over all notes at once: words of many notes are columns
    of 0 and 1, the others lists of note numbers."""

    # A word in more than one of so many notes is a column.
    COLUMN = 16

    def __init__(self, notes: dict[str, set] | None = None):
        self.notes: dict[str, tuple] = {}
        self._keys: list[str] = []
        self._at: dict[str, int] = {}
        self._sizes = np.zeros(1024, np.int32)
        self._lists: dict[str, array] = {}
        self._columns: dict[str, np.ndarray] = {}
        for key, words in (notes or {}).items():
            self.put(key, words)

    def put(self, key: str, words: set) -> None:
        """Add the words to a note."""
        held = self.notes.get(key, ())
        at = self._at.get(key)
        if at is None:
            at = self._at[key] = len(self._keys)
            self._keys.append(key)
            if at == len(self._sizes):
                self._grow()
        more = set(words).difference(held)
        self.notes[key] = (*held, *map(sys.intern, more))
        self._sizes[at] += len(more)
        for w in more:
            column = self._columns.get(w)
            if column is not None:
                column[at] = 1
                continue
            numbers = self._lists.setdefault(sys.intern(w), array("i"))
            numbers.append(at)
            if len(numbers) > 64 and len(numbers) * self.COLUMN > len(self._keys):
                column = self._columns[sys.intern(w)] = np.zeros(len(self._sizes), np.uint8)
                column[np.frombuffer(numbers, np.int32)] = 1
                del self._lists[w]

    def _grow(self) -> None:
        """Room for twice the notes; columns of words that have become rare are lists again."""
        n = len(self._sizes)
        self._sizes = np.concatenate([self._sizes, np.zeros(n, np.int32)])
        for w, column in list(self._columns.items()):
            numbers = np.flatnonzero(column).astype(np.int32)
            if len(numbers) * 2 * self.COLUMN > n:
                self._columns[w] = np.concatenate([column, np.zeros(n, np.uint8)])
            else:
                self._lists[w] = array("i", numbers.tobytes())
                del self._columns[w]

    def _shared(self, words: set) -> np.ndarray:
        """The number of words that each note shares with these."""
        n = len(self._keys)
        shared = np.zeros(n, np.uint8 if len(words) < 256 else np.int32)
        for w in words:
            if w in self._columns:
                shared += self._columns[w][:n]
            elif w in self._lists:
                shared[np.frombuffer(self._lists[w], np.int32)] += 1
        return shared

    def similar(self, words: set, least: float, most: int) -> list[tuple[float, str]]:
        """The ``most`` notes at or above a word similarity, best first, ties to the smaller key."""
        if not words or not self._keys or most < 1:
            return []
        shared = self._shared(words)

        def likeness(found: np.ndarray) -> np.ndarray:
            n = shared[found].astype(np.int64)
            return n / (len(words) + self._sizes[found] - n)

        # The notes that share most bound the similarity of the last one taken.
        high = np.bincount(shared)[::-1].cumsum()
        high = len(high) - 1 - int(np.searchsorted(high, most))
        bound = least
        if high > 0:
            bound = max(least, float(np.sort(likeness(np.flatnonzero(shared >= high)))[-most]))
        # A similarity is at most the share of the words that are in the note.
        found = np.flatnonzero(shared >= max(1, ceil(bound * len(words) - 1e-6)))
        like = likeness(found)
        taken = sorted(((s, self._keys[i]) for s, i in zip(like[like > bound].tolist(), found[like > bound].tolist())), key=lambda x: (-x[0], x[1]))[:most]
        ties = heapq.nsmallest(most - len(taken), map(self._keys.__getitem__, found[like == bound].tolist()))
        return taken + [(bound, k) for k in ties]


def overlap_decision(note: set, store: NoteStore, update_at: float = 0.6, link_at: float = 0.3):
    """The default decision: update the most similar note at or above one word
    similarity, create and link to those above another, pass on an empty note."""
    if not note:
        return "pass", None, []
    like = store.similar(note, link_at, 5)
    if like and like[0][0] >= update_at:
        return "update", like[0][1], []
    return "create", None, [k for _, k in like]


def decision_fold(notes: DataFrame, key: str, order: str, decide: Callable = overlap_decision) -> DataFrame:
    """The note store built step by step, per key in the given order.

    Columns ``memory_id`` and ``text``; yields an operation row for each note.
    Steps depend on one another, so a key is one task; keys run in parallel."""
    schema = f"`{key}` string, op_index long, memory_id string, action string, target_id string, linked array<string>, store_size long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "memory_id"])
        store = NoteStore()
        out = []
        for i, (mid, text) in enumerate(zip(pdf["memory_id"], pdf["text"])):
            words = set((text or "").lower().split())
            action, target, linked = decide(words, store)
            if action in ("create", "update"):
                store.put(mid if action == "create" else target, words)
            out.append((pdf[key].iloc[0], i, mid, action, target, linked, len(store.notes)))
        return pd.DataFrame(out, columns=[key, "op_index", "memory_id", "action", "target_id", "linked", "store_size"])

    return notes.select(key, order, "memory_id", "text").groupBy(key).applyInPandas(run, schema)


def trajectory(ops: DataFrame, action: str = "op_action") -> DataFrame:
    """Counts by action."""
    return ops.groupBy(action).agg(F.count("*").alias("n"))


def formatted(ranking: DataFrame, text: str, ts: str) -> DataFrame:
    """Numbered context lines of each question, joined in rank order."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.coalesce(ts, F.lit("")), F.lit("] "), F.coalesce(text, F.lit("")))
    return ranking.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s.line), "\n").alias("context"))
