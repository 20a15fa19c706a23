"""Retrieval over notes and documents: one dispatch for all scorers, views by
component, retrieval with points, documents added and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sparse
from .chunks import upsert
from .dense import cosine, dot
from .notes import points
from .rank import component_mean, top_k

COMPONENTS = ("keywords", "facts", "summary", "content")


def placeholder(c: Column) -> tuple[Column, Column]:
    """The text, ``[empty]`` where it is blank, and whether it was a text."""
    valid = F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(valid, c).otherwise(F.lit("[empty]")), valid


def scores(method: str, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``(question, doc, score)`` of every document of a question's corpus.

    ``bm25`` reads ``tokens`` on both sides, ``dot`` and ``cosine`` read ``vec``; tables
    ``(question, corpus, ...)`` and ``(corpus, doc, ...)``."""
    if method == "bm25":
        post = sparse.postings(docs, "corpus", "doc", F.col("tokens"))
        stats = sparse.corpus_stats(docs, "corpus", F.col("tokens"))
        asked = questions.select("question", "corpus", F.explode("tokens").alias("term"))
        scored = sparse.scores(post, stats, sparse.term_stats(post, stats), asked)
        return sparse.full_ranking_scores(scored, docs.select("corpus", "doc").distinct(), questions.select("question", "corpus").distinct()).select("question", "doc", "score")
    if method not in ("dot", "cosine"):
        raise ValueError(f"unknown method {method}")
    pairs = questions.select("question", "corpus", F.col("vec").alias("q")).join(docs.select("corpus", "doc", "vec"), "corpus")
    measure = dot(F.col("vec"), F.col("q")) if method == "dot" else cosine(F.col("vec"), F.col("q"), 1e-9)
    return pairs.select("question", "doc", measure.alias("score"))


def separate_views(questions: DataFrame, notes: DataFrame, encode, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """``(question, doc, score)``: the mean over the components of a note of their
    similarity to the question, blank components left out, 0 where all are. Tables
    ``(question, corpus, text)`` and ``(corpus, doc, *components)``."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("text")) for c in components])).alias("c")
    parts = notes.select("corpus", "doc", stack).select("corpus", "doc", "c.*")
    valid = placeholder(F.col("text"))[1]
    asked = questions.select("question", "corpus", encode(F.col("text")).alias("q"))
    scored = asked.join(parts, "corpus").withColumn("score", F.when(valid, cosine(encode(F.col("text")), F.col("q"), 1e-9)))
    return component_mean(scored, ["question", "doc"])


def merged_mean(merged: DataFrame, content: DataFrame) -> DataFrame:
    """The mean of the scores of the merged text and of the content."""
    return merged.join(content.withColumnRenamed("score", "other"), ["question", "doc"]).select("question", "doc", ((F.col("score") + F.col("other")) / 2).alias("score"))


def points_of_hits(hits: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """``(question, memory_id, pos, point_type, point, score, rank)``: the points of the
    notes hit, which inherit the score rounded to four digits, in the order of score,
    rank of the note and position; the first ``k`` (all where k is below 1)."""
    rows = hits.select("question", "memory_id", F.round("score", 4).alias("score"), F.col("rank").alias("note_rank")).join(points(notes), "memory_id")
    return top_k(rows, ["question"], k if k > 0 else -1, F.desc("score"), "note_rank", "pos")


def add_documents(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The documents with the new ones, which replace those of their key."""
    return upsert(held, new.dropDuplicates(keys), keys)


def remove_documents(held: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The documents without those of the keys."""
    return held.join(gone.select(*keys).distinct(), keys, "left_anti")
