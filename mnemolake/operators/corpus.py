"""Expansions of session texts and the corpora made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def views(sessions: DataFrame, expansions: DataFrame, keep_original: bool = True) -> DataFrame:
    """``(session, view, pos, text)``: the original and each nonblank expansion
    item, of tables ``(session, text)`` and ``(session, kind, pos, text)``."""
    extra = expansions.where("text is not null and trim(text) <> ''").select("session", F.col("kind").alias("view"), "pos", F.trim("text").alias("text"))
    if not keep_original:
        return extra
    return sessions.select("session", F.lit("original").alias("view"), F.lit(0).cast("long").alias("pos"), "text").union(extra)


def merged_view(sessions: DataFrame, expansions: DataFrame, kinds: list[str], raw: bool = False) -> DataFrame:
    """``(session, view, text)``: the expansions of a session joined by blanks, in
    the order of the kinds; ``raw`` puts the original before them in one row,
    else it keeps its own. The merged view is named after the kinds."""
    order = F.expr("case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(kinds)) + " end")
    rows = expansions.where(F.col("kind").isin(kinds) & F.col("text").isNotNull() & (F.trim("text") != ""))
    joined = rows.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "pos", F.trim("text").alias("t")))), lambda x: x.t), " ").alias("merged"))
    name = "merged-" + "-".join(kinds)
    if raw:
        return sessions.join(joined, "session", "left").select("session", F.lit(name).alias("view"), F.concat_ws(" ", "text", "merged").alias("text"))
    return sessions.select("session", F.lit("original").alias("view"), "text").union(joined.select("session", F.lit(name), "merged"))


def value_expansion(ranking: DataFrame, expansions: DataFrame) -> DataFrame:
    """Each ranked session followed by its expansion items, ranked again."""
    from .rank import ranked

    own = ranking.select("question", "session", "rank", F.lit(0).alias("is_expansion"), F.lit("original").alias("kind"), F.lit(0).cast("long").alias("pos"))
    items = ranking.select("question", "session", "rank").join(expansions.where("text is not null and trim(text) <> ''").select("session", "kind", "pos"), "session").select("question", "session", "rank", F.lit(1).alias("is_expansion"), "kind", "pos")
    return ranked(own.union(items), ["question"], "rank", "is_expansion", "kind", "pos", name="item_rank")


def label_map(items: DataFrame) -> DataFrame:
    """``(session, label, text)``: the distinct values of a label, in order."""
    first = items.groupBy("session", "label", "text").agg(F.min("pos").alias("pos"))
    return first.groupBy("session", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), " ").alias("text"))
