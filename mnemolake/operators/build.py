"""Building an index with external functions: extraction of expansions and of graph
records with gleaning rounds, and session ids that are unique across entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_of, records_in, relationship_of, strip_quotes
from .external import complete, rule_llm
from .sessions import unique_session_ids

END = "<|COMPLETE|>"


def expansions(sessions: DataFrame, prompts: dict[str, str], held: DataFrame, function: Callable = rule_llm, attempts: int = 3) -> DataFrame:
    """``(session, kind, text, error)``: one call for each distinct session and kind that
    is not held yet; an error leaves the text null. ``prompts`` maps a kind to what is put
    before the text; tables ``(session, text)`` and ``(session, kind, text)``."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("before")) for k, p in prompts.items()])).alias("k")
    asked = sessions.dropDuplicates(["session"]).select("session", "text", kinds).select(F.to_json(F.struct("session", F.col("k.kind").alias("kind"))).alias("key"), F.concat("k.before", "text").alias("prompt"))
    cache = held.select(F.to_json(F.struct("session", "kind")).alias("key"), F.col("text").alias("response"))
    made = complete(asked, "key", "prompt", cache, function, attempts=attempts)
    of = F.from_json("key", "session string, kind string")
    return made.select(of.alias("k"), F.col("response").alias("text"), "error").select("k.session", "k.kind", "text", "error")


def says_yes(c):
    """Whether an answer is yes, quotes and case aside."""
    return F.lower(strip_quotes(F.trim(c))) == "yes"


def extract(chunks: DataFrame, function: Callable = rule_llm, gleanings: int = 0, more: Callable | None = None, goes_on: Callable | None = None) -> DataFrame:
    """``(chunk_id, pos, e, r)``: entity and relationship records of chunks ``(chunk_id,
    content)``, of the first answer and of up to ``gleanings`` further ones. ``more`` gets
    content and answers so far; ``goes_on`` decides after each round but the last, by yes.
    A failed call gives no records."""
    none = chunks.select(F.col("chunk_id").alias("key"), F.lit("").alias("response")).where("false")
    rows = chunks.dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("key"), F.col("content").alias("prompt"))
    first = complete(rows, "key", "prompt", none, function).select("key", F.coalesce("response", F.lit("")).alias("text"))
    held, active = rows.join(first, "key"), None
    for step in range(gleanings):
        source = held if active is None else held.join(active, "key", "left_semi")
        asked = source.select("key", F.concat_ws("\n", "prompt", "text").alias("prompt"))
        added = complete(asked, "key", "prompt", none, more or function).select("key", F.coalesce("response", F.lit("")).alias("added"))
        held = held.join(added, "key", "left").withColumn("text", F.concat_ws("##", "text", "added")).drop("added")
        if step < gleanings - 1 and goes_on is not None:
            source = held if active is None else held.join(active, "key", "left_semi")
            answers = complete(source.select("key", F.concat_ws("\n", "prompt", "text").alias("prompt")), "key", "prompt", none, goes_on)
            active = answers.where(says_yes(F.col("response"))).select("key")
    found = held.select(F.col("key").alias("chunk_id"), F.posexplode(records_in(F.col("text"))).alias("pos", "f"))
    return found.select("chunk_id", "pos", entity_of(F.col("f")).alias("e"), relationship_of(F.col("f")).alias("r")).where("e is not null or r is not null")


def unique_ids_with_mapping(rows: DataFrame, entry: str, session: str, order: list[str], mapping: DataFrame) -> DataFrame:
    """Session ids unique within an entry, with an earlier mapping ``(session, n, unique_id)``
    used again: the n-th occurrence of an id takes the id it had, else a new one."""
    made = unique_session_ids(rows, entry, session, order)
    old = mapping.select(F.col("session").alias(session), F.col("n").alias("occurrence"), F.col("unique_id").alias("_old")).dropDuplicates([session, "occurrence"])
    shared = F.concat_ws("_", F.col(session), F.substring(F.md5(F.concat_ws("|", F.col(session), F.col("occurrence").cast("string"))), 1, 6))
    out = made.join(old, [session, "occurrence"], "left")
    return out.withColumn("unique_id", F.when(F.col("occurrence") == 1, F.col(session)).otherwise(F.coalesce("_old", shared))).drop("_old")


def mapping_of(rows: DataFrame, session: str, unique_id: str = "unique_id") -> DataFrame:
    """``(session, n, unique_id)``: the ids given in place of a session's id, each once."""
    changed = rows.where(F.col(unique_id) != F.col(session)).select(F.col(session).alias("session"), F.col("occurrence").alias("n"), F.col(unique_id).alias("unique_id"))
    return changed.distinct()


def reconstructed_mapping(before: DataFrame, after: DataFrame, entry: str, position: str, session: str) -> DataFrame:
    """``(session, n, unique_id)`` from the ids before and after, matched by entry and
    position: where they differ, numbered by their first place among a session's."""
    pairs = before.select(entry, position, F.col(session).alias("session")).join(after.select(entry, position, F.col(session).alias("unique_id")), [entry, position]).where("session <> unique_id")
    once = pairs.groupBy("session", "unique_id").agg(F.min(F.struct(entry, position)).alias("at"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("at", "unique_id")) + 1
    return once.select("session", n.alias("n"), "unique_id")
