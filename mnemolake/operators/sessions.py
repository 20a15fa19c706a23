"""Dialogue sessions: turns, rendered texts and the predicates on them.

A turn is a struct (ts, role, content); a session a row with an array of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalised


def parse_turns(c: Column, between: str = "\n\n") -> Column:
    """Turns of a text of ``role: content`` parts, a ``[time]`` allowed before."""
    parts = F.filter(F.split(c, between), lambda p: p.rlike(r"^(?:\[[^\]]*\])?\w+: "))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(?:\[([^\]]*)\])?(\w+): ", 1).alias("ts"),
            F.regexp_extract(p, r"^(?:\[([^\]]*)\])?(\w+): ", 2).alias("role"),
            F.regexp_replace(p, r"^(?:\[[^\]]*\])?\w+: ", "").alias("content"),
        ),
    )


def user_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: t.role == "user")


def user_text(turns: Column) -> Column:
    """The user's contents with one blank between."""
    return F.array_join(F.transform(user_turns(turns), lambda t: t.content), " ")


def user_lines(turns: Column) -> Column:
    """The user's contents, each with a line break behind."""
    return F.array_join(F.transform(user_turns(turns), lambda t: F.concat(t.content, F.lit("\n"))), "")


def graph_lines(turns: Column) -> Column:
    """``time role: content`` and a line break for each turn, time directly before role."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t.ts, t.role, F.lit(": "), t.content, F.lit("\n"))), "")


def titled(turns: Column, user: Column | None = None) -> Column:
    """``Role: text`` parts with a blank line between; the user's name may stand for the role."""
    name = lambda t: capitalised(t.role) if user is None else F.when(t.role == "user", user).otherwise(capitalised(t.role))
    return F.array_join(F.transform(turns, lambda t: F.concat(name(t), F.lit(": "), t.content)), "\n\n")


def judge_lines(turns: Column) -> Column:
    """``[time]role: content`` lines, an empty line after each assistant's."""
    line = lambda t: F.concat(F.lit("["), t.ts, F.lit("]"), t.role, F.lit(": "), t.content, F.when(t.role == "assistant", "\n").otherwise(""))
    return F.array_join(F.transform(turns, line), "\n")


def has_answer(turns: Column, flag) -> Column:
    """Whether any user turn carries the answer flag (a function of the turn)."""
    return F.exists(user_turns(turns), flag)


def renamed_non_answer(session_id: Column, turns: Column, flag) -> Column:
    """``answer`` becomes ``noans`` in ids whose user turns all lack the flag; that
    includes sessions without any user turn."""
    return F.when(session_id.contains("answer") & ~has_answer(turns, flag), F.replace(session_id, F.lit("answer"), F.lit("noans"))).otherwise(session_id)


def is_gold(session_id: Column, turns: Column, flag) -> Column:
    """Gold sessions: id with ``answer`` and the flag on a turn of any role."""
    return session_id.contains("answer") & F.exists(turns, flag)


def is_abstention(question_id: Column) -> Column:
    return question_id.contains("_abs")


def not_generated(flag: Column) -> Column:
    """Sessions that are not generated question sessions."""
    return ~F.coalesce(flag, F.lit(False))


def duplicate_report(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, n_rows, n_contents)`` of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5(content)).alias("n_contents")).where("n_rows > 1")


def unique_session_ids(rows: DataFrame, entry: str, session: str, order: list[str]) -> DataFrame:
    """Session ids unique within an entry: the first keeps its id, the n-th gets a
    suffix from a hash of entry, id and n, so that repeated runs agree."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(entry, session).orderBy(*order))
    suffix = F.substring(F.md5(F.concat_ws("|", entry, session, n.cast("string"))), 1, 6)
    return rows.withColumn("occurrence", n).withColumn("unique_id", F.when(n == 1, F.col(session)).otherwise(F.concat_ws("_", session, suffix)))


def extracted_memory_text(summary: Column, keywords: Column, facts: Column) -> Column:
    """Summary, keywords, facts in this order, blanks removed."""
    return F.filter(F.array(summary, keywords, facts), lambda x: x.isNotNull() & (F.trim(x) != ""))


def session_action(rows: DataFrame, session: str, action: str) -> DataFrame:
    """One action a session: created before updated before no_action."""
    rank = F.when(F.col(action) == "created", 0).when(F.col(action) == "updated", 1).otherwise(2)
    return rows.groupBy(session).agg(F.element_at(F.array(F.lit("created"), F.lit("updated"), F.lit("no_action")), F.min(rank) + 1).alias("session_action"))


def note_sentences(c: Column) -> Column:
    """Sentences of a note, split at dot and blank, each with its dot."""
    parts = F.split(c, r"\. ")
    return F.transform(parts, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))
