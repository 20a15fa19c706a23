"""Prompt texts from retrieved context, and judge prompts by question type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_words
from .rank import top_k

# Our own short templates; ``type`` picks one, abstention questions have theirs.
JUDGE_TEMPLATES = {
    "fact": "Does the reply contain the expected answer? Reply yes or no.",
    "temporal": "Does the reply contain the expected answer? Being off by one day, week or month is no error. Reply yes or no.",
    "update": "Does the reply give the latest value, earlier ones aside? Reply yes or no.",
    "preference": "Does the reply respect the preference described? Reply yes or no.",
    "abstention": "Does the reply say that the question can't be answered? Reply yes or no.",
}
TEMPLATE_OF = {
    "single-session-user": "fact",
    "single-session-assistant": "fact",
    "multi-session": "fact",
    "temporal-reasoning": "temporal",
    "knowledge-update": "update",
    "single-session-preference": "preference",
}


def judge_prompt(kind: Column, abstains: Column, question: Column, answer: Column, reply: Column) -> Column:
    """The judge's prompt; an unknown type is an error."""
    chosen = F.when(abstains, F.lit(JUDGE_TEMPLATES["abstention"]))
    for name, template in TEMPLATE_OF.items():
        chosen = chosen.when(kind == name, F.lit(JUDGE_TEMPLATES[template]))
    chosen = chosen.otherwise(F.raise_error(F.concat(F.lit("unknown question type "), kind)).cast("string"))
    return F.concat_ws("\n", chosen, F.concat(F.lit("Question: "), question), F.concat(F.lit("Expected: "), answer), F.concat(F.lit("Reply: "), reply))


def context(items: DataFrame, k: int, original: bool = False, user_only: bool = False, merge: str = "none") -> DataFrame:
    """``(question, context)``: the first k items of a ranking (the last k for the
    original order), sorted by time again, as numbered parts.

    Items (question, rank, ts, role, text, expansion); ``merge`` puts expansions
    before the text, in its place, or leaves them out."""
    if user_only:
        items = items.where("role = 'user'")
    body = {"none": F.col("text"), "merge": F.concat_ws("\n", "expansion", "text"), "replace": F.coalesce("expansion", "text")}[merge]
    # The k items are picked before anything is gathered.
    kept = top_k(items, ["question"], k, F.desc("rank") if original else F.asc("rank"), name="_pick")
    grouped = kept.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ts", F.lit("")).alias("ts"), "rank", body.alias("body")))).alias("by_time"))
    part = F.transform("by_time", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x.ts, F.lit("\n"), x.body))
    return grouped.select("question", F.array_join(part, "\n\n").alias("context"))


def answer_prompt(question: Column, context_: Column, limit: int, cut=first_words) -> Column:
    """Context, cut to so many tokens by ``cut(column, limit)``, then the question."""
    return F.concat(F.lit("Context:\n"), cut(context_, limit), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
