"""Retrieval metrics and judge score aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (5, 10, 20, 30)


def safe_div(a: Column, b: Column) -> Column:
    """The quotient, 0 for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def retrieval_metrics(ranking: DataFrame, gold: DataFrame, questions: DataFrame, ks=KS) -> DataFrame:
    """``(question, k, recall_any, recall_all, ndcg)`` from ``(question, doc, rank)``
    and ``(question, doc)`` of gold. With no gold: any 0, all 1, ndcg 0. The first
    two ranks are undiscounted, rank i from 2 on by log2(i)."""
    gold = gold.select("question", "doc").distinct()
    n_gold = gold.groupBy("question").agg(F.count("*").alias("n_gold"))
    hits = ranking.select("question", "doc", "rank").join(gold, ["question", "doc"]).where(F.col("rank") <= max(ks))
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    gain = F.when(F.col("rank") <= 1, 1.0).otherwise(1 / F.log2(F.greatest(F.col("rank"), F.lit(2))))
    per = hits.select("question", "rank", gain.alias("gain"), grid).where(F.col("rank") <= F.col("k")).groupBy("question", "k").agg(F.count("*").alias("found"), F.sum("gain").alias("dcg"))
    every = questions.select("question", grid).join(n_gold, "question", "left").join(per, ["question", "k"], "left").na.fill(0, ["n_gold", "found"]).na.fill(0.0, ["dcg"])
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", "n_gold").cast("int"))), F.lit(0.0), lambda s, i: s + F.when(i <= 1, 1.0).otherwise(1 / F.log2(F.greatest(i, F.lit(2)))))
    ideal = F.when(F.col("n_gold") > 0, best).otherwise(0.0)
    return every.select("question", "k", (F.col("found") > 0).cast("int").alias("recall_any"), (F.col("found") >= F.col("n_gold")).cast("int").alias("recall_all"), safe_div(F.col("dcg"), ideal).alias("ndcg"))


def turn_to_session_rank(ranking: DataFrame) -> DataFrame:
    """Rank of sessions in a ranking of turns: their order of first appearance."""
    from pyspark.sql import Window

    from ..functions.text import strip_turn

    first = ranking.withColumn("session", strip_turn(F.col("doc"))).groupBy("question", "session").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("first")))


def metrics_by_group(metrics: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Macro means overall and by a group of the questions, with sample counts."""
    rows = metrics.join(groups.select("question", F.coalesce(group, F.lit("none")).alias("g")), "question")
    out = rows.groupingSets([["k"], ["k", "g"]], "k", "g").agg(F.avg("recall_any").alias("recall_any"), F.avg("recall_all").alias("recall_all"), F.avg("ndcg").alias("ndcg"), F.count("*").alias("n"))
    return out.select(F.coalesce("g", F.lit("all")).alias("group_name"), "k", "recall_any", "recall_all", "ndcg", "n")


def route(points: DataFrame) -> DataFrame:
    """Judge bucket of memory points: ``update`` only for the string "True" and
    memories of the system, else ``integrity``; interference is its own."""
    updated = (F.col("is_update") == "True") & (F.coalesce(F.size("memories_from_system"), F.lit(0)) > 0)
    return points.withColumn("bucket", F.when(updated, "update").otherwise("integrity")).withColumn("interference", F.coalesce(F.col("memory_source") == "interference", F.lit(False)))


def integrity(records: DataFrame) -> DataFrame:
    """Recall over all and valid records, importance-weighted recall (half of the
    score), accuracy on interference. Records (score, importance, interference)."""
    own, valid = ~F.col("interference"), ~F.col("interference") & F.col("score").isNotNull()
    full = F.sum((own & (F.col("score") == 2)).cast("int"))
    weight = F.sum(F.when(own, F.col("importance")))
    valid_weight = F.sum(F.when(valid, F.col("importance")))
    credit = F.sum(F.when(valid, F.col("importance") * 0.5 * F.col("score")))
    wrong, right = F.sum(F.col("interference").cast("int")), F.sum((F.col("interference") & (F.col("score") == 0)).cast("int"))
    return records.agg(
        F.sum(own.cast("int")).alias("total"), F.sum(valid.cast("int")).alias("valid"),
        safe_div(full, F.sum(own.cast("int"))).alias("recall_all"), safe_div(full, F.sum(valid.cast("int"))).alias("recall_valid"),
        safe_div(credit, weight).alias("weighted_all"), safe_div(credit, valid_weight).alias("weighted_valid"),
        safe_div(right, wrong).alias("interference_accuracy"),
    )


def accuracy(records: DataFrame) -> DataFrame:
    """Accuracy of target records (flag "true" or "True") over all and valid, and
    half-score weighted over all records."""
    target = F.col("is_target").isin("true", "True")
    n, valid = F.sum(target.cast("int")), F.sum((target & F.col("score").isNotNull()).cast("int"))
    full = F.sum((target & (F.col("score") == 2)).cast("int"))
    credit = F.sum(F.when(target, 0.5 * F.col("score")))
    return records.agg(n.alias("target"), valid.alias("valid"), safe_div(full, n).alias("accuracy_all"), safe_div(full, valid).alias("accuracy_valid"), safe_div(credit, n).alias("weighted_all"), safe_div(credit, valid).alias("weighted_valid"))


def label_ratios(records: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Count and ratio of each label over all records and over the labelled ones."""
    total, valid = F.count("*"), F.count(label)
    cols = [total.alias("total"), valid.alias("valid")]
    for x in labels:
        n = F.sum((F.coalesce(F.col(label) == x, F.lit(False))).cast("int"))
        cols += [safe_div(n, total).alias(f"{x.lower()}_all"), safe_div(n, valid).alias(f"{x.lower()}_valid")]
    return records.agg(*cols)


def type_accuracy(integrity_records: DataFrame, update_records: DataFrame) -> DataFrame:
    """By memory type: total of both kinds, shares of full integrity scores and of
    correct updates, and their sum. A null score is no success."""
    a = integrity_records.select("memory_type", (F.coalesce(F.col("score") == 2, F.lit(False))).cast("int").alias("i"), F.lit(0).alias("u"))
    b = update_records.select("memory_type", F.lit(0).alias("i"), (F.coalesce(F.col("label") == "Correct", F.lit(False))).cast("int").alias("u"))
    out = a.union(b).groupBy("memory_type").agg(F.count("*").alias("total"), F.sum("i").alias("i"), F.sum("u").alias("u"))
    return out.select("memory_type", "total", safe_div(F.col("i"), F.col("total")).alias("integrity_acc"), safe_div(F.col("u"), F.col("total")).alias("update_acc"), safe_div(F.col("i") + F.col("u"), F.col("total")).alias("memory_acc"))


def accuracy_by_type(records: DataFrame, kind: str, hit: str) -> DataFrame:
    """Mean of 0/1 by type and overall, rounded to 4 digits."""
    out = records.rollup(kind).agg(F.round(F.avg(F.col(hit).cast("double")), 4).alias("accuracy"), F.count("*").alias("n"), F.grouping(kind).alias("all_rows"))
    return out.select(F.when(F.col("all_rows") == 1, "all").otherwise(F.coalesce(kind, F.lit("none"))).alias("group_name"), "accuracy", "n")


def durations(rows: DataFrame, *columns: str) -> DataFrame:
    """Totals of milliseconds in minutes."""
    return rows.agg(*[(F.sum(c) / 60000.0).alias(c.replace("_ms", "_min")) for c in columns])


def entity_recall(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Share of distinct gold names predicted, by key; 0 where there is no gold."""
    g = gold.select(key, "name").distinct()
    hit = g.join(predicted.select(key, "name").distinct().withColumn("hit", F.lit(1)), [key, "name"], "left")
    return hit.groupBy(key).agg(safe_div(F.count("hit"), F.count("*")).alias("entity_recall"))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: ``missing`` from the left, ``extra`` in it."""
    return right.join(left, key, "left_anti").select(key, F.lit("missing").alias("side")).union(left.join(right, key, "left_anti").select(key, F.lit("extra").alias("side"))).distinct()


def memories_text(c: Column, kind: str) -> Column:
    """Extracted memories as one text: a struct or map as compact JSON, a list joined by
    semicolons, anything else as it is; null is empty."""
    made = {"object": lambda: F.to_json(c), "list": lambda: F.array_join(c, ";"), "text": lambda: c.cast("string")}[kind]()
    return F.coalesce(made, F.lit(""))


def judge_scores(points: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(point_id, score)``: memory points ``(point_id, extracted, ...)`` judged, those of
    sessions from which nothing was extracted scored 0 without a call; a failed call is null."""
    empty = F.trim(F.coalesce("extracted", F.lit(""))) == ""
    made = judge(points.where(~empty)).select("point_id", F.col("score").cast("int").alias("score"))
    return points.where(empty).select("point_id", F.lit(0).alias("score")).union(points.where(~empty).select("point_id").join(made, "point_id", "left"))


def question_keys(questions: DataFrame, session: str, position: str) -> DataFrame:
    """Questions with the key ``<session>_question<position>`` of retrieval maps."""
    return questions.withColumn("key", F.concat(F.col(session), F.lit("_question"), F.col(position).cast("string")))


def context_of_types(items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Of each question and type the first items, as many as its limit; types without a
    limit have none. Items ``(key, res_type, rank, ...)``."""
    from .rank import top_k

    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("res_type")]
    known = items.where(F.col("res_type").isin(list(limits)))
    return top_k(known, ["key", "res_type"], max(limits.values(), default=0), "rank", name="place").where(F.col("place") <= limit)


def merged_questions(questions: DataFrame, items: DataFrame, memories: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``(key, session, question, context, memories)``: questions with the contents of the
    items retrieved, by type and rank, and the memories of their session; both empty where
    there are none. Tables ``(key, session, question)``, ``(key, res_type, rank, content)``
    and ``(session, memory, pos)``."""
    got = context_of_types(items, limits).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("res_type", "rank", "content"))).alias("c"))
    held = memories.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "memory"))).alias("m"))
    out = questions.select("key", "session", "question").join(got, "key", "left").join(held, "session", "left")
    texts = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    return out.select("key", "session", "question", texts("c", lambda x: x.content).alias("context"), texts("m", lambda x: x.memory).alias("memories"))


def with_original_ids(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hits with the original session of their id, the id itself where it has none.
    Tables ``(question, doc, ...)`` and ``(doc, session)``."""
    return hits.join(mapping.select("doc", "session").dropDuplicates(["doc"]), "doc", "left").withColumn("session", F.coalesce("session", "doc"))


def joined_answers(answers: DataFrame, references: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Answers with their references, and the keys of one side only."""
    return references.join(answers.dropDuplicates([key]), key), id_difference(answers, references, key)


def ignored(questions: DataFrame, has_target: str) -> DataFrame:
    """``(reason, n)``: questions left out of retrieval metrics, by reason: those that ask
    to abstain, those without a target turn."""
    from .sessions import is_abstention

    reasons = F.array_compact(F.array(F.when(is_abstention(F.col("question")), F.lit("abstention")), F.when(~F.coalesce(has_target, F.lit(False)), F.lit("no_target"))))
    return questions.select("question", F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count_distinct("question").alias("n"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Totals of ``(prompt_tokens, completion_tokens)``, null counted as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg(total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"), F.count("*").alias("calls"))


def store_stats(operations: DataFrame, action: str = "op_action") -> DataFrame:
    """One row: operations, memories created, updates, and attempts that were passed on."""
    n = lambda v: F.count_if(F.col(action) == v)
    return operations.agg(F.count("*").alias("operations"), n("created").alias("memories"), n("updated").alias("updated"), n("no_action").alias("rejected"))
