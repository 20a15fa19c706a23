"""Rankings, top-k, budgets and means over views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    """Rank from 1 within groups; the order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], k: int, *order, name: str = "rank") -> DataFrame:
    """The first k of each group (k below 0: all)."""
    out = ranked(df, by, *order, name=name)
    return out if k < 0 else out.where(F.col(name) <= k)


def spread(df: DataFrame, by: list[str], order: list, *sums: str) -> DataFrame:
    """The rows with ``position`` (from 1) and running sums ``running_<column>`` within
    groups, for groups that may hold most of the rows.

    Rows are sorted in ranges, so that a large group lies in several tasks; the totals of
    the ranges before are added to what is counted inside each. The order must be total."""
    from ..scratch import Scratch

    laid = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    laid = Scratch(df.sparkSession, "spread").keep(laid, "laid")
    ranges = laid.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    # A row for each range of a group, however many rows it has.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select(*by, "_part", "_first", total("_n").alias("_b"), *[total(f"_s{i}").alias(f"_b{i}") for i in range(len(sums))])
    same = F.lit(True)
    for c in by:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = laid.alias("l").join(ranges.alias("r"), same & (F.col("l._part") == F.col("r._part"))).select("l.*", *[f"r.{c}" for c in ranges.columns if c not in (*by, "_part")])
    out = out.withColumn("position", F.col("_at") - F.col("_first") + 1 + F.col("_b"))
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for i, c in enumerate(sums):
        out = out.withColumn(f"running_{c}", F.sum(c).over(inside) + F.col(f"_b{i}"))
    return out.drop("_at", "_part", "_first", "_b", *[f"_b{i}" for i in range(len(sums))])


def budget_prefix_spread(df: DataFrame, by: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """``budget_prefix`` for groups that may hold most of the rows."""
    rows = spread(df.withColumn("_cost", F.col(tokens) + 1), by, order, "_cost")
    return rows.withColumnRenamed("running__cost", "running").drop("_cost", "position").where((F.col("running") <= budget) & F.lit(budget > 0))


def budget_prefix(df: DataFrame, by: list[str], order: list, tokens: str, budget: Column | int) -> DataFrame:
    """The longest prefix whose running sum of tokens + 1 stays in the budget; a
    budget of 0 or less keeps nothing. For rankings of bounded length."""
    run = F.sum(F.col(tokens) + 1).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).where((F.col("running") <= budget) & ((budget if isinstance(budget, Column) else F.lit(budget)) > 0))


def first_occurrence(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return top_k(df, by, 1, *order, name="_first").drop("_first")


def view_mean(scored: DataFrame, keys: list[str], view: str = "view", score: str = "score", raw_as_key: bool = False) -> DataFrame:
    """Mean over the views of a session: all of them with the raw text as a key,
    else only expansions, and the original where there is none."""
    original = F.col(view) == "original"
    if raw_as_key:
        return scored.groupBy(*keys).agg(F.avg(score).alias("score"))
    return scored.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~original, F.col(score))), F.max(F.when(original, F.col(score)))).alias("score"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, with an error at run time for a key that occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean")).otherwise(True)).drop("_n")


def component_mean(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean of the components that are there (NaN and null are not); 0 for none."""
    value = F.when(~F.isnan(score), F.col(score))
    return scored.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("score"))


def resolve_ids(retrieved: DataFrame, known: DataFrame, legacy: bool = False) -> DataFrame:
    """Retrieved ids mapped to known ones within a question: as they are, else with
    ``noans_`` for ``answer_`` or the other way round. ``legacy`` maps every
    ``noans_`` to ``answer_`` and tries nothing else."""
    if legacy:
        return retrieved.withColumn("resolved", F.replace("doc", F.lit("noans_"), F.lit("answer_")))
    swap = F.when(F.col("doc").startswith("noans_"), F.concat(F.lit("answer_"), F.expr("substring(doc, 7)"))).when(F.col("doc").startswith("answer_"), F.concat(F.lit("noans_"), F.expr("substring(doc, 8)")))
    options = retrieved.withColumn("option", F.explode(F.array(F.struct(F.lit(0).alias("prio"), F.col("doc").alias("resolved")), F.struct(F.lit(1).alias("prio"), swap.alias("resolved"))))).select("*", "option.*").drop("option")
    hit = options.join(known.select("question", F.col("doc").alias("resolved")).distinct(), ["question", "resolved"])
    return first_occurrence(hit, ["question", "doc"], "prio").drop("prio")
