"""Consolidating pairwise matches into groups (problem 1).

Seed-tree pruning. In each round every vertex tells its neighbours the smallest
id of its closed neighbourhood. A vertex that nobody names as a minimum leaves
the graph and is hung below the smallest minimum it heard of; the minima stay,
linked to the smallest one heard by the same vertex. When no link is left the
remaining vertices are the seeds, and their ids flow down the forest, one join
per round, from the last round back to the first. The number of rounds grows
with the logarithm of the longest chain, not with its length.

Skew: minima are partial aggregates before any shuffle; a hub's links are
joined with its one-row minimum, which adaptive execution splits; no group is
ever collected. Every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

ID_FORM = r"^[0-9a-f]{10}_mem_[0-9]+$"


def clean_id(col):
    """Trimmed and lower-cased id, null unless it has the form of an id."""
    c = F.lower(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c.rlike(ID_FORM), c)


def operation_links(operations: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, of memory_operations: the new id with the id
    merged into and with the resulting id. Nulls, values that are no id and
    self links are left out; repeated rows count once."""
    return (
        operations.select(
            clean_id(F.col("new_memory_id")).alias("n"),
            F.explode(F.array(clean_id(F.col("merge_into_id")), clean_id(F.col("resulting_memory_id")))).alias("m"),
        )
        .where("n is not null and m is not null and n <> m")
        .select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b"))
        .distinct()
    )


def connected_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, group_id)`` for every id of ``links``; group_id is the smallest id
    linked to it directly or through others.

    Ids may be of any ordered type. Links with a null end or to itself are
    ignored, repeated links count once, an empty table gives an empty one, and
    other columns are not read.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "groups")
    edges = (
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges = scratch.keep(edges, "edges0")
    trees: list[DataFrame] = []
    rounds = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        minima = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        heard = both.join(minima, "a").select(F.col("b").alias("v"), "m").union(minima.select(F.col("a").alias("v"), "m"))
        heard = scratch.keep(heard.distinct(), f"heard{rounds}")
        least = heard.groupBy("v").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("v")).alias("stays"))
        tree = scratch.keep(least.where("not stays").select("v", F.col("low").alias("parent")), f"tree{rounds}")
        trees.append(tree)
        # Only vertices that heard of several minima carry links on.
        several = least.join(heard, "v").where("m <> low").select(F.col("low").alias("a"), F.col("m").alias("b"))
        following = scratch.keep(several.distinct(), f"edges{rounds + 1}")
        scratch.drop(f"heard{rounds}", *([f"edges{rounds}"] if rounds else []))
        edges, rounds = following, rounds + 1
    if not trees:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    # From the last round to the first: a parent left later than its child, or never.
    labels = trees[-1].select(F.col("v").alias("id"), F.col("parent").alias("group_id"))
    for k, tree in reversed(list(enumerate(trees[:-1]))):
        up = labels.select(F.col("id").alias("parent"), "group_id")
        down = tree.join(up, "parent", "left").select(F.col("v").alias("id"), F.coalesce("group_id", "parent").alias("group_id"))
        labels = scratch.keep(labels.union(down), f"labels{k}")
    seeds = labels.select(F.col("group_id").alias("id"), "group_id").distinct()
    return labels.union(seeds)
