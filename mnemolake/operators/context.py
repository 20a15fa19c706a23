"""Query contexts over entity graphs: vector hits, related communities, sections
under token budgets, and the local, relation-first, naive and global contexts.

All questions are answered at once; ``graph_id`` is the key of graph and question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_line, word_count
from .dense import cosine
from .graph import SEP, degrees, related_edges
from .rank import budget_prefix, ranked, top_k

NEW_CHUNK = "--New Chunk--\n"


def vector_hits(asked: DataFrame, items: DataFrame, keys: list[str], k: int = 20, threshold: float = 0.2) -> DataFrame:
    """The ``k`` items of a question's graph nearest to it, with ``sim`` and ``hit``
    (from 1). Tables ``(graph_id, q)`` and ``(graph_id, *keys, vec)``; items below the
    threshold are none, ties go to the smaller keys."""
    sim = F.round(cosine(F.col("vec"), F.col("q"), 1e-9), 9)
    scored = items.join(asked, "graph_id").withColumn("sim", sim).drop("vec", "q").where(F.col("sim") >= threshold)
    return top_k(scored, ["graph_id"], k, F.desc("sim"), *keys, name="hit")


def related_communities(hits: DataFrame, clusters: DataFrame, reports: DataFrame, level: int = 2, most: int = 5) -> DataFrame:
    """``(graph_id, cluster, hits, rating, report, rank)``: communities of the entities
    hit, by the number of hits and the rating (null is -1); those without a report are
    left out. Tables ``(graph_id, name)``, ``(graph_id, name, level, cluster)`` and
    ``(graph_id, cluster, rating, report)``."""
    counted = clusters.where(F.col("level") <= level).join(hits.select("graph_id", "name"), ["graph_id", "name"]).groupBy("graph_id", "cluster").agg(F.count("*").alias("hits"))
    held = counted.join(reports.select("graph_id", "cluster", "rating", "report"), ["graph_id", "cluster"])
    return top_k(held, ["graph_id"], most, F.desc("hits"), F.desc(F.coalesce("rating", F.lit(-1.0))), "cluster")


def with_nodes(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, name, hit, type, description, degree)``; hits without a node drop out."""
    rows = hits.select("graph_id", "name", "hit").join(nodes.select("graph_id", "name", "type", F.array_join("descriptions", SEP).alias("description")), ["graph_id", "name"])
    return rows.join(degrees(edges), ["graph_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edges_in_budget(seeds: DataFrame, edges: DataFrame, budget: int = 4800) -> DataFrame:
    """Edges at the seeds by rank and weight, as long as their descriptions stay in the budget."""
    rows = related_edges(seeds, edges).withColumn("description", F.array_join("descriptions", SEP))
    return budget_prefix(rows.withColumn("n", word_count(F.col("description"))), ["graph_id"], ["rank"], "n", budget)


def seeds_of_relations(hits: DataFrame) -> DataFrame:
    """``(graph_id, name, hit)``: the ends of relations ``(graph_id, src, tgt, hit)`` in
    the order they are first seen, the source before the target."""
    ends = hits.select("graph_id", F.posexplode(F.array("src", "tgt")).alias("side", "name"), (F.col("hit") * 2).alias("at"))
    first = ends.groupBy("graph_id", "name").agg(F.min(F.col("at") + F.col("side")).alias("at"))
    return ranked(first, ["graph_id"], "at", name="hit").drop("at")


def csv_section(rows: DataFrame, order: str, columns: list[tuple[str, str, bool]], name: str) -> DataFrame:
    """``(graph_id, name)``: a header and a numbered line for each row, in order.
    ``columns`` are (header, column, whether it is a number)."""
    line = csv_line([((F.col(order) - 1).cast("string"), True), *[(F.col(c).cast("string"), number) for _, c, number in columns]])
    header = ",\t".join(f'"{h}"' for h in ["id", *[h for h, _, _ in columns]])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x.line)
    return rows.groupBy("graph_id").agg(F.concat_ws("\n", F.lit(header), lines).alias(name))


def local_context(entities: DataFrame, relations: DataFrame, communities: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, context)``: reports, entities, relationships and sources of each
    graph as CSV; a section without rows is its header. All are ranked from 1."""
    parts = {
        "Reports": csv_section(communities, "rank", [("content", "report", False)], "Reports"),
        "Entities": csv_section(entities, "rank", [("entity", "name", False), ("type", "type", False), ("description", "description", False), ("rank", "degree", True)], "Entities"),
        "Relationships": csv_section(relations, "rank", [("source", "src", False), ("target", "tgt", False), ("description", "description", False), ("weight", "weight", True), ("rank", "edge_rank", True)], "Relationships"),
        "Sources": csv_section(sources, "rank", [("content", "content", False)], "Sources"),
    }
    heads = {"Reports": ["content"], "Entities": ["entity", "type", "description", "rank"], "Relationships": ["source", "target", "description", "weight", "rank"], "Sources": ["content"]}
    out = entities.select("graph_id").distinct()
    for part in parts.values():
        out = out.join(part, "graph_id", "left")
    blocks = [F.concat(F.lit(f"-----{name}-----\n```csv\n"), F.coalesce(name, F.lit(",\t".join(f'"{h}"' for h in ["id", *heads[name]]))), F.lit("\n```")) for name in parts]
    return out.select("graph_id", F.concat_ws("\n", *blocks).alias("context"))


def naive_context(hits: DataFrame, content: str = "content", budget: int = 12000) -> DataFrame:
    """``(graph_id, n_chunks, context)``: chunks in the order of ``hit`` as long as they
    stay in the budget, joined by a separator."""
    kept = budget_prefix(hits.withColumn("n", word_count(F.col(content))), ["graph_id"], ["hit"], "n", budget)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("hit", F.col(content).alias("text")))), lambda x: x.text)
    return kept.groupBy("graph_id").agg(F.count("*").alias("n_chunks"), F.array_join(texts, NEW_CHUNK).alias("context"))


def global_context(grouped: DataFrame, points: Callable[[DataFrame], DataFrame], budget: int = 16384) -> DataFrame:
    """``(graph_id, n_points, context)``: the map step gives each group of reports
    (``graph_id, group, ...``) points ``(graph_id, group, point, description, score)``;
    those with a description and a score over 0 (null is 1) are ordered by score and
    kept as long as they stay in the budget."""
    made = points(grouped).where("description is not null").withColumn("score", F.coalesce("score", F.lit(1.0))).where("score > 0")
    order = ranked(made.withColumn("n", word_count(F.col("description"))), ["graph_id"], F.desc("score"), "group", "point")
    kept = budget_prefix(order, ["graph_id"], ["rank"], "n", budget)
    text = F.concat(F.lit("----Analyst "), F.col("group").cast("string"), F.lit("----\nImportance Score: "), F.format_string("%.1f", "score"), F.lit("\n"), F.col("description"), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x.text)
    return kept.groupBy("graph_id").agg(F.count("*").alias("n_points"), F.array_join(lines, "\n").alias("context"))


def describe_communities(members: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 4000, reported: DataFrame | None = None) -> DataFrame:
    """``(graph_id, cluster, kind, item, content, degree)``: what a report on a community
    is written from. Nodes of ``members (graph_id, cluster, name)`` and edges inside by
    degree; the budget is shared between them by their numbers. Members named in
    ``reported (graph_id, cluster, name)``, as a sub-community's report holds them, are
    left out, edges with both ends in it too."""
    own = members.select("graph_id", "cluster", "name").distinct()
    left = own if reported is None else own.join(reported.select("graph_id", "cluster", "name").distinct(), ["graph_id", "cluster", "name"], "left_anti")
    n = with_nodes(left.withColumn("hit", F.lit(0)).select("graph_id", "name", "hit").distinct(), nodes, edges)
    n = left.join(n, ["graph_id", "name"]).select("graph_id", "cluster", F.lit("entity").alias("kind"), F.col("name").alias("item"), F.col("description").alias("content"), "degree")
    d = degrees(edges)
    side = lambda c: own.select("graph_id", "cluster", F.col("name").alias(c))
    e = edges.where("src <> tgt").join(side("src"), ["graph_id", "src"]).join(side("tgt"), ["graph_id", "cluster", "tgt"])
    if reported is not None:
        ends = reported.select("graph_id", "cluster", "name").distinct()
        known = e.join(ends.withColumnRenamed("name", "src"), ["graph_id", "cluster", "src"]).join(ends.withColumnRenamed("name", "tgt"), ["graph_id", "cluster", "tgt"]).select("graph_id", "cluster", "src", "tgt")
        e = e.join(known, ["graph_id", "cluster", "src", "tgt"], "left_anti")
    e = e.join(d.select("graph_id", F.col("name").alias("src"), F.col("degree").alias("da")), ["graph_id", "src"]).join(d.select("graph_id", F.col("name").alias("tgt"), F.col("degree").alias("db")), ["graph_id", "tgt"])
    e = e.select("graph_id", "cluster", F.lit("relation").alias("kind"), F.concat_ws(" - ", "src", "tgt").alias("item"), F.array_join("descriptions", SEP).alias("content"), (F.col("da") + F.col("db")).alias("degree"))
    rows = n.unionByName(e).withColumn("n", word_count(F.concat_ws(" ", "item", "content")))
    size = rows.groupBy("graph_id", "cluster").agg(F.count("*").alias("every"), F.count_if(F.col("kind") == "entity").alias("of_nodes"))
    rows = rows.join(size, ["graph_id", "cluster"])
    share = F.floor(F.lit(budget) * F.when(F.col("kind") == "entity", F.col("of_nodes")).otherwise(F.col("every") - F.col("of_nodes")) / F.col("every"))
    kept = budget_prefix(rows.withColumn("share", share), ["graph_id", "cluster", "kind"], [F.desc("degree"), "item"], "n", F.col("share"))
    return kept.select("graph_id", "cluster", "kind", "item", "content", "degree")


def report_text(title, summary, findings):
    """Markdown of a report; ``findings`` is an array of (summary, explanation)."""
    parts = F.transform(findings, lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), F.coalesce(f["explanation"], F.lit(""))))
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Report")), F.lit("\n\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.array_join(parts, "\n\n"))


def community_reports(described: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(graph_id, cluster, rating, report)``: ``write`` turns ``(graph_id, cluster,
    prompt)`` into ``(graph_id, cluster, title, summary, rating, findings)``."""
    line = csv_line([(F.col("kind"), False), (F.col("item"), False), (F.col("content"), False), (F.col("degree").cast("string"), True)])
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", (-F.col("degree")).alias("d"), "item", line.alias("line")))), lambda x: x.line), "\n")
    made = write(described.groupBy("graph_id", "cluster").agg(prompt.alias("prompt")))
    return made.select("graph_id", "cluster", "rating", report_text(F.col("title"), F.col("summary"), F.col("findings")).alias("report"))


def items_by_session(items: DataFrame, sources: str = "source_ids") -> DataFrame:
    """Nodes or edges once for each session their sources name."""
    from ..functions.text import session_ids_in

    found = F.array_distinct(F.flatten(F.transform(sources, session_ids_in)))
    return items.withColumn("session_id", F.explode(found))
