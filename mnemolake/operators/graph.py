"""Entity graphs: merge-upserts, degrees, neighbourhoods, chunk ranking, contexts.

All graphs are processed at once, with ``graph_id`` as a key. Nodes are
(graph_id, name, type, descriptions, source_ids), edges (graph_id, src, tgt,
weight, ord, descriptions, source_ids) with src <= tgt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import first_occurrence, ranked, top_k

SEP = "<SEP>"


def majority_type(records: DataFrame, position: str) -> DataFrame:
    """``(graph_id, name, type)``: most frequent type, ties to the first seen."""
    counted = records.where("type is not null").groupBy("graph_id", "name", "type").agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return first_occurrence(counted, ["graph_id", "name"], F.desc("n"), "first", "type").select("graph_id", "name", "type", "n")


def merge_nodes(records: DataFrame, position: str) -> DataFrame:
    """Nodes of entity records (graph_id, name, type, description, source_id):
    majority type, distinct descriptions and sources in order. Repeating a record
    changes only the type's count, never the sets."""
    sets = records.groupBy("graph_id", "name").agg(
        F.array_sort(F.collect_set("description")).alias("descriptions"), F.array_sort(F.collect_set("source_id")).alias("source_ids")
    )
    return sets.join(majority_type(records, position).drop("n"), ["graph_id", "name"], "left")


def undirected(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """The pair in order, the smaller name first."""
    return edges.withColumn("_a", F.least(src, tgt)).withColumn("_b", F.greatest(src, tgt)).drop(src, tgt).withColumnsRenamed({"_a": "src", "_b": "tgt"})


def merge_edges(records: DataFrame) -> DataFrame:
    """Edges of relationship records: summed weight (1 where null), least order (1
    where null), distinct descriptions and sources."""
    return undirected(records).groupBy("graph_id", "src", "tgt").agg(
        F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"),
        F.min(F.coalesce("ord", F.lit(1))).alias("ord"),
        F.array_sort(F.collect_set("description")).alias("descriptions"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of type ``"UNKNOWN"`` for endpoints that no entity record names, with
    their edges' descriptions and sources."""
    ends = edges.select("graph_id", F.explode(F.array("src", "tgt")).alias("name"), "descriptions", "source_ids")
    lost = ends.join(nodes.select("graph_id", "name"), ["graph_id", "name"], "left_anti")
    return lost.groupBy("graph_id", "name").agg(
        F.lit('"UNKNOWN"').alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("descriptions")))).alias("descriptions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"),
    )


def incidence(edges: DataFrame) -> DataFrame:
    """``(graph_id, name, neighbour, weight)``, both directions; a self loop twice."""
    return edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("name"), F.col("tgt").alias("neighbour")), F.struct(F.col("tgt").alias("name"), F.col("src").alias("neighbour")))).alias("e"), "weight").select("graph_id", "e.*", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy("graph_id", "name").agg(F.count("*").alias("degree"))


def edge_ranks(edges: DataFrame) -> DataFrame:
    """Edges with ``rank``, the sum of their ends' degrees."""
    d = degrees(edges)
    a, b = d.select("graph_id", F.col("name").alias("src"), F.col("degree").alias("da")), d.select("graph_id", F.col("name").alias("tgt"), F.col("degree").alias("db"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "tgt"]).withColumn("rank", F.col("da") + F.col("db")).drop("da", "db")


def one_hop(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph_id, name, neighbour, neighbour_type)`` of the seeds' neighbours;
    the type is null for a neighbour without a node."""
    around = incidence(edges).select("graph_id", "name", "neighbour").distinct()
    types = nodes.select("graph_id", F.col("name").alias("neighbour"), F.col("type").alias("neighbour_type"))
    return around.join(seeds.select("graph_id", "name").distinct(), ["graph_id", "name"]).join(types, ["graph_id", "neighbour"], "left")


def without_user(seeds: DataFrame, name: str = "name") -> DataFrame:
    """Seeds without the node of the user."""
    return seeds.where(F.lower(F.replace(name, F.lit('"'), F.lit(""))) != "user")


def relation_counts(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, name, entity_order, chunk_id, relation_count)``: of each seed
    and chunk it cites, the neighbours that cite the chunk too."""
    cites = nodes.select("graph_id", "name", F.explode("source_ids").alias("chunk_id"))
    own = seeds.select("graph_id", "name", "entity_order").join(cites, ["graph_id", "name"])
    near = incidence(edges).select("graph_id", "name", "neighbour").distinct().join(seeds.select("graph_id", "name"), ["graph_id", "name"])
    shared = near.join(cites.withColumnRenamed("name", "neighbour"), ["graph_id", "neighbour"]).groupBy("graph_id", "name", "chunk_id").agg(F.count("*").alias("relation_count"))
    return own.join(shared, ["graph_id", "name", "chunk_id"], "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))


def text_units(counts: DataFrame) -> DataFrame:
    """One row a chunk: that of the first seed citing it."""
    return first_occurrence(counts, ["graph_id", "chunk_id"], "entity_order", "name")


RANKINGS = {
    "vector": ["-sim"],
    "entity": ["entity_order"],
    "count": ["-relation_count"],
    "entity_vector": ["entity_order", "-sim"],
    "count_vector": ["-relation_count", "-sim"],
    "entity_count_vector": ["entity_order", "-relation_count", "-sim"],
    "entity_count": ["entity_order", "-relation_count"],
}


def ranking_of(modes: list[str]) -> str:
    """The first ``rank-...`` mode; without one, by entity and count."""
    for mode in modes:
        if mode.startswith("rank-"):
            return mode[5:].replace("-", "_")
    return "entity_count"


def rank_chunks(units: DataFrame, method: str) -> DataFrame:
    """Chunks in the order of a method, discovery order (entity, chunk) for ties."""
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in RANKINGS[method]]
    return ranked(units, ["graph_id"], *order, "entity_order", "chunk_id")


def related_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at any seed, once each, by rank, weight and name."""
    hit = incidence(edges).join(seeds.select("graph_id", "name"), ["graph_id", "name"])
    keys = hit.select("graph_id", F.least("name", "neighbour").alias("src"), F.greatest("name", "neighbour").alias("tgt")).distinct()
    return ranked(edge_ranks(edges).withColumnRenamed("rank", "edge_rank").join(keys, ["graph_id", "src", "tgt"]), ["graph_id"], F.desc("edge_rank"), F.desc(F.round("weight", 6)), "src", "tgt")


def community_schema(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, cluster, n_nodes, n_edges, n_chunks, occurrence)`` of a table
    ``(graph_id, cluster, name, source_ids)``; occurrence is the share of the
    largest chunk count of the graph."""
    size = members.groupBy("graph_id", "cluster").agg(F.count_distinct("name").alias("n_nodes"))
    of = members.select("graph_id", "cluster", "name").distinct()
    inc = incidence(edges).select("graph_id", "name", "neighbour")
    n_edges = of.join(inc, ["graph_id", "name"]).select("graph_id", "cluster", F.least("name", "neighbour").alias("a"), F.greatest("name", "neighbour").alias("b")).distinct().groupBy("graph_id", "cluster").agg(F.count("*").alias("n_edges"))
    chunks = members.select("graph_id", "cluster", F.explode("source_ids").alias("c")).groupBy("graph_id", "cluster").agg(F.count_distinct("c").alias("n_chunks"))
    out = size.join(n_edges, ["graph_id", "cluster"], "left").join(chunks, ["graph_id", "cluster"], "left").na.fill(0)
    top = out.groupBy("graph_id").agg(F.max("n_chunks").alias("most"))
    return out.join(top, "graph_id").withColumn("occurrence", F.coalesce(F.try_divide("n_chunks", "most"), F.lit(0.0))).drop("most")


def contained(child: DataFrame, parent: DataFrame) -> DataFrame:
    """``(graph_id, child, parent)``: clusters whose members all lie in a parent's.
    Tables ``(graph_id, cluster, name)``."""
    c = child.select("graph_id", F.col("cluster").alias("child"), "name").distinct()
    p = parent.select("graph_id", F.col("cluster").alias("parent"), "name").distinct()
    size = c.groupBy("graph_id", "child").agg(F.count("*").alias("size"))
    common = c.join(p, ["graph_id", "name"]).groupBy("graph_id", "child", "parent").agg(F.count("*").alias("common"))
    return common.join(size, ["graph_id", "child"]).where("common = size").select("graph_id", "child", "parent")


def sections(parts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Typed sections in one table ``(graph_id, section, section_order, rank, content)``."""
    out = None
    for i, name in enumerate(order):
        part = parts[name].select("graph_id", F.lit(name).alias("section"), F.lit(i).alias("section_order"), "rank", "content")
        out = part if out is None else out.unionByName(part)
    return out


def support_points(reports: DataFrame, least_rating: float = 0.0, most: int = 512) -> DataFrame:
    """The first ``most`` reports of a graph by occurrence; of these, those at or above
    the rating (null is 0), ordered by occurrence and rating."""
    first = top_k(reports, ["graph_id"], most, F.desc("occurrence"), "report_id", name="pick")
    kept = first.where(F.coalesce("rating", F.lit(0.0)) >= least_rating)
    return ranked(kept, ["graph_id"], F.desc("occurrence"), F.desc(F.coalesce("rating", F.lit(0.0))), "report_id")


def greedy_groups(rows: DataFrame, by: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Consecutive groups whose tokens stay in the budget, each of one row at least
    (so that a row beyond the budget is a group of its own). A group of ``by`` is one
    task, for lists cut to a bounded length before, as ``support_points`` does."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        group, used, out = 0, 0, []
        for n in pdf[tokens]:
            if out and used + n > budget:
                group, used = group + 1, 0
            used += n
            out.append(group)
        return pdf.assign(group=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(by).applyInPandas(run, f"{schema}, `group` long")
