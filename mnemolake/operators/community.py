"""Connected components and communities of entity graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``(graph_id, name, component)``, component the smallest name reached.

    Labels spread over edges and, as shortcuts, from a label to its own label, so
    the rounds grow with the logarithm of the diameter; each is a written table."""
    scratch = Scratch(edges.sparkSession, "components")
    both = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")))).alias("e")).select("graph_id", "e.*").where("a is not null and b is not null").distinct()
    both = scratch.keep(both, "edges")
    first = both.groupBy("graph_id", "a").agg(F.min("b").alias("low"))
    labels = scratch.keep(first.select("graph_id", F.col("a").alias("name"), F.least("a", "low").alias("label")), "labels0")
    step = 0
    while True:
        near = both.join(labels.select("graph_id", F.col("name").alias("b"), "label"), ["graph_id", "b"]).groupBy("graph_id", "a").agg(F.min("label").alias("low"))
        up = labels.select("graph_id", F.col("name").alias("label"), F.col("label").alias("over"))
        joined = labels.join(near.withColumnRenamed("a", "name"), ["graph_id", "name"]).join(up, ["graph_id", "label"])
        after = scratch.keep(joined.select("graph_id", "name", F.least("label", "low", "over").alias("label"), (F.least("low", "over") < F.col("label")).alias("moved")), f"labels{step + 1}")
        scratch.drop(f"labels{step}")
        labels, step = after.select("graph_id", "name", "label"), step + 1
        if after.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """Names of each graph's largest component (ties to the smallest label), ordered."""
    from .rank import top_k

    parts = components(edges)
    size = parts.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    best = top_k(size, ["graph_id"], 1, F.desc("n"), "component").select("graph_id", "component")
    return parts.join(best, ["graph_id", "component"]).select("graph_id", "name")


def communities(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``(graph_id, name, community)`` by weighted label propagation, over all
    graphs at once: a node takes the label of the greatest summed weight around
    it, itself included with its strongest edge, ties to the smaller label.

    Rounds go on until no label moves. From the fourth on a node moves only to a
    smaller label than its own, so labels cannot swing for ever; it is an error if
    ``rounds`` are not enough."""
    scratch = Scratch(edges.sparkSession, "communities")
    both = edges.where("src <> tgt").select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")))).alias("e"), "weight").select("graph_id", "e.*", "weight")
    own = both.groupBy("graph_id", "a").agg(F.max("weight").alias("weight")).select("graph_id", "a", F.col("a").alias("b"), "weight")
    both = scratch.keep(both.union(own), "edges")
    labels = both.select("graph_id", F.col("a").alias("name")).distinct().withColumn("label", F.col("name"))
    for step in range(rounds):
        votes = both.join(labels.select("graph_id", F.col("name").alias("b"), "label"), ["graph_id", "b"]).groupBy("graph_id", "a", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = votes.groupBy("graph_id", "a").agg(F.min(F.struct(-F.col("w"), "label")).alias("m")).select("graph_id", F.col("a").alias("name"), F.col("m.label").alias("to"))
        moved = best.join(labels, ["graph_id", "name"])
        to = F.least("to", "label") if step >= 3 else F.col("to")
        after = scratch.keep(moved.select("graph_id", "name", to.alias("label"), (to != F.col("label")).alias("moved")), f"labels{step}")
        if step:
            scratch.drop(f"labels{step - 1}")
        labels = after.select("graph_id", "name", "label")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    return labels.withColumnRenamed("label", "community")


LOCAL_EDGES = 200_000


def inside_largest(edges: DataFrame) -> DataFrame:
    """The edges of each graph's largest component."""
    names = largest_component(edges)
    return edges.join(names.withColumnRenamed("name", "src"), ["graph_id", "src"], "left_semi")


def hierarchy(edges: DataFrame, most: int = 10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(graph_id, name, level, cluster)``: hierarchical modularity clustering of each
    graph's largest component.

    Level 0 is the partition of the Louvain method (nodes move to the neighbouring
    cluster of the greatest gain, clusters become nodes, until nothing moves), each
    cluster cut into its connected parts. Clusters of more than ``most`` nodes are divided
    again, a level deeper, as long as they split. Graphs up to ``local_edges`` edges are
    one task each; larger ones are worked off with all tasks at once (``moved``)."""
    scratch = Scratch(edges.sparkSession, "hierarchy")
    kept = scratch.keep(inside_largest(edges.where("src is not null and tgt is not null")).select("graph_id", "src", "tgt", F.col("weight").cast("double").alias("weight")), "edges")
    size = kept.groupBy("graph_id").agg(F.count("*").alias("n"))
    small = kept.join(size.where(F.col("n") <= local_edges).select("graph_id"), "graph_id", "left_semi")
    large = kept.join(size.where(F.col("n") > local_edges).select("graph_id"), "graph_id", "left_semi")
    kind = kept.schema["graph_id"].dataType.simpleString()
    out = small.groupBy("graph_id").applyInPandas(lambda pdf: _levels(pdf, most), f"graph_id {kind}, name string, level long, cluster string")
    if large.isEmpty():
        return out
    return out.unionByName(_levels_of_large(large, most, scratch))


def _move(nodes: list, w: dict, degree: dict, total: float) -> dict:
    """Local moving: cluster of each node, named by one of its nodes."""
    label, mass = {n: n for n in nodes}, dict(degree)
    moved = True
    while moved:
        moved = False
        for n in nodes:
            around: dict = {}
            for m, x in w[n].items():
                if m != n:
                    around[label[m]] = around.get(label[m], 0.0) + x
            own = label[n]
            mass[own] -= degree[n]
            best, top = own, around.get(own, 0.0) - mass[own] * degree[n] / total
            for c in sorted(around):
                gain = around[c] - mass[c] * degree[n] / total
                if gain > top + 1e-9:
                    best, top = c, gain
            mass[best] += degree[n]
            if best != own:
                label[n], moved = best, True
    return label


def _parts(nodes: list, label: dict, w: dict) -> dict:
    """The clusters cut into connected parts, each named by its smallest node."""
    out: dict = {}
    for start in nodes:
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            n = todo.pop()
            for m in w[n]:
                if m not in out and label[m] == label[start]:
                    out[m] = start
                    todo.append(m)
    return out


def _partition(nodes: list, w: dict) -> dict:
    """Louvain over a graph of sorted nodes: moving, then clusters as nodes."""
    found = {n: n for n in nodes}
    at, now = nodes, w
    while True:
        degree = {n: sum(now[n].values()) + now[n].get(n, 0.0) for n in at}
        label = _move(at, now, degree, sum(degree.values()) or 1.0)
        if len(set(label.values())) == len(at):
            return _parts(nodes, found, w)
        found = {n: label[c] for n, c in found.items()}
        merged: dict = {c: {} for c in sorted(set(label.values()))}
        for n in at:
            for m, x in now[n].items():
                a, b = label[n], label[m]
                # An edge inside is met from both ends, a loop once.
                merged[a][b] = merged[a].get(b, 0.0) + (x / 2 if a == b and n != m else x)
        at, now = sorted(merged), merged


def _levels(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    w: dict = {}
    for a, b, x in zip(pdf.src, pdf.tgt, pdf.weight):
        for u, v in {(a, b), (b, a)}:
            near = w.setdefault(u, {})
            near[v] = near.get(v, 0.0) + max(float(x), 0.0)
    out, queue = [], [(0, "", sorted(w))]
    while queue:
        level, above, nodes = queue.pop()
        inside = set(nodes)
        found = _partition(nodes, {n: {m: x for m, x in w[n].items() if m in inside} for n in nodes})
        groups: dict = {}
        for n in nodes:
            groups.setdefault(found[n], []).append(n)
        if level and len(groups) == 1:
            continue
        for c, members in groups.items():
            name = f"{above}{level}:{c}"
            out += [(n, level, name) for n in members]
            if len(members) > most:
                queue.append((level + 1, f"{name}/", members))
    return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "name": [o[0] for o in out], "level": [o[1] for o in out], "cluster": [o[2] for o in out]})


def moved(both: DataFrame, scratch: Scratch, name: str, rounds: int = 32) -> DataFrame:
    """``(key, node, label)``: local moving over all tasks. ``both (key, a, b, weight)``
    holds each edge from both ends and loops once with twice their weight. In a round half
    of the nodes, drawn by a hash, may move, so neighbours do not swap clusters."""
    degree = scratch.keep(both.groupBy("key", F.col("a").alias("node")).agg(F.sum("weight").alias("degree")), f"{name}-degree")
    total = degree.groupBy("key").agg(F.sum("degree").alias("total"))
    labels, still = degree.select("key", "node", F.col("node").alias("label")), 0
    for step in range(rounds):
        mass = labels.join(degree, ["key", "node"]).groupBy("key", "label").agg(F.sum("degree").alias("mass"))
        to = both.where("a <> b").join(labels.select("key", F.col("node").alias("b"), "label"), ["key", "b"]).groupBy("key", F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        own = labels.select("key", "node", "label", F.lit(0.0).alias("w"))
        options = to.unionByName(own).groupBy("key", "node", "label").agg(F.sum("w").alias("w")).join(mass, ["key", "label"]).join(degree, ["key", "node"]).join(total, "key").join(labels.withColumnRenamed("label", "now"), ["key", "node"])
        stays = F.col("label") == F.col("now")
        gain = F.round(F.col("w") - (F.col("mass") - F.when(stays, F.col("degree")).otherwise(0.0)) * F.col("degree") / F.col("total"), 9)
        best = options.withColumn("gain", gain).groupBy("key", "node").agg(F.min(F.struct(-F.col("gain"), (~stays).alias("goes"), "label")).alias("m"), F.any_value("now").alias("now"))
        turn = F.pmod(F.xxhash64("node", F.lit(step // 2)), F.lit(2)) == step % 2
        after = scratch.keep(best.select("key", "node", F.when(turn, F.col("m.label")).otherwise(F.col("now")).alias("label"), (turn & (F.col("m.label") != F.col("now"))).alias("went")), f"{name}-{step}")
        if step:
            scratch.drop(f"{name}-{step - 1}")
        labels, still = after.select("key", "node", "label"), 0 if not after.where("went").isEmpty() else still + 1
        if still == 2:
            break
    return labels


def _louvain_of_large(both: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(key, node, label)``: moving and merging until the clusters stay."""
    found, now, step = None, both, 0
    while True:
        label = moved(now, scratch, f"{name}-{step}")
        if label.where("node <> label").isEmpty():
            return label if found is None else found
        found = label if found is None else found.join(label.withColumnsRenamed({"node": "label", "label": "up"}), ["key", "label"]).select("key", "node", F.col("up").alias("label"))
        found = scratch.keep(found, f"{name}-found{step}")
        ends = lambda c: label.select("key", F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        merged = now.join(ends("a"), ["key", "a"]).join(ends("b"), ["key", "b"]).groupBy("key", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("weight").alias("weight"))
        now, step = scratch.keep(merged, f"{name}-merged{step}"), step + 1


def _levels_of_large(edges: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b"))))
    both = edges.withColumn("e", ends).groupBy("graph_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"))
    both, out, level = scratch.keep(both.withColumn("above", F.lit("")), "both"), None, 0
    while True:
        found = _louvain_of_large(both.select(F.struct("graph_id", "above").alias("key"), "a", "b", "weight"), scratch, f"level{level}")
        # Connected parts of the clusters.
        side = lambda c: found.select("key.graph_id", "key.above", F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        inner = both.join(side("a"), ["graph_id", "above", "a"]).join(side("b"), ["graph_id", "above", "b"]).where("_a = _b")
        whole = F.to_json(F.struct("graph_id", "above", "_a"))
        parts = components(inner.select(whole.alias("graph_id"), F.col("a").alias("src"), F.col("b").alias("tgt"))).withColumnsRenamed({"graph_id": "k"})
        lone = found.select("key.graph_id", "key.above", F.col("node").alias("name"), F.to_json(F.struct("key.graph_id", "key.above", F.col("label").alias("_a"))).alias("k")).join(parts, ["k", "name"], "left")
        named = lone.select("graph_id", "above", "name", F.concat("above", F.lit(f"{level}:"), F.coalesce("component", "name")).alias("cluster"))
        split = named.groupBy("graph_id", "above").agg(F.count_distinct("cluster").alias("n")).where("n > 1") if level else named.select("graph_id", "above").distinct()
        named = scratch.keep(named.join(split.select("graph_id", "above"), ["graph_id", "above"], "left_semi"), f"named{level}")
        rows = named.select("graph_id", "name", F.lit(level).cast("long").alias("level"), "cluster")
        out = rows if out is None else out.union(rows)
        large = named.groupBy("graph_id", "cluster").agg(F.count("*").alias("n")).where(F.col("n") > most).select("graph_id", "cluster")
        inside = named.join(large, ["graph_id", "cluster"], "left_semi").select("graph_id", "name", "cluster")
        if inside.isEmpty():
            return out
        both = both.drop("above").join(inside.withColumnsRenamed({"name": "a", "cluster": "above"}), ["graph_id", "a"]).join(inside.withColumnsRenamed({"name": "b", "cluster": "above"}), ["graph_id", "b", "above"])
        both = scratch.keep(both.select("graph_id", "a", "b", "weight", F.concat("above", F.lit("/")).alias("above")), f"both{level + 1}")
        level += 1


def invariants(clusters: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """``(graph_id, n_nodes, once, nested, positive)`` of a hierarchy: nodes of level 0,
    whether each node is in one cluster a level, whether deeper clusters lie in one of the
    level above, and whether the modularity of level 0 is not negative."""
    top = clusters.where("level = 0")
    n = top.groupBy("graph_id").agg(F.count_distinct("name").alias("n_nodes"))
    once = clusters.groupBy("graph_id", "level", "name").agg(F.count("*").alias("n")).groupBy("graph_id").agg((F.max("n") == 1).alias("once"))
    up = clusters.select("graph_id", (F.col("level") + 1).alias("level"), "name", F.col("cluster").alias("over"))
    nested = clusters.where("level > 0").join(up, ["graph_id", "level", "name"], "left").groupBy("graph_id", "level", "cluster").agg(F.count_distinct("over").alias("k"), F.count_if(F.col("over").isNull()).alias("lost")).groupBy("graph_id").agg(((F.max("k") == 1) & (F.max("lost") == 0)).alias("nested"))
    e = edges.join(top.select("graph_id", F.col("name").alias("src"), F.col("cluster").alias("ca")), ["graph_id", "src"]).join(top.select("graph_id", F.col("name").alias("tgt"), F.col("cluster").alias("cb")), ["graph_id", "tgt"])
    m = e.groupBy("graph_id").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    mass = e.select("graph_id", F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("graph_id", "c").agg(F.sum("weight").alias("d")).groupBy("graph_id").agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    q = m.join(mass, "graph_id").select("graph_id", (F.round(F.col("inside") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m")), 9) >= 0).alias("positive"))
    return n.join(once, "graph_id").join(nested, "graph_id", "left").join(q, "graph_id").select("graph_id", "n_nodes", "once", F.coalesce("nested", F.lit(True)).alias("nested"), "positive")
