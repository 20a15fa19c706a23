"""Stores as tables: keyed rows, vectors, graphs, snapshots by session, caches.

A store is a folder with a table for each version; ``CURRENT`` names the one to read. A
write makes a new version and then moves the name, so readers never see half a table
and a failed write changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import upsert
from ..operators.dense import search
from ..operators.rank import first_occurrence


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class KeyedStore:
    """A table with one row a key, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _current(self) -> str | None:
        fs, p = _fs(self.spark, f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> DataFrame | None:
        """The rows, or None before the first write."""
        name = self._current()
        return None if name is None else self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame) -> None:
        """Replace all rows; of rows with one key one is kept."""
        name = f"version-{uuid.uuid4().hex}"
        df.dropDuplicates(self.keys).write.parquet(f"{self.path}/{name}")
        fs, made = _fs(self.spark, f"{self.path}/{name}.current")
        stream = fs.create(made, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        at = _fs(self.spark, f"{self.path}/CURRENT")[1]
        if fs.exists(at):
            fs.delete(at, False)
        fs.rename(made, at)

    def upsert(self, new: DataFrame) -> None:
        """Add rows; those of known keys are replaced."""
        held = self.read()
        self.write(new if held is None else upsert(held, new.dropDuplicates(self.keys), self.keys))

    def missing(self, asked: DataFrame) -> DataFrame:
        """Rows whose key is not there (resume)."""
        held = self.read()
        return asked if held is None else asked.join(held.select(*self.keys).distinct(), self.keys, "left_anti")


class VectorStore(KeyedStore):
    """Rows ``(id, vec, ...)``; other columns are kept and come back with the hits."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["id"])

    def query(self, queries: DataFrame, k: int = 20, threshold: float | None = 0.2) -> DataFrame:
        """``(query, id, score, rank, ...)``: the k nearest by cosine at or above the threshold."""
        held = self.read()
        if held is None:
            raise ValueError("the store is empty")
        found = search(held.select("id", "vec"), queries, k, "cosine", threshold, exclude_self=False)
        return found.join(held.drop("vec"), "id")


def snapshot(rows: DataFrame, session_order: str, upto, keys: list[str]) -> DataFrame:
    """The state after a session: of each key the latest row not after it. Rows are kept
    once with the session that brought them; no snapshot is a copy."""
    return first_occurrence(rows.where(F.col(session_order) <= upto), keys, F.desc(session_order))


def write_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """A map as JSON lines ``{key, items}``, a row a key."""
    df.select(F.col(key).alias("key"), F.col(value).alias("items")).write.mode("overwrite").json(path)


def latest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The newest file of a pattern, ties to the last name, on any file system."""
    fs, p = _fs(spark, f"{folder.rstrip('/')}/{pattern}")
    files = sorted((f.getModificationTime(), f.getPath().toString()) for f in fs.globStatus(p) or [])
    return files[-1][1] if files else None


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(position, line)``: a GraphML document of ``(name, attrs)`` and ``(src, tgt,
    attrs)``, attributes as maps of texts, nodes and edges in order."""
    keys = nodes.select(F.explode(F.map_keys("attrs")).alias("k")).withColumn("of", F.lit("node")).union(edges.select(F.explode(F.map_keys("attrs")), F.lit("edge"))).distinct()
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit('<data key="'), esc(e.key), F.lit('">'), esc(F.coalesce(e.value, F.lit(""))), F.lit("</data>"))), "")
    head = keys.select(F.lit(1).alias("part"), F.concat_ws(" ", "of", "k").alias("at"), F.concat(F.lit('<key id="'), esc(F.col("k")), F.lit('" for="'), F.col("of"), F.lit('" attr.name="'), esc(F.col("k")), F.lit('" attr.type="string"/>')).alias("line"))
    n = nodes.select(F.lit(2).alias("part"), F.col("name").alias("at"), F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('">'), data, F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.concat_ws("\t", "src", "tgt").alias("at"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("tgt")), F.lit('">'), data, F.lit("</edge>")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="utf-8"?>'), (0, " ", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'), (4, "", "</graph></graphml>")], "part int, at string, line string")
    return ends.union(head).union(n).union(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The document as sorted text lines in one file: one graph, as a file format of one
    document needs; tables are the form for large graphs."""
    graphml_lines(nodes, edges).coalesce(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)
