"""Mixing sources to target weights (problem 8).

Tokens are aggregated per source, repetition rates are derived from the targets,
and each text is emitted floor(rate) times plus one more with the probability of
the fraction, decided by a seeded hash of the text. A text that several documents
hold counts as one, under its smallest id, so that no text is used more often than
its source's cap.

The mix is a share of the corpus's tokens. A source whose target exceeds its
tokens times its cap gives all it may; what it lacks goes to the others in
proportion to their targets, until the size is reached or every source is at its
cap. Only totals per source (a row of the target table each) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def source_name(col):
    """Trimmed, lower-cased, with underscores for hyphens."""
    return F.regexp_replace(F.lower(F.trim(col)), "-", "_")


def rates(targets: dict[str, tuple[float, float]], available: dict[str, int], size: float) -> dict[str, float]:
    """Repetitions of each source, for ``{source: (share, cap)}``."""
    fixed: dict[str, float] = {}
    open_ = {s for s, (share, _) in targets.items() if share > 0 and available.get(s, 0) > 0}
    while open_:
        left = size - sum(fixed[s] * available[s] for s in fixed)
        total = sum(targets[s][0] for s in open_)
        wanted = {s: max(0.0, left) * targets[s][0] / total / available[s] for s in open_}
        full = {s for s in open_ if wanted[s] >= targets[s][1]}
        if not full:
            return fixed | wanted
        fixed |= {s: float(targets[s][1]) for s in full}
        open_ -= full
    return fixed


class Mix:
    """A mix of documents ``(doc_id, text, source)`` with tokens already counted.

    ``counted`` is ``(id, tokens)`` of every document. Documents without text,
    id or token, and those of sources without a target, are not used; a null cap
    is no cap, a null or negative share is none. Repeated rows and verbatim
    repeats count once as texts, but all count for the size of the corpus."""

    def __init__(self, documents: DataFrame, counted: DataFrame, targets: DataFrame, share_of_corpus: float = 0.5, seed: int = 17):
        self.spark, self.seed = documents.sparkSession, seed
        scratch = Scratch(self.spark, "mix")
        docs = documents.where("doc_id is not null and text is not null").select("doc_id", source_name(F.col("source")).alias("source"), F.md5("text").alias("key"))
        docs = docs.join(counted.where("tokens > 0").groupBy("id").agg(F.max("tokens").alias("tokens")).withColumnRenamed("id", "doc_id"), "doc_id")
        firsts = docs.groupBy("key").agg(F.min(F.struct("doc_id", "source")).alias("d"), F.max("tokens").alias("tokens"), F.count_distinct("doc_id").alias("copies"))
        self.texts = scratch.keep(firsts.select("key", "d.doc_id", "d.source", "tokens", "copies"), "texts")
        goal = {
            r["source"]: (max(0.0, r["share"] or 0.0), float("inf") if r["cap"] is None else r["cap"])
            for r in targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
        }
        sums = self.texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("all"))
        known = sums.where(F.col("source").isin(list(goal))).collect()
        self.corpus = self.texts.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
        self.available = {r["source"]: r["tokens"] for r in known}
        self.goal, self.rates = goal, rates(goal, self.available, self.corpus * share_of_corpus)

    def documents(self) -> DataFrame:
        """``(doc_id, source, copy, tokens)``, a row per use of a text."""
        schema = "source string, rate double"
        rate = self.spark.createDataFrame(list(self.rates.items()), schema)
        rows = self.texts.join(F.broadcast(rate), "source")
        draw = F.pmod(F.xxhash64(F.lit(self.seed), "key"), F.lit(1 << 53)) / float(1 << 53)
        copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
        rows = rows.withColumn("copies", copies).where("copies > 0")
        return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "tokens")

    def report(self) -> DataFrame:
        """A row per target source: share wanted and reached, tokens available and
        used, the rate, and whether the cap was met."""
        schema = "source string, target_share double, max_repeats double, available long, rate double, at_cap boolean"
        rows = [(s, share, None if cap == float("inf") else float(cap), self.available.get(s, 0), self.rates.get(s, 0.0), self.rates.get(s, 0.0) >= cap or s not in self.available) for s, (share, cap) in sorted(self.goal.items())]
        used = self.documents().groupBy("source").agg(F.sum("tokens").alias("used"))
        out = self.spark.createDataFrame(rows, schema).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        total = out.agg(F.sum("used").alias("total"))
        return out.crossJoin(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.try_divide("used", "total"), F.lit(0.0))).drop("total")
