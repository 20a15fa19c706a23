"""BM25 over many small corpora at once, one a question or user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, corpus: str, doc: str, tokens) -> DataFrame:
    """``(corpus, doc, term, tf, dl)``."""
    exploded = docs.select(F.col(corpus).alias("corpus"), F.col(doc).alias("doc"), F.size(tokens).alias("dl"), F.explode(tokens).alias("term"))
    return exploded.groupBy("corpus", "doc", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(docs: DataFrame, corpus: str, tokens) -> DataFrame:
    """``(corpus, n, avgdl)``; documents without tokens count."""
    return docs.groupBy(F.col(corpus).alias("corpus")).agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """``(corpus, term, df, idf)``: negative idf becomes a quarter of the mean idf."""
    df = post.groupBy("corpus", "term").agg(F.count("*").alias("df"))
    raw = df.join(stats, "corpus").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("corpus").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "corpus").select("corpus", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def scores(post: DataFrame, stats: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """``(question, doc, score)`` of documents that share a term with the query
    ``(question, corpus, term)``; a term repeated in the query counts again."""
    asked = queries.groupBy("question", "corpus", "term").agg(F.count("*").alias("qf"))
    hit = asked.join(post, ["corpus", "term"]).join(terms.select("corpus", "term", "idf"), ["corpus", "term"]).join(stats, "corpus")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return hit.groupBy("question", "corpus", "doc").agg(F.sum(part).alias("score"))


def full_ranking_scores(scored: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores of all documents of each question's corpus, 0 where no term is shared.

    ``docs`` is (corpus, doc), ``questions`` (question, corpus)."""
    every = questions.join(docs, "corpus")
    return every.join(scored.select("question", "doc", "score"), ["question", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
