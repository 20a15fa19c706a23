"""Queries of the nine training-data problems, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import chunking, components, knn, mixing, mojibake, names, neardup, packing, pii, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, sf_dir):
    groups = components.connected_groups(components.operation_links(_table(spark, sf_dir, "memory_operations")))
    return groups.select(F.col("id").alias("memory_id"), "group_id")


def p2_found(spark, sf_dir):
    return pii.find(_table(spark, sf_dir, "memory_notes")).select("memory_id", "note_field", "pii_type", "nth")


def p2_sanitised(spark, sf_dir):
    notes = _table(spark, sf_dir, "memory_notes").select("memory_id", "content", "facts")
    return pii.sanitise(notes).distinct()


def _graph_names(spark, sf_dir):
    return names.graph_names(_table(spark, sf_dir, "entities"), _table(spark, sf_dir, "relationships"))


def p3_found(spark, sf_dir):
    return names.same_node_pairs(_graph_names(spark, sf_dir)).toDF("graph_id", "name_a", "name_b")


def p3_groups(spark, sf_dir):
    return names.link_names(_graph_names(spark, sf_dir)).toDF("graph_id", "name", "node_key")


def _note_vectors(spark, sf_dir):
    return _table(spark, sf_dir, "note_vectors").select(F.col("memory_id").alias("id"), "vec")


def p4_found(spark, sf_dir):
    return knn.nearest_pairs(_note_vectors(spark, sf_dir)).toDF("memory_id_a", "memory_id_b")


def p4_neighbours(spark, sf_dir):
    found = knn.nearest(_note_vectors(spark, sf_dir))
    return found.select(F.col("id").alias("memory_id"), "neighbour", F.round("cos", 6).alias("cos"), "rank")


def p5_found(spark, sf_dir):
    return chunking.oversized(_table(spark, sf_dir, "text_chunks"))


def p5_pieces(spark, sf_dir):
    return chunking.split_chunks(_table(spark, sf_dir, "text_chunks"))


def _note_texts(spark, sf_dir):
    return neardup.note_texts(_table(spark, sf_dir, "memory_notes"))


def p5_checked(spark, sf_dir):
    """One row: chunks, those cut, pieces over the limit, chunks whose pieces do not add
    up to their text again, overlaps that are not the stated one."""
    rows = _table(spark, sf_dir, "text_chunks").where("chunk_id is not null and content is not null").select(F.col("chunk_id").alias("id"), F.col("content").alias("text")).dropDuplicates(["id"])
    pieces = chunking.split_texts(rows)
    before = F.max("piece").over(Window.partitionBy("id"))
    each = pieces.withColumn("last", before).withColumn("stop_before", F.lag("stop").over(Window.partitionBy("id").orderBy("piece")))
    part = F.expr("substring(content, greatest(coalesce(stop_before, 0) - start, 0) + 1)")
    whole = each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", part.alias("t")))), lambda x: x.t), "").alias("again"), F.max("last").alias("last"), F.max("tokens").alias("most"))
    spans = F.size(F.regexp_extract_all(F.expr("substring(content, 1, stop_before - start)"), F.lit(r"[A-Za-z0-9]+|[^ \t\r\n]"), F.lit(0)))
    overlaps = each.where("piece > 0").agg(F.count_if(spans != 100).alias("uneven"))
    return whole.join(rows, "id").agg(F.count("*").alias("chunks"), F.count_if(F.expr("last > 0")).alias("cut"), F.count_if(F.expr("most > 1200")).alias("over"), F.count_if(F.expr("again <> text")).alias("lost")).crossJoin(overlaps)


def p6_found(spark, sf_dir):
    pairs = neardup.similar_pairs(_note_texts(spark, sf_dir), "0.7")
    return pairs.select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p6_groups(spark, sf_dir):
    groups = neardup.similar_groups(_note_texts(spark, sf_dir), "0.7")
    return groups.withColumnsRenamed({"id": "memory_id", "rep": "class_id"})


def _counted(documents):
    return tokens.count_tokens(documents.select(F.col("doc_id").alias("id"), "text"))


def p7_packed(spark, sf_dir):
    return packing.pack(_counted(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def p7_report(spark, sf_dir):
    return packing.report(packing.pack(_counted(_table(spark, sf_dir, "documents"))))


def p7_checked(spark, sf_dir):
    """One row: texts packed, containers over the capacity, texts with tokens lost or twice,
    texts within the capacity that were cut."""
    counted = Scratch(spark, "checked").keep(_counted(_table(spark, sf_dir, "documents")), "counted")
    packed = Scratch(spark, "packed").keep(packing.pack(counted), "packed")
    over = packed.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.expr("n > 2048")).alias("over"))
    placed = packed.groupBy("id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    both = counted.where("tokens > 0").groupBy("id").agg(F.max("tokens").alias("tokens")).join(placed, "id", "full")
    return both.agg(F.count("*").alias("texts"), F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("lost"), F.count_if(F.expr("tokens <= 2048 and pieces > 1")).alias("split")).crossJoin(over)


def _mix(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return mixing.Mix(documents, _counted(documents), _table(spark, sf_dir, "mix_targets"))


def p8_mix(spark, sf_dir):
    return _mix(spark, sf_dir).documents()


def p8_checked(spark, sf_dir):
    """A row per target source: its cap, whether its texts keep to it, whether the tokens
    used are those of the rate up to the noise of single texts (six standard deviations)."""
    mix = _mix(spark, sf_dir)
    uses = mix.documents().groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.max("tokens").alias("tokens"))
    own = uses.groupBy("source").agg(F.max("uses").alias("most"), F.sum(F.col("uses") * F.col("tokens")).alias("used"))
    noise = mix.texts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("tokens")).alias("square"))
    rows = mix.report().select("source", "max_repeats", "available", "rate").join(own, "source", "left").join(noise, "source", "left")
    near = F.abs(F.coalesce("used", F.lit(0)) - F.col("rate") * F.col("available")) <= 3 * F.sqrt(F.coalesce("square", F.lit(0)))
    return rows.select("source", F.col("max_repeats").cast("long").alias("max_repeats"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), near.alias("near_rate"))


def p8_shares(spark, sf_dir):
    return _mix(spark, sf_dir).report()


def p9_found(spark, sf_dir):
    return mojibake.restore_texts(_table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_restored(spark, sf_dir):
    return mojibake.restore_texts(_table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_sanitised": p2_sanitised, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_checked": p5_checked, "p6_found": p6_found, "p6_groups": p6_groups, "p7_packed": p7_packed, "p7_report": p7_report, "p7_checked": p7_checked, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checked": p8_checked, "p9_found": p9_found, "p9_restored": p9_restored}
