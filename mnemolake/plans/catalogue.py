"""The queries of the engine, by name; each reads its whole tables.

Rows delivered twice are taken once by ``distinct`` over the columns used. Names
of graphs are compared without quotes, trimmed, in upper case.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokenizer
from ..operators import build, chunks, community, context, corpus, dense, evaluation, external, graph, notes, prompts, rank, retrieval, sessions, sparse
from ..scratch import shared_dir
from ..streaming import ingest

QUERIES: dict = {}
# Fixed value: the number of entities that a graph query starts from.
TOP_K = 20


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# Sources of the domain tables


def source_name():
    return F.regexp_replace(F.lower(F.trim("source")), "-", "_")


APRIL = lambda t: t.content.contains("April")


def documents(spark, d, source):
    return table(spark, d, "documents").where(source_name() == source)


def sessions_of(spark, d):
    return documents(spark, d, "lme_session").select("doc_id", sessions.parse_turns(F.col("text")).alias("turns"))


def note_rows(spark, d, *cols):
    return table(spark, d, "memory_notes").where("memory_id is not null").select("memory_id", "user_uuid", *cols).distinct()


def note_docs(spark, d):
    rows = note_rows(spark, d, "content").where("user_uuid is not null and content is not null")
    return rows.withColumn("tokens", F.split(F.lower("content"), " "))


def interests(spark, d):
    found = F.regexp_extract("persona_info", r"Interests: ([^\n]*)$", 1)
    return table(spark, d, "halu_users").select(F.col("user_uuid").alias("question"), "persona_info", F.lower(found).alias("interests")).where("interests <> ''")


def entity_rows(spark, d):
    name = F.upper(F.trim(F.replace(F.col("entity_name"), F.lit('"'), F.lit(""))))
    kind = F.upper(F.trim(F.replace(F.col("entity_type"), F.lit('"'), F.lit(""))))
    rows = table(spark, d, "entities").select("entity_row_id", "graph_id", name.alias("name"), kind.alias("type"), "description", "source_id", F.when(~F.isnan("importance_score"), F.col("importance_score")).alias("importance"))
    return rows.where("graph_id is not null and name <> ''").distinct()


def relation_rows(spark, d):
    clean = lambda c: F.upper(F.trim(F.replace(F.col(c), F.lit('"'), F.lit(""))))
    rows = table(spark, d, "relationships").select("rel_row_id", "graph_id", clean("src_id").alias("src"), clean("tgt_id").alias("tgt"), "description", F.when(~F.isnan("weight"), F.col("weight")).alias("weight"), "ord", "source_id")
    return rows.where("graph_id is not null and src <> '' and tgt <> ''").distinct()


def nodes_of(spark, d):
    return graph.merge_nodes(entity_rows(spark, d), "entity_row_id")


def edges_of(spark, d):
    return graph.merge_edges(relation_rows(spark, d))


def seeds_of(spark, d, k):
    best = entity_rows(spark, d).where("importance is not null").groupBy("graph_id", "name").agg(F.max("importance").alias("importance"))
    return rank.top_k(best, ["graph_id"], k, F.desc("importance"), "name", name="entity_order").select("graph_id", "name", "entity_order")


def judged(spark, d):
    digit = F.regexp_extract("text", r"Score: (\d)", 1)
    label = F.regexp_extract("text", r"Label: (\w+)", 1)
    kinds = F.element_at(F.array(F.lit("Event Memory"), F.lit("Persona Memory"), F.lit("Relationship Memory")), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents(spark, d, "judge_rationale").select(
        "doc_id", F.when(digit != "", digit.cast("int")).alias("score"), F.when(label != "", label).alias("label"), (F.col("n_chars") % 5 + 1).cast("double").alias("importance"),
        (F.col("doc_id") % 7 == 0).alias("interference"), F.when(F.col("doc_id") % 3 == 0, "true").when(F.col("doc_id") % 3 == 1, "True").otherwise("false").alias("is_target"), kinds.alias("memory_type"), F.lower(F.trim("lang")).alias("lang"),
    )


# Sessions and texts


@query
def session_user_text(spark, d):
    return sessions_of(spark, d).select("doc_id", sessions.user_text(F.col("turns")).alias("flat_text"), sessions.user_lines(F.col("turns")).alias("graph_text"))


@query
def session_dialogue_render(spark, d):
    rows = documents(spark, d, "halu_dialogue").select("doc_id", sessions.parse_turns(F.col("text"), "\n").alias("t"))
    return rows.select("doc_id", sessions.titled(F.col("t")).alias("titled"), sessions.judge_lines(F.col("t")).alias("judge_text"), sessions.graph_lines(F.col("t")).alias("graph_text"))


@query
def session_user_turn_stats(spark, d):
    t = F.col("turns")
    return sessions_of(spark, d).select("doc_id", F.size(t).cast("long").alias("n_turns"), F.size(sessions.user_turns(t)).cast("long").alias("n_user"), F.length(sessions.user_text(t)).cast("long").alias("user_chars"), sessions.has_answer(t, APRIL).alias("has_target"))


@query
def noans_rewrite(spark, d):
    rows = sessions_of(spark, d).withColumn("session_id", F.concat(F.lit("answer_"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", sessions.renamed_non_answer(F.col("session_id"), F.col("turns"), APRIL).alias("session_id"), sessions.is_gold(F.col("session_id"), F.col("turns"), APRIL).alias("is_gold"))


@query
def duplicate_content_guard(spark, d):
    return sessions.duplicate_report(table(spark, d, "memory_notes"), "memory_id", "content").where("memory_id is not null")


@query
def session_id_dedup(spark, d):
    rows = table(spark, d, "text_chunks").select("user_uuid", "full_doc_id", "chunk_id").where("user_uuid is not null and full_doc_id is not null").distinct()
    return sessions.unique_session_ids(rows, "user_uuid", "full_doc_id", ["chunk_id"]).select("user_uuid", "full_doc_id", "chunk_id", F.col("occurrence").cast("long").alias("occurrence"), "unique_id")


@query
def session_actions(spark, d):
    rows = table(spark, d, "memory_operations").where("user_uuid is not null")
    return sessions.session_action(rows, "user_uuid", "op_action")


@query
def persona_names(spark, d):
    return table(spark, d, "halu_users").select("user_uuid", T.name_of_persona(F.col("persona_info")).alias("name"))


@query
def note_components(spark, d):
    rows = note_rows(spark, d, "keywords", "summary", "facts", "session_id")
    empty = lambda c: T.is_empty_component(F.col(c))
    memories = sessions.extracted_memory_text(F.col("summary"), F.col("keywords"), F.col("facts"))
    return rows.select("memory_id", empty("keywords").alias("no_keywords"), empty("summary").alias("no_summary"), F.array_join(memories, " | ").alias("memories"), F.size(T.keyphrases(F.coalesce("keywords", F.lit("")))).cast("long").alias("n_keywords"), T.strip_turn(F.col("session_id")).alias("session_head"), T.content_id(F.col("summary"), "note-").alias("summary_id"))


@query
def note_vector_text(spark, d):
    return notes.vector_text(note_rows(spark, d, "keywords", "facts", "summary", "content"))


@query
def report_csv(spark, d):
    line = T.csv_line([(F.col("name"), False), (F.col("type"), False), (F.col("entity_row_id").cast("string"), True)])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entity_row_id", line.alias("line")))), lambda x: x.line)
    return entity_rows(spark, d).dropDuplicates(["graph_id", "entity_row_id"]).groupBy("graph_id").agg(F.array_join(lines, "\n").alias("csv"))


# Sparse retrieval and its metrics


def _bm25(spark, d):
    docs, tokens = note_docs(spark, d), F.col("tokens")
    post = sparse.postings(docs, "user_uuid", "memory_id", tokens)
    stats = sparse.corpus_stats(docs, "user_uuid", tokens)
    return docs, post, stats, sparse.term_stats(post, stats)


def _asked(spark, d):
    terms = F.split(F.trim(F.replace("interests", F.lit(","), F.lit(""))), r"\s+")
    return interests(spark, d).select("question", F.col("question").alias("corpus"), F.explode(terms).alias("term"))


def _ranking(spark, d):
    docs, post, stats, terms = _bm25(spark, d)
    scored = sparse.scores(post, stats, terms, _asked(spark, d))
    every = docs.select(F.col("user_uuid").alias("corpus"), F.col("memory_id").alias("doc")).distinct()
    full = sparse.full_ranking_scores(scored, every, interests(spark, d).select("question", F.col("question").alias("corpus")))
    return rank.ranked(full, ["question"], F.desc(F.round("score", 9)), "doc")


def _gold(spark, d):
    phrases = interests(spark, d).select("question", F.explode(F.split("interests", ", ")).alias("phrase"))
    docs = note_docs(spark, d).select(F.col("user_uuid").alias("question"), F.col("memory_id").alias("doc"), F.lower("content").alias("content"))
    return docs.join(phrases, "question").where(F.contains("content", "phrase")).select("question", "doc").distinct()


@query
def bm25_term_stats(spark, d):
    return _bm25(spark, d)[3].select("corpus", "term", "df", r6("idf").alias("idf"))


@query
def bm25_scores_topk(spark, d):
    _, post, stats, terms = _bm25(spark, d)
    scored = sparse.scores(post, stats, terms, _asked(spark, d))
    return rank.top_k(scored, ["question"], 10, F.desc(F.round("score", 9)), "doc").select("question", "doc", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


def _metrics(spark, d):
    return evaluation.retrieval_metrics(_ranking(spark, d), _gold(spark, d), interests(spark, d))


@query
def retrieval_recall_at_k(spark, d):
    return _metrics(spark, d).select("question", "k", "recall_any", "recall_all")


@query
def retrieval_ndcg_at_k(spark, d):
    return _metrics(spark, d).select("question", "k", r6("ndcg").alias("ndcg"))


@query
def retrieval_metrics_by_group(spark, d):
    gender = F.regexp_extract("persona_info", r"Gender: ([a-z-]+)", 1)
    groups = interests(spark, d).select("question", F.when(gender != "", gender).alias("gender"))
    out = evaluation.metrics_by_group(_metrics(spark, d), groups, "gender")
    return out.select("group_name", "k", r6("recall_any").alias("recall_any"), r6("recall_all").alias("recall_all"), r6("ndcg").alias("ndcg"), "n")


# Expansions and views


def _sessions_expansions(spark, d):
    rows = note_rows(spark, d, "content", "summary", "keywords", "facts").where("content is not null")
    one = rows.select(F.col("memory_id").alias("session"), F.lit("summary").alias("kind"), F.lit(0).cast("long").alias("pos"), F.col("summary").alias("text"))
    cut = lambda c, kind: rows.where(F.col(c).isNotNull()).select(F.col("memory_id").alias("session"), F.lit(kind).alias("kind"), F.posexplode(F.split(c, ";")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    return rows.select(F.col("memory_id").alias("session"), F.col("content").alias("text"), "user_uuid"), one.union(cut("keywords", "keyphrase")).union(cut("facts", "userfact"))


@query
def expansion_views(spark, d):
    return corpus.views(*_sessions_expansions(spark, d))


@query
def merged_view(spark, d):
    return corpus.merged_view(*_sessions_expansions(spark, d), ["userfact", "keyphrase", "summary"])


@query
def merge_raw_view(spark, d):
    return corpus.merged_view(*_sessions_expansions(spark, d), ["userfact", "keyphrase", "summary"], raw=True)


@query
def multi_view_mean_rank(spark, d):
    base, extra = _sessions_expansions(spark, d)
    asked = _asked(spark, d).groupBy("question").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rows = corpus.views(base, extra).join(base.select("session", F.col("user_uuid").alias("question")), "session").join(asked, "question")
    share = F.size(F.array_intersect("terms", F.split(F.lower("text"), " "))) / F.size("terms")
    scored = rank.view_mean(rows.withColumn("score", share), ["question", "session"])
    return rank.top_k(scored, ["question"], 10, F.desc(F.round("score", 9)), "session").select("question", "session", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query
def value_expansion_interleave(spark, d):
    base, extra = _sessions_expansions(spark, d)
    first = rank.top_k(base.where("user_uuid is not null").select(F.col("user_uuid").alias("question"), "session"), ["question"], 5, "session")
    out = corpus.value_expansion(first, extra)
    return out.select("question", "session", "kind", "pos", F.col("item_rank").cast("long").alias("item_rank"))


@query
def expansion_label_map(spark, d):
    rows = note_rows(spark, d, "session_id", "summary", "keywords").where("session_id is not null")
    items = rows.select(F.col("session_id").alias("session"), F.lit("summary").alias("label"), F.col("memory_id").alias("pos"), F.col("summary").alias("text")).union(rows.select("session_id", F.lit("keyphrases"), "memory_id", "keywords"))
    return corpus.label_map(items.where("text is not null"))


# Dense retrieval


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _dense(spark, d, k, metric, threshold=None):
    rows = _vectors(spark, d)
    found = dense.search(rows, rows.where("id % 20 = 0"), k, metric, threshold)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query
def dense_dot_topk(spark, d):
    return _dense(spark, d, 10, "dot")


@query
def dense_cosine_threshold_topk(spark, d):
    return _dense(spark, d, 20, "cosine", 0.2)


@query
def precision_by_label(spark, d):
    rows = _vectors(spark, d)
    hits = _dense(spark, d, 10, "cosine").join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("a")), "query_id").join(rows.select(F.col("id").alias("vec_id"), F.col("label").alias("b")), "vec_id")
    return hits.groupBy(F.col("a").alias("label")).agg(r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("precision_at_10"), F.count("*").alias("n"))


@query
def masked_mean_vector(spark, d):
    rows = _vectors(spark, d).withColumn("valid", F.col("id") % 3 != 0)
    return dense.masked_mean(rows, "label", "vec", "valid", "id").select("label", F.posexplode("vec").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


@query
def component_nanmean(spark, d):
    rows = table(spark, d, "entities").where("graph_id is not null").select("entity_row_id", "graph_id", F.col("importance_score").alias("score")).distinct()
    return rank.component_mean(rows, ["graph_id"]).select("graph_id", r6("score").alias("score"))


# Graph


@query
def node_merge_majority_type(spark, d):
    return graph.majority_type(entity_rows(spark, d), "entity_row_id")


@query
def node_merge_descriptions_sources(spark, d):
    return nodes_of(spark, d).select("graph_id", "name", F.array_join("descriptions", graph.SEP).alias("descriptions"), F.array_join("source_ids", graph.SEP).alias("source_ids"))


@query
def edge_merge_weight(spark, d):
    return edges_of(spark, d).select("graph_id", "src", "tgt", r6("weight").alias("weight"), F.col("ord").cast("long").alias("ord"), F.array_join("descriptions", graph.SEP).alias("descriptions"))


@query
def missing_endpoint_nodes(spark, d):
    return graph.missing_endpoints(edges_of(spark, d), nodes_of(spark, d)).select("graph_id", "name", "type", F.array_join("descriptions", graph.SEP).alias("descriptions"))


@query
def node_degree(spark, d):
    return graph.degrees(edges_of(spark, d))


@query
def edge_degree_rank(spark, d):
    return graph.edge_ranks(edges_of(spark, d)).select("graph_id", "src", "tgt", "rank")


@query
def one_hop_neighbours(spark, d):
    return graph.one_hop(seeds_of(spark, d, TOP_K), edges_of(spark, d), nodes_of(spark, d))


@query
def entity_text_ids(spark, d):
    rows = nodes_of(spark, d)
    return rows.select("graph_id", "name", T.content_id(F.col("name"), "ent-").alias("entity_id"), F.concat("name", F.array_join("descriptions", graph.SEP)).alias("text"))


@query
def incremental_edge_merge(spark, d):
    rows = relation_rows(spark, d)
    # Two deliveries that overlap in a third of the rows, then the second once more.
    first, second = rows.where("rel_row_id % 3 < 2"), rows.where("rel_row_id % 3 > 0")
    held = chunks.upsert(first, second, ["rel_row_id", "graph_id"])
    held = held.unionByName(chunks.unseen(second, held, ["rel_row_id", "graph_id"]))
    merged = graph.merge_edges(held)
    return merged.select("graph_id", "src", "tgt", r6("weight").alias("weight"))


def _counts(spark, d):
    return graph.relation_counts(seeds_of(spark, d, TOP_K), nodes_of(spark, d), edges_of(spark, d))


@query
def relation_counts_per_chunk(spark, d):
    return _counts(spark, d).select("graph_id", "name", "chunk_id", F.col("entity_order").cast("long").alias("entity_order"), "relation_count")


def _units(spark, d):
    units = graph.text_units(_counts(spark, d))
    text = table(spark, d, "text_chunks").where("content is not null").groupBy("chunk_id").agg(F.min("content").alias("content"))
    persona = table(spark, d, "halu_users").select(F.col("user_uuid").alias("graph_id"), F.coalesce("persona_info", F.lit("")).alias("persona"))
    rows = units.join(text, "chunk_id").join(persona, "graph_id", "left")
    sim = dense.cosine(external.hex_vector(F.col("content")), external.hex_vector(F.coalesce("persona", F.lit(""))), 1e-9)
    return rows.withColumn("sim", F.round(sim, 9)).drop("content", "persona")


def _chunk_rank(method):
    def run(spark, d):
        return graph.rank_chunks(_units(spark, d), method).select("graph_id", "chunk_id", F.col("rank").cast("long").alias("rank"))

    QUERIES[f"chunk_rank_{method}"] = run


for _method in graph.RANKINGS:
    _chunk_rank(_method)


@query
def related_edges(spark, d):
    return graph.related_edges(seeds_of(spark, d, TOP_K), edges_of(spark, d)).select("graph_id", "src", "tgt", F.col("rank").cast("long").alias("rank"), "edge_rank")


@query
def context_sections_union(spark, d):
    seeds = seeds_of(spark, d, TOP_K).select("graph_id", F.col("entity_order").alias("rank"), F.col("name").alias("content"))
    rels = graph.related_edges(seeds_of(spark, d, TOP_K), edges_of(spark, d)).select("graph_id", "rank", F.concat_ws(" - ", "src", "tgt").alias("content"))
    units = graph.rank_chunks(graph.text_units(_counts(spark, d)), "entity_count").select("graph_id", "rank", F.col("chunk_id").alias("content"))
    out = graph.sections({"entity": seeds, "relation": rels, "chunk": units}, ["entity", "relation", "chunk"])
    return out.select("graph_id", "section", F.col("rank").cast("long").alias("rank"), "content")


@query
def connected_components(spark, d):
    return community.components(edges_of(spark, d))


@query
def label_communities(spark, d):
    return community.communities(edges_of(spark, d))


@query
def cluster_hierarchy(spark, d):
    return community.hierarchy(edges_of(spark, d))


@query
def cluster_invariants(spark, d):
    """What holds of every hierarchy, whichever of several good ones was found."""
    edges = edges_of(spark, d)
    return community.invariants(community.hierarchy(edges), edges)


def _typed(spark, d):
    return nodes_of(spark, d).where("type is not null").select("graph_id", F.col("type").alias("cluster"), "name", "source_ids")


@query
def community_schema_occurrence(spark, d):
    return graph.community_schema(_typed(spark, d), edges_of(spark, d)).select("graph_id", "cluster", "n_nodes", "n_edges", "n_chunks", r6("occurrence").alias("occurrence"))


@query
def sub_community_containment(spark, d):
    child = nodes_of(spark, d).select("graph_id", F.explode("source_ids").alias("cluster"), "name")
    return graph.contained(child, _typed(spark, d))


def _reports(spark, d):
    rows = documents(spark, d, "graph_report").where("user_uuid is not null")
    return rows.select(F.col("user_uuid").alias("graph_id"), F.col("doc_id").alias("report_id"), F.col("n_chars").cast("double").alias("occurrence"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 10).cast("double")).alias("rating"))


@query
def global_support_points(spark, d):
    return graph.support_points(_reports(spark, d), 3.0).select("graph_id", "report_id", F.col("rank").cast("long").alias("rank"))


def _report_groups(spark, d):
    """The reports that the map step may see, in groups of a budget."""
    text = documents(spark, d, "graph_report").select(F.col("doc_id").alias("report_id"), T.word_count(F.col("text")).cast("long").alias("tokens"))
    rows = graph.support_points(_reports(spark, d), 3.0).join(text, "report_id").select("graph_id", "report_id", "rank", "tokens")
    return graph.greedy_groups(rows, "graph_id", "rank", "tokens", 400)


@query
def report_groups(spark, d):
    return _report_groups(spark, d).select("graph_id", "report_id", F.col("rank").cast("long").alias("rank"), "tokens", "group")


# Query contexts


def _asked_vectors(spark, d):
    return interests(spark, d).select(F.col("question").alias("graph_id"), external.hex_vector(F.col("interests")).alias("q"))


def _entity_hits(spark, d):
    items = nodes_of(spark, d).select("graph_id", "name", external.hex_vector(F.concat_ws(" ", "name", F.array_join("descriptions", " "))).alias("vec"))
    return context.vector_hits(_asked_vectors(spark, d), items, ["name"], TOP_K)


def _relation_hits(spark, d):
    items = edges_of(spark, d).select("graph_id", "src", "tgt", external.hex_vector(F.concat_ws(" ", "src", "tgt", F.array_join("descriptions", " "))).alias("vec"))
    return context.vector_hits(_asked_vectors(spark, d), items, ["src", "tgt"], TOP_K)


def _clusters(spark, d):
    """Communities of the test data: entity types (level 0) and source chunks (level 1)."""
    types = _typed(spark, d).select("graph_id", "name", F.lit(0).alias("level"), "cluster")
    return types.union(nodes_of(spark, d).select("graph_id", "name", F.lit(1), F.explode("source_ids")))


def _cluster_reports(spark, d):
    size = _clusters(spark, d).groupBy("graph_id", "cluster").agg(F.count("*").alias("n"))
    return size.select("graph_id", "cluster", F.when(F.col("n") % 5 != 0, (F.col("n") % 10).cast("double")).alias("rating"), F.concat(F.lit("# "), F.col("cluster"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" members\n\n")).alias("report"))


def _sections(spark, d, seeds, relations, order):
    """Typed rows of the sections, from seeds ``(graph_id, name, hit)``."""
    nodes, edges = nodes_of(spark, d), edges_of(spark, d)
    entities = context.with_nodes(seeds, nodes, edges).where("description <> ''").select("graph_id", F.col("hit").alias("rank"), F.col("name").alias("content"))
    reports = context.related_communities(seeds, _clusters(spark, d), _cluster_reports(spark, d)).select("graph_id", "rank", F.col("cluster").alias("content"))
    units = graph.text_units(graph.relation_counts(seeds.withColumnRenamed("hit", "entity_order"), nodes, edges))
    units = graph.rank_chunks(units, "entity_count").select("graph_id", "rank", F.col("chunk_id").alias("content"))
    out = graph.sections({"entity": entities, "relation": relations, "chunk": units, "community": reports}, order)
    return out.select("graph_id", "section", F.col("section_order").cast("long").alias("section_order"), F.col("rank").cast("long").alias("rank"), "content")


@query
def vector_entity_hits(spark, d):
    return _entity_hits(spark, d).select("graph_id", "name", F.col("hit").cast("long").alias("hit"), r6("sim").alias("sim"))


@query
def related_communities(spark, d):
    out = context.related_communities(_entity_hits(spark, d), _clusters(spark, d), _cluster_reports(spark, d))
    return out.select("graph_id", "cluster", "hits", "rating", F.col("rank").cast("long").alias("rank"))


@query
def edges_in_budget(spark, d):
    out = context.edges_in_budget(seeds_of(spark, d, TOP_K), edges_of(spark, d), 200)
    return out.select("graph_id", "src", "tgt", F.col("rank").cast("long").alias("rank"), F.col("running").cast("long").alias("running"))


@query
def entity_context(spark, d):
    """Entity-first: entity, relation, chunk and community sections of the entities hit."""
    hits = _entity_hits(spark, d)
    relations = context.edges_in_budget(hits, edges_of(spark, d)).select("graph_id", "rank", F.concat_ws(" - ", "src", "tgt").alias("content"))
    return _sections(spark, d, hits, relations, ["entity", "relation", "chunk", "community"])


@query
def relation_context(spark, d):
    """Relation-first: the relations hit, then the sections of their ends."""
    hits = _relation_hits(spark, d)
    relations = hits.select("graph_id", F.col("hit").alias("rank"), F.concat_ws(" - ", "src", "tgt").alias("content"))
    return _sections(spark, d, context.seeds_of_relations(hits), relations, ["relation", "entity", "chunk", "community"])


def _chunk_texts(spark, d):
    return table(spark, d, "text_chunks").where("content is not null").groupBy("chunk_id").agg(F.min("content").alias("content"))


@query
def local_context(spark, d):
    """The local query's context as text."""
    hits, nodes, edges = _entity_hits(spark, d), nodes_of(spark, d), edges_of(spark, d)
    entities = context.with_nodes(hits, nodes, edges).withColumnRenamed("hit", "rank")
    relations = context.edges_in_budget(hits, edges).withColumn("weight", F.format_string("%.2f", "weight"))
    reports = context.related_communities(hits, _clusters(spark, d), _cluster_reports(spark, d))
    units = graph.rank_chunks(graph.text_units(graph.relation_counts(hits.withColumnRenamed("hit", "entity_order"), nodes, edges)), "entity_count")
    sources = units.join(_chunk_texts(spark, d), "chunk_id").select("graph_id", "rank", T.first_words(F.col("content"), 20).alias("content"))
    return context.local_context(entities, relations, reports, sources)


@query
def naive_context(spark, d):
    rows = table(spark, d, "text_chunks").where("content is not null and user_uuid is not null").groupBy(F.col("user_uuid").alias("graph_id"), "chunk_id").agg(F.min("content").alias("content"))
    hits = context.vector_hits(_asked_vectors(spark, d), rows.withColumn("vec", external.hex_vector(F.col("content"))), ["chunk_id"], TOP_K)
    return context.naive_context(hits, "content", 2000)


def _stated_points(spark, d):
    """Points of the test data: a report's first line, scored by its id."""
    text = documents(spark, d, "graph_report").select(F.col("doc_id").alias("report_id"), F.split("text", "\n")[0].alias("line"))
    score = F.when(F.col("report_id") % 4 != 0, (F.col("report_id") % 7).cast("double"))
    return lambda grouped: grouped.join(text, "report_id").select("graph_id", "group", F.col("report_id").alias("point"), F.when(F.col("line") != "", F.col("line")).alias("description"), score.alias("score"))


@query
def global_context(spark, d):
    """The global query: reports in groups, points of each group, the best in a budget."""
    return context.global_context(_report_groups(spark, d), _stated_points(spark, d), 60)


@query
def community_description(spark, d):
    """What the report on a community (an entity type) is written from."""
    out = context.describe_communities(_typed(spark, d), nodes_of(spark, d), edges_of(spark, d), 120)
    return out.select("graph_id", "cluster", "kind", "item", "degree")


@query
def community_report_texts(spark, d):
    def write(prompts_):
        lines = F.split("prompt", "\n")
        findings = F.transform(F.slice(lines, 1, 2), lambda x: F.struct(F.split(x, ",\t")[1].alias("summary"), F.split(x, ",\t")[0].alias("explanation")))
        return prompts_.select("graph_id", "cluster", F.col("cluster").alias("title"), F.concat(F.size(lines).cast("string"), F.lit(" items")).alias("summary"), F.size(lines).cast("double").alias("rating"), findings.alias("findings"))

    return context.community_reports(context.describe_communities(_typed(spark, d), nodes_of(spark, d), edges_of(spark, d), 120), write)


# Judging



@query
def integrity_scores(spark, d):
    out = evaluation.integrity(judged(spark, d))
    return out.select("total", "valid", *[r6(c).alias(c) for c in ("recall_all", "recall_valid", "weighted_all", "weighted_valid", "interference_accuracy")])


@query
def accuracy_scores(spark, d):
    out = evaluation.accuracy(judged(spark, d))
    return out.select("target", "valid", *[r6(c).alias(c) for c in ("accuracy_all", "accuracy_valid", "weighted_all", "weighted_valid")])


def _ratios(spark, d, labels):
    out = evaluation.label_ratios(judged(spark, d), labels)
    return out.select("total", "valid", *[r6(c).alias(c) for c in out.columns[2:]])


@query
def update_ratios(spark, d):
    return _ratios(spark, d, ["Correct", "Hallucination", "Omission", "Other"])


@query
def qa_ratios(spark, d):
    return _ratios(spark, d, ["Correct", "Hallucination", "Omission"])


@query
def memory_type_accuracy(spark, d):
    rows = judged(spark, d)
    out = evaluation.type_accuracy(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"))
    return out.select("memory_type", "total", *[r6(c).alias(c) for c in ("integrity_acc", "update_acc", "memory_acc")])


@query
def qa_accuracy_by_type(spark, d):
    rows = judged(spark, d).withColumn("hit", F.coalesce(F.col("label") == "Correct", F.lit(False)).cast("int"))
    return evaluation.accuracy_by_type(rows, "memory_type", "hit")


@query
def judge_routing(spark, d):
    ops = table(spark, d, "memory_operations").where("operation_id is not null")
    rows = ops.select("operation_id", F.when(F.col("op_action") == "updated", "True").otherwise("False").alias("is_update"), F.col("neighbor_ids").alias("memories_from_system"), F.when(F.col("op_action") == "no_action", "interference").otherwise("dialogue").alias("memory_source"))
    return evaluation.route(rows).select("operation_id", "bucket", "interference").distinct()


@query
def duration_totals(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("search_ms"), F.when(F.col("event_type") == "click", F.col("value")).alias("click_ms"))
    return evaluation.durations(rows, "search_ms", "click_ms").select(r6("search_min").alias("search_min"), r6("click_min").alias("click_min"))


@query
def entity_recall(spark, d):
    rel = relation_rows(spark, d).select("graph_id", F.explode(F.array("src", "tgt")).alias("name"))
    return evaluation.entity_recall(rel, entity_rows(spark, d), "graph_id").select("graph_id", r6("entity_recall").alias("entity_recall"))


@query
def id_difference(spark, d):
    made = table(spark, d, "memory_operations").where("op_action = 'created' and new_memory_id is not null").select(F.lower(F.trim("new_memory_id")).alias("memory_id"))
    return evaluation.id_difference(made, table(spark, d, "memory_notes").where("memory_id is not null").select(F.lower(F.trim("memory_id")).alias("memory_id")), "memory_id")


# Chunks, budgets, records


@query
def token_window_chunks(spark, d):
    rows = note_rows(spark, d, "content").where("content is not null")
    out = chunks.token_windows(rows, "memory_id", F.split("content", " "), 32, 8)
    return out.select("memory_id", F.col("chunk_order_index").cast("long").alias("chunk_order_index"), F.col("tokens").cast("long").alias("tokens"), "content")


@query
def separator_chunks(spark, d):
    rows = table(spark, d, "text_chunks").where("content is not null").select("chunk_id", "content").distinct()
    return chunks.separator_chunks(rows, "chunk_id", "content", [".", "!", "?", "。"], 200, 20)


@query
def keyed_chunks(spark, d):
    rows = table(spark, d, "text_chunks").where("content is not null").select(F.col("chunk_id").alias("given_id"), "content", "user_uuid").distinct()
    return chunks.keyed_chunks(rows, "given_id").select("chunk_id", "given_id")


@query
def token_budget_prefix(spark, d):
    rows = note_docs(spark, d).withColumn("n", F.size("tokens").cast("long"))
    return rank.budget_prefix_spread(rows, ["user_uuid"], ["memory_id"], "n", 300).select("user_uuid", "memory_id", "running")


@query
def record_parse(spark, d):
    rows = documents(spark, d, "extraction_record").select("doc_id", F.posexplode(T.records_in(F.col("text"))).alias("pos", "f"))
    rows = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), T.entity_of(F.col("f")).alias("e"), T.relationship_of(F.col("f")).alias("r")).where("e is not null or r is not null")
    return rows.select("doc_id", "pos", F.coalesce("e.name", "r.src").alias("name"), F.coalesce("e.type", "r.tgt").alias("second"), F.coalesce("e.description", "r.description").alias("description"), F.col("r.weight").alias("weight"))


@query
def json_salvage(spark, d):
    rows = table(spark, d, "memory_operations").where("operation_id is not null").select("operation_id", "llm_reasoning").distinct()
    return rows.select("operation_id", T.json_salvage(F.col("llm_reasoning")).alias("json"))


@query
def resume_antijoin(spark, d):
    ops = table(spark, d, "memory_operations").where("new_memory_id is not null").select(F.col("new_memory_id").alias("memory_id")).distinct()
    return chunks.unseen(ops, table(spark, d, "memory_notes"), ["memory_id"])


# Notes


@query
def flatten_points(spark, d):
    out = notes.points(note_rows(spark, d, "content", "summary", "keywords", "facts"))
    return out.select("memory_id", F.col("pos").cast("long").alias("pos"), "point_type", "point")


@query
def flattened_topk(spark, d):
    rows = note_rows(spark, d, "content", "summary", "keywords", "facts")
    persona = interests(spark, d).select(F.col("question").alias("user_uuid"), external.hex_vector(F.col("interests")).alias("q"))
    scored = notes.points(rows).join(rows.select("memory_id", "user_uuid"), "memory_id").join(persona, "user_uuid")
    scored = scored.withColumn("score", F.round(dense.cosine(external.hex_vector(F.col("point")), F.col("q"), 1e-9), 4))
    return rank.top_k(scored, ["user_uuid"], 10, F.desc("score"), "memory_id", "pos").select("user_uuid", "memory_id", F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"), "score")


@query
def neighbour_fill(spark, d):
    rows = note_rows(spark, d, "related_memories").where("user_uuid is not null")
    hits = rank.top_k(rows.select(F.col("user_uuid").alias("question"), "memory_id").distinct(), ["question"], 3, "memory_id").withColumn("score", 1.0 / F.col("rank"))
    out = notes.neighbour_fill(hits, rows, 6)
    return out.select("question", "memory_id", F.col("fill_rank").cast("long").alias("fill_rank"), r6("score").alias("score"))


@query
def point_in_time_retrieval(spark, d):
    asked = table(spark, d, "halu_users").select("user_uuid", F.col("first_start_time").alias("at"))
    rows = note_rows(spark, d, "noted_at").where("noted_at is not null")
    return notes.as_of(asked, rows, "user_uuid", "at", "noted_at").select("user_uuid", "memory_id")


@query
def operation_log_index(spark, d):
    rows = table(spark, d, "memory_operations").where("user_uuid is not null and operation_id is not null").select("user_uuid", "op_time", "operation_id").distinct()
    return notes.operation_index(rows, "user_uuid", F.col("op_time").asc_nulls_first(), "operation_id").select("user_uuid", "operation_id", F.col("op_index").cast("long").alias("op_index"))


@query
def trajectory_counts(spark, d):
    return notes.trajectory(table(spark, d, "memory_operations").select("operation_id", "op_action").distinct())


@query
def note_decision_fold(spark, d):
    rows = note_rows(spark, d, "noted_at", "summary").where("user_uuid is not null").withColumnRenamed("summary", "text")
    return notes.decision_fold(rows, "user_uuid", "noted_at")


@query
def run_summary(spark, d):
    rows = note_rows(spark, d, "session_id")
    return rows.agg(F.count_distinct("user_uuid").alias("users"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("memory_id").alias("memories"))


# Retrieval by component, with points, over changing documents


def _note_corpus(spark, d):
    rows = note_rows(spark, d, "keywords", "facts", "summary", "content").where("user_uuid is not null")
    return rows.dropDuplicates(["memory_id"]).withColumnsRenamed({"memory_id": "doc", "user_uuid": "corpus"})


def _asked_texts(spark, d):
    return interests(spark, d).select("question", F.col("question").alias("corpus"), F.col("interests").alias("text"))


def _best(scored, k=5):
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), ["question"], k, F.desc("score"), "doc")


@query
def separate_view_scores(spark, d):
    out = _best(retrieval.separate_views(_asked_texts(spark, d), _note_corpus(spark, d), external.hex_vector))
    return out.select("question", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query
def merged_mean_scores(spark, d):
    notes_ = _note_corpus(spark, d)
    asked = _asked_texts(spark, d).select("question", "corpus", external.hex_vector(F.col("text")).alias("vec"))
    of = lambda c: retrieval.scores("cosine", asked, notes_.select("corpus", "doc", external.hex_vector(c).alias("vec")))
    merged = of(F.concat_ws(" ", "keywords", "facts", "summary"))
    out = _best(retrieval.merged_mean(merged, of(F.coalesce("content", F.lit("")))))
    return out.select("question", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query
def points_of_hits(spark, d):
    """Notes retrieved first, then cut into points that inherit the score."""
    hits = _best(retrieval.separate_views(_asked_texts(spark, d), _note_corpus(spark, d), external.hex_vector), 3).withColumnRenamed("doc", "memory_id")
    out = retrieval.points_of_hits(hits, _note_corpus(spark, d).withColumnRenamed("doc", "memory_id"), 8)
    return out.select("question", "memory_id", F.col("pos").cast("long").alias("pos"), "point_type", F.col("rank").cast("long").alias("rank"), "score")


@query
def documents_replaced(spark, d):
    """A corpus after new versions of some documents came and others went."""
    held = _note_corpus(spark, d).select("doc", "corpus", F.col("summary").alias("text"))
    newer = _note_corpus(spark, d).where("summary is null").select("doc", "corpus", F.col("content").alias("text"))
    return retrieval.remove_documents(retrieval.add_documents(held, newer, ["doc"]), held.where("text = ''").select("doc"), ["doc"])


@query
def session_id_mapping(spark, d):
    """Ids of repeated sessions, a second delivery under the mapping of the first, and the
    mapping found again from the ids before and after."""
    rows = table(spark, d, "text_chunks").select("user_uuid", "full_doc_id", "chunk_id").where("user_uuid is not null and full_doc_id is not null").distinct()
    none = spark.createDataFrame([], "session string, n int, unique_id string")
    first = build.unique_ids_with_mapping(rows, "user_uuid", "full_doc_id", ["chunk_id"], none)
    again = build.unique_ids_with_mapping(rows, "user_uuid", "full_doc_id", ["chunk_id"], build.mapping_of(first, "full_doc_id"))
    found = build.reconstructed_mapping(rows, again.select("user_uuid", "chunk_id", F.col("unique_id").alias("full_doc_id")), "user_uuid", "chunk_id", "full_doc_id")
    return again.join(found.select("unique_id", F.lit(True).alias("mapped")), "unique_id", "left").select("user_uuid", "chunk_id", "unique_id", F.coalesce("mapped", F.lit(False)).alias("mapped"))


@query
def tokenizer_windows(spark, d):
    rows = table(spark, d, "text_chunks").where("content is not null").select("chunk_id", "content").distinct()
    out = tokenizer.windows(rows, "chunk_id", "content", tokenizer.Words(), 200, 20)
    return out.select("chunk_id", F.col("chunk_order_index").cast("long").alias("chunk_order_index"), F.col("tokens").cast("long").alias("tokens"), "content")


# Evaluation inputs


@query
def empty_extraction_scores(spark, d):
    """Points judged by a stated rule, without a call where nothing was extracted."""
    rows = note_rows(spark, d, "summary").select(F.col("memory_id").alias("point_id"), F.col("summary").alias("extracted")).dropDuplicates(["point_id"])
    return evaluation.judge_scores(rows, lambda asked: asked.select("point_id", (F.length("extracted") % 3).alias("score")))


@query
def merged_eval_rows(spark, d):
    """Questions with what was retrieved and extracted for them."""
    asked = table(spark, d, "text_chunks").where("user_uuid is not null and full_doc_id is not null").select(F.col("full_doc_id").alias("session"), F.col("user_uuid").alias("question")).distinct()
    asked = evaluation.question_keys(asked.withColumn("n", F.length("question")), "session", "n")
    items = entity_rows(spark, d).where("source_id is not null").select(F.concat("source_id", F.lit("_question36")).alias("key"), F.when(F.col("entity_row_id") % 4 == 0, "chunk").otherwise("entity").alias("res_type"), F.col("entity_row_id").alias("rank"), F.col("name").alias("content")).dropDuplicates(["rank"])
    memories = note_rows(spark, d, "session_id", "summary").where("session_id is not null and summary is not null").select(F.col("session_id").alias("session"), F.col("memory_id").alias("pos"), F.col("summary").alias("memory")).dropDuplicates(["pos"])
    chunk = table(spark, d, "text_chunks").where("full_doc_id is not null").groupBy(F.col("full_doc_id").alias("session")).agg(F.min("chunk_id").alias("chunk_id"))
    keyed = asked.join(chunk, "session").select(F.concat("chunk_id", F.lit("_question36")).alias("key"), "session", "question")
    out = evaluation.merged_questions(keyed, items, memories, {"chunk": 2, "entity": 3})
    return out.select("key", "session", "question", F.array_join("context", " | ").alias("context"), F.size("memories").cast("long").alias("n_memories"))


@query
def original_session_ids(spark, d):
    hits = table(spark, d, "memory_operations").where("operation_id is not null and new_memory_id is not null").select(F.col("operation_id").alias("question"), F.lower(F.trim("new_memory_id")).alias("doc")).distinct()
    mapping = note_rows(spark, d, "session_id").where("session_id is not null").select(F.col("memory_id").alias("doc"), F.col("session_id").alias("session")).groupBy("doc").agg(F.min("session").alias("session"))
    return evaluation.with_original_ids(hits, mapping).select("question", "doc", "session")


@query
def ignored_questions(spark, d):
    rows = sessions_of(spark, d).select(F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, "_abs").otherwise("")).alias("question"), sessions.has_answer(F.col("turns"), APRIL).alias("has_target"))
    return evaluation.ignored(rows, "has_target")


@query
def token_usage(spark, d):
    rows = note_rows(spark, d, "content", "summary").select(T.word_count(F.col("content")).alias("prompt_tokens"), F.when(F.col("summary").isNotNull(), T.word_count(F.col("summary"))).alias("completion_tokens"))
    return evaluation.token_usage(rows).select("prompt_tokens", "completion_tokens", "total_tokens", "calls")


@query
def store_stats(spark, d):
    return evaluation.store_stats(table(spark, d, "memory_operations").where("operation_id is not null").select("operation_id", "op_action").distinct())


# Prompts and external functions


def _contexts(spark, d):
    rows = note_rows(spark, d, "noted_at", "summary", "keywords").where("user_uuid is not null and summary is not null")
    items = rank.top_k(rows, ["user_uuid"], 5, "memory_id").select(F.col("user_uuid").alias("question"), "rank", F.col("noted_at").alias("ts"), F.lit("user").alias("role"), F.col("summary").alias("text"), F.col("keywords").alias("expansion"))
    return prompts.context(items, 5, merge="merge")


@query
def prompt_context(spark, d):
    return _contexts(spark, d)


@query
def numbered_context(spark, d):
    rows = rank.top_k(note_docs(spark, d).join(note_rows(spark, d, "noted_at").drop("user_uuid"), "memory_id"), ["user_uuid"], 5, "memory_id").withColumnRenamed("user_uuid", "question")
    return notes.formatted(rows, "content", "noted_at")


@query
def llm_cache_join(spark, d):
    rows = note_rows(spark, d, "summary").where("summary is not null").select(F.md5("summary").alias("key"), F.col("summary").alias("prompt"))
    cache = rows.where(F.col("key") < "8").select("key", F.lit("stored").alias("response"))
    return external.complete(rows, "key", "prompt", cache).select("key", "cached", F.when(F.col("cached"), F.col("response")).alias("stored"))


@query
def answer_pipeline(spark, d):
    asked = interests(spark, d).select("question", F.concat(F.lit("What does the user like? "), F.col("interests")).alias("text"))
    rows = _contexts(spark, d).join(asked, "question").select(F.col("question").alias("key"), prompts.answer_prompt(F.col("text"), F.col("context"), 60).alias("prompt"))
    empty = rows.select("key", F.lit("").alias("response")).where("false")
    return external.complete(rows, "key", "prompt", empty).withColumn("label", T.yes_label(F.col("response")))


# Streams


@query
def stream_action_counts(spark, d):
    """The stream run over all rows to its end; the complete result is a batch."""
    schema = table(spark, d, "memory_operations").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/memory_operations.[p]arquet")
    target = f"{shared_dir(spark)}/actions_{uuid.uuid4().hex[:8]}"
    counts = ingest.action_counts(stream.where("ingested_at is not null"), "ingested_at", "op_action", "30 days")
    run = counts.writeStream.outputMode("complete").foreachBatch(ingest.complete_table(f"{target}/table")).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{target}/table").select(F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "op_action", "n")
