"""Worked examples of the operators, by hand-made rows."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolake.config import QueryOptions, boolean, layered
from mnemolake.functions import text as T
from mnemolake.operators import chunks, community, corpus, dense, evaluation, external, graph, notes, prompts, rank, sessions, sparse
from mnemolake.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def metrics(spark, ranking, gold, ks):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranking)], "question string, doc string, rank int")
    g = spark.createDataFrame([("q", d) for d in gold], "question string, doc string")
    q = spark.createDataFrame([("q",)], "question string")
    return rows(evaluation.retrieval_metrics(r, g, q, ks))


def test_recall_and_ndcg(spark):
    order = ["s0", "s1", "s2", "s3", "s4"]
    got = metrics(spark, order, ["s1", "s3"], (2, 5))
    assert got[0][:4] == ("q", 2, 1, 0) and got[0][4] == pytest.approx(0.5)
    assert got[1][:4] == ("q", 5, 1, 1) and got[1][4] == pytest.approx(0.75)
    assert metrics(spark, order, [], (5,)) == [("q", 5, 0, 1, 0.0)]


def test_non_answer_ids(spark):
    turn = "array<struct<ts:string, role:string, content:string, has_answer:boolean>>"
    df = spark.createDataFrame([("answer_x", [("", "user", "a", None), ("", "assistant", "b", True)]), ("answer_y", [("", "assistant", "b", True)]), ("answer_z", [("", "user", "a", True)])], f"id string, turns {turn}")
    flag = lambda t: F.coalesce(t.has_answer, F.lit(False))
    out = df.select(sessions.renamed_non_answer(F.col("id"), F.col("turns"), flag).alias("n"), sessions.is_gold(F.col("id"), F.col("turns"), flag).alias("g"))
    assert [tuple(r) for r in out.collect()] == [("noans_x", True), ("noans_y", True), ("answer_z", True)]


def test_turns_and_renderings(spark):
    df = spark.createDataFrame([("[t1]user: Hello\n[t2]assistant: Hi\nnoise",), ("",), (None,)], "text string")
    t = sessions.parse_turns(F.col("text"), "\n")
    got = df.select(sessions.titled(t, F.lit("Ana")), sessions.judge_lines(t), sessions.graph_lines(t), sessions.user_lines(t)).collect()
    assert tuple(got[0]) == ("Ana: Hello\n\nAssistant: Hi", "[t1]user: Hello\n[t2]assistant: Hi\n", "t1user: Hello\nt2assistant: Hi\n", "Hello\n")
    assert tuple(got[1]) == ("", "", "", "") and got[2][0] is None


def test_ties_of_ranking(spark):
    df = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.9)], "q string, id string, s double")
    assert [r.id for r in rank.ranked(df, ["q"], F.desc("s"), "id").orderBy("rank").collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("budget,kept", [(11, 2), (9, 2), (8, 1), (0, 0)])
def test_budget_prefix(spark, budget, kept):
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate([3, 4, 2])], "q string, i int, n int")
    assert rank.budget_prefix(df, ["q"], ["i"], "n", budget).count() == kept


def test_views_and_means(spark):
    s = spark.createDataFrame([("x", "o")], "session string, text string")
    e = spark.createDataFrame([("x", "userfact", 0, "f1"), ("x", "userfact", 1, "f2"), ("x", "keyphrase", 0, "k"), ("x", "summ", 0, None)], "session string, kind string, pos long, text string")
    kinds = ["userfact", "keyphrase", "summ"]
    assert [r.text for r in corpus.merged_view(s, e, kinds).orderBy(F.desc("view")).collect()] == ["o", "f1 f2 k"]
    assert [r.text for r in corpus.merged_view(s, e, kinds, raw=True).collect()] == ["o f1 f2 k"]
    v = spark.createDataFrame([("x", "original", 0.2), ("x", "merged", 0.6)], "k string, view string, score double")
    assert rank.view_mean(v, ["k"]).first().score == pytest.approx(0.6)
    assert rank.view_mean(v, ["k"], raw_as_key=True).first().score == pytest.approx(0.4)
    n = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "k string, score double")
    assert rows(rank.component_mean(n, ["k"])) == [("a", 1.0), ("b", 0.0)]


def test_repeated_key_is_an_error(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        rank.assert_unique(df, ["k"]).collect()


def test_resolving_ids(spark):
    got = spark.createDataFrame([("q", "noans_7"), ("q", "answer_8")], "question string, doc string")
    known = spark.createDataFrame([("q", "noans_7"), ("q", "answer_7"), ("q", "noans_8")], "question string, doc string")
    assert {r.doc: r.resolved for r in rank.resolve_ids(got, known).collect()} == {"noans_7": "noans_7", "answer_8": "noans_8"}
    assert rank.resolve_ids(got, known, legacy=True).where("doc = 'noans_7'").first().resolved == "answer_7"


def test_bm25(spark):
    docs = spark.createDataFrame([("c", "d1", "the cat sat"), ("c", "d2", "the dog sat down"), ("c", "d3", "a bird flew")], "corpus string, doc string, text string")
    tokens = F.split("text", " ")
    post, stats = sparse.postings(docs, "corpus", "doc", tokens), sparse.corpus_stats(docs, "corpus", tokens)
    terms = sparse.term_stats(post, stats)
    for text, want in (("cat sat", {"d1": 0.601758, "d2": 0.058581}), ("bird bird", {"d3": 1.069792})):
        q = spark.createDataFrame([("q", "c", t) for t in text.split()], "question string, corpus string, term string")
        got = {r.doc: r.score for r in sparse.scores(post, stats, terms, q).collect()}
        assert got.keys() == want.keys()
        for d, s in want.items():
            assert got[d] == pytest.approx(s, abs=1e-6)


def test_window_chunks(spark):
    df = spark.createDataFrame([("d", list("abcdefghij")), ("e", [])], "id string, t array<string>")
    got = chunks.token_windows(df, "id", F.col("t"), 4, 1)
    assert [(r.tokens, r.content) for r in got.orderBy("chunk_order_index").collect()] == [(4, "a b c d"), (4, "d e f g"), (4, "g h i j"), (1, "j")]


@given(st.lists(st.sampled_from(["a", "b", "c.", "d"]), max_size=40), st.integers(3, 9), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_separator_chunks_keep_all_tokens(words, size, overlap):
    got = chunks.split_by_separators(words, {"."}, size, overlap)
    assert all(len(c) <= size for c in got)
    kept = [w for i, c in enumerate(got) for w in (c if i == 0 else c[min(overlap, len(got[i - 1])) :])]
    assert kept == words


def test_legacy_separator_chunks_lose_tokens():
    words = list("abcdef")
    got = chunks.split_by_separators(words, set(), 3, 1, legacy=True)
    assert got == [["a", "b", "c"], ["c", "d", "e"]]


def entities(spark, data):
    return spark.createDataFrame(data, "graph_id string, name string, type string, description string, source_id string, position int")


def test_node_merge(spark):
    e = entities(spark, [("g", "A", "PERSON", "d2", "c1", 1), ("g", "A", "EVENT", "d1", "c2", 2), ("g", "A", "EVENT", "d1", None, 3), ("g", "B", "EVENT", None, "c1", 5), ("g", "B", "PERSON", None, "c1", 4)])
    got = {r.name: r for r in graph.merge_nodes(e, "position").collect()}
    assert got["A"].type == "EVENT" and got["A"].descriptions == ["d1", "d2"] and got["A"].source_ids == ["c1", "c2"]
    assert got["B"].type == "PERSON"  # a tie goes to the first seen
    twice = {r.name: (r.descriptions, r.source_ids) for r in graph.merge_nodes(e.union(e), "position").collect()}
    assert twice == {k: (r.descriptions, r.source_ids) for k, r in got.items()}


def relations(spark, data):
    return spark.createDataFrame(data, "graph_id string, src string, tgt string, weight double, ord int, description string, source_id string")


def test_edge_merge_degree_and_endpoints(spark):
    r = relations(spark, [("g", "B", "A", 2.0, 2, "x", "c1"), ("g", "A", "B", 3.0, None, "y", "c2"), ("g", "C", "C", None, 1, None, None)])
    e = graph.merge_edges(r)
    assert rows(e.select("src", "tgt", "weight", "ord")) == [("A", "B", 5.0, 1), ("C", "C", 1.0, 1)]
    assert rows(graph.degrees(e).select("name", "degree")) == [("A", 1), ("B", 1), ("C", 2)]
    n = graph.merge_nodes(entities(spark, [("g", "A", "P", "d", "c1", 1)]), "position")
    assert rows(graph.missing_endpoints(e, n).select("name", "type")) == [("B", '"UNKNOWN"'), ("C", '"UNKNOWN"')]


def test_chunk_ranking(spark):
    e = entities(spark, [("g", "E0", "P", "", "c1", 1), ("g", "E0", "P", "", "c2", 2), ("g", "E1", "P", "", "c2", 3), ("g", "E1", "P", "", "c3", 4), ("g", "N1", "P", "", "c1", 5)])
    edges = graph.merge_edges(relations(spark, [("g", "E0", "N1", 1.0, 1, "", "c1"), ("g", "E0", "E1", 1.0, 1, "", "c2")]))
    seeds = spark.createDataFrame([("g", "E0", 0), ("g", "E1", 1)], "graph_id string, name string, entity_order int")
    units = graph.text_units(graph.relation_counts(seeds, graph.merge_nodes(e, "position"), edges))
    assert rows(units.select("chunk_id", "entity_order", "relation_count")) == [("c1", 0, 1), ("c2", 0, 1), ("c3", 1, 0)]
    assert [r.chunk_id for r in graph.rank_chunks(units, "entity_count").orderBy("rank").collect()] == ["c1", "c2", "c3"]
    assert graph.ranking_of(["entity", "rank-count-vector"]) == "count_vector" and graph.ranking_of(["chunk"]) == "entity_count"


def test_community_schema(spark):
    m = spark.createDataFrame([("g", "k1", "A", ["c1", "c2"]), ("g", "k1", "B", ["c3", "c4"]), ("g", "k2", "C", ["c1", "c2"])], "graph_id string, cluster string, name string, source_ids array<string>")
    e = graph.merge_edges(relations(spark, [("g", "A", "B", 1.0, 1, "", "c1")]))
    got = {r.cluster: (r.n_nodes, r.n_edges, r.n_chunks, r.occurrence) for r in graph.community_schema(m, e).collect()}
    assert got == {"k1": (2, 1, 4, 1.0), "k2": (1, 0, 2, 0.5)}


def test_components_and_communities(spark):
    chain = [("g", f"n{i:02d}", f"n{i + 1:02d}", 1.0, 1, "", "") for i in range(20)]
    e = graph.merge_edges(relations(spark, [*chain, ("g", "x", "y", 1.0, 1, "", ""), ("h", "n05", "z", 1.0, 1, "", "")]))
    got = {(r.graph_id, r.name): r.component for r in community.components(e).collect()}
    assert {v for (g, n), v in got.items() if g == "g" and n[0] == "n"} == {"n00"}
    assert got["g", "y"] == "x" and got["h", "z"] == "n05"
    assert community.largest_component(e).where("graph_id = 'g'").count() == 21
    two = [("g", a, b, 1.0, 1, "", "") for group in ("abcd", "efgh") for i, a in enumerate(group) for b in group[i + 1 :]] + [("g", "d", "e", 0.1, 1, "", "")]
    e = graph.merge_edges(relations(spark, two))
    for labels in (community.communities(e).withColumnRenamed("community", "c"), community.hierarchy(e).where("level = 0").withColumnRenamed("cluster", "c")):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.c, set()).add(r.name)
        assert sorted(map(sorted, groups.values())) == [list("abcd"), list("efgh")]


def test_hierarchy_in_one_task_and_in_all(spark):
    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i + 1, n)]
    pairs = clique("a", 5) + clique("b", 6) + clique("c", 4) + [("a0", "b0"), ("b1", "c0"), ("x", "y")]
    e = graph.merge_edges(relations(spark, [("g", a, b, 1.0, 1, "", "") for a, b in pairs]))
    for local in (1000, 0):
        found = community.hierarchy(e, 4, local).cache()
        groups = {}
        for r in found.where("level = 0").collect():
            groups.setdefault(r.cluster, []).append(r.name)
        assert sorted(map(sorted, groups.values())) == [sorted({n for p in clique(k, m) for n in p}) for k, m in (("a", 5), ("b", 6), ("c", 4))]
        assert rows(community.invariants(found, e, 4)) == [("g", 15, True, True, True)]


def test_more_than_the_first_reports(spark):
    """The cut comes before the rating: a report rated well behind it is not seen."""
    df = spark.createDataFrame([("g", i, float(-i), 1.0 if i < 600 else 9.0) for i in range(620)], "graph_id string, report_id int, occurrence double, rating double")
    assert graph.support_points(df, 0.0).count() == 512 and graph.support_points(df, 5.0).count() == 0


def test_groups_that_hold_half_of_the_rows(spark):
    """Positions, budgets and contexts of a hot user, against plain windows."""
    df = spark.createDataFrame([("hot" if i % 2 else f"u{i % 7}" if i % 13 else None, f"{i * 7919 % 1009:04d}", i % 5 + 1) for i in range(1009)], "user string, at string, n int").repartition(5)
    got = rank.spread(df, ["user"], ["at"], "n")
    want = {}
    for u in {r.user for r in df.collect()}:
        total = 0
        for k, r in enumerate(sorted((r for r in df.collect() if r.user == u), key=lambda r: r.at)):
            total += r.n
            want[u, r.at] = (k + 1, total)
    assert {(r.user, r["at"]): (r.position, r.running_n) for r in got.collect()} == want
    a, b = rank.budget_prefix_spread(df, ["user"], ["at"], "n", 60), rank.budget_prefix(df, ["user"], ["at"], "n", 60)
    assert a.select("user", "at", "running").exceptAll(b.select("user", "at", "running")).count() == 0 and a.count() == b.count() > 0
    items = df.where("user is not null").select(F.col("user").alias("question"), F.expr("row_number() over (partition by user order by at)").alias("rank"), F.col("at").alias("ts"), F.lit("user").alias("role"), F.col("at").alias("text"), F.lit("").alias("expansion"))
    assert prompts.context(items, 2).where("question = 'hot'").first().context.count("[") == 2
    assert rank.spread(df.limit(0), ["user"], ["at"]).count() == 0


def test_greedy_groups(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([9, 2, 2, 3, 1])], "g string, i int, n int")
    assert [r.group for r in graph.greedy_groups(df, "g", "i", "n", 5).orderBy("i").collect()] == [0, 1, 1, 2, 2]


def test_integrity(spark):
    df = spark.createDataFrame([(2, 0.5, False), (1, 1.0, False), (None, 0.5, False), (0, 1.0, True), (2, 1.0, True)], "score int, importance double, interference boolean")
    r = evaluation.integrity(df).first()
    assert (r.recall_all, r.recall_valid, r.weighted_all, r.weighted_valid, r.interference_accuracy) == pytest.approx((1 / 3, 1 / 2, 0.5, 2 / 3, 1 / 2))


def test_type_accuracy_and_routing(spark):
    i = spark.createDataFrame([("T", 2), ("T", None)], "memory_type string, score int")
    u = spark.createDataFrame([("T", "Correct")], "memory_type string, label string")
    r = evaluation.type_accuracy(i, u).first()
    assert (r.integrity_acc, r.update_acc, r.memory_acc) == pytest.approx((1 / 3, 1 / 3, 2 / 3))
    p = spark.createDataFrame([("True", []), ("True", ["m"]), ("true", ["m"]), ("True", None)], "is_update string, memories_from_system array<string>").withColumn("memory_source", F.lit(None).cast("string"))
    assert [x.bucket for x in evaluation.route(p).collect()] == ["integrity", "update", "integrity", "integrity"]


def test_unique_session_ids(spark):
    df = spark.createDataFrame([("e", "x", i) for i in range(3)], "entry string, session string, pos int")
    ids = [r.unique_id for r in sessions.unique_session_ids(df, "entry", "session", ["pos"]).orderBy("pos").collect()]
    assert ids[0] == "x" and len(set(ids)) == 3


def test_points(spark):
    df = spark.createDataFrame([("m", "a; b", "s", "k1; k2", None), ("n", None, " ", None, None)], "memory_id string, facts string, summary string, keywords string, content string")
    assert [r.point for r in notes.points(df).orderBy("pos").collect()] == ["a", "b", "s", "k1", "k2"]


def test_label_map_and_labels(spark):
    df = spark.createDataFrame([("s", "L", 0, "p"), ("s", "L", 1, "q"), ("s", "L", 2, "q")], "session string, label string, pos int, text string")
    assert corpus.label_map(df).first().text == "p q"
    y = spark.createDataFrame([("Yes, eyes",), ("No",)], "r string")
    assert [r[0] for r in y.select(T.yes_label(F.col("r"))).collect()] == [True, False]


def test_text_functions(spark):
    one = spark.createDataFrame([(" &lt;b&gt;\x07x ", "a|b, c|", "1.5", "s_1_2", '"q"', "Name: Ana Li; Gender: F", "1. eat\n# no\n\n- run")], "h string, m string, f string, t string, q string, p string, l string")
    r = one.select(T.clean_text(F.col("h")), T.split_markers(F.col("m"), ["|", ","]), T.is_float(F.col("f")), T.strip_turn(F.col("t")), T.strip_quotes(F.col("q")), T.name_of_persona(F.col("p")), T.clean_facts(F.col("l"))).first()
    assert tuple(r) == ("<b>x", ["a", "b", "c"], True, "s_1", "q", "Ana Li", ["eat", "run"])


def test_csv_lines_and_session_ids(spark):
    df = spark.createDataFrame([(" 'it''s' ", '"a "b" c"', 1.5, None, "see 12345678-ab_session3 and 12345678-ab_session_4")], "a string, b string, n double, z string, s string")
    line = T.csv_line([(F.col("a"), False), (F.col("b"), False), (F.col("n").cast("string"), True), (F.col("z"), False), (F.lit("7"), False)])
    r = df.select(line.alias("l"), T.session_ids_in(F.col("s")).alias("i")).first()
    assert r.l == '"it\'\'s",\t"a "b" c",\t1.5,\t"",\t"7"' and r.i == ["12345678-ab_session3"]


def test_records(spark):
    text = '("entity"<|>"ANA"<|>"person"<|>"d")##("relationship"<|>"ANA"<|>"BO"<|>"d"<|>high)##(entity<|>"C"<|>"x"<|>"d")<|COMPLETE|>'
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(F.explode(T.records_in(F.col("t"))).alias("f"))
    got = df.select(T.entity_of(F.col("f")).alias("e"), T.relationship_of(F.col("f")).alias("r")).collect()
    assert got[0].e.name == '"ANA"' and got[0].e.type == '"PERSON"' and got[1].r.weight == 1.0
    assert got[2].e is None and got[2].r is None


def test_json_salvage():
    assert json.loads(T.salvage('x {"a": {"b": 1}} y {"c": 2}')) == {"a": {"b": 1}}
    assert json.loads(T.salvage("{'action': create, \"n\": 3, flag: true}")) == {"action": "create", "n": 3, "flag": True}
    # Not a whole object: pairs of the whole text, nested ones as objects.
    assert json.loads(T.salvage('{"a": {"b": 1, c: x}, "d": [1, 2], e: "f, g"')) == {"a": {"b": 1, "c": "x"}, "d": [1, 2], "e": "f, g"}
    assert json.loads(T.salvage('{bad} then "k": 2, n: NULL')) == {"k": 2, "n": None}
    assert T.salvage("nothing") is None and T.salvage(None) is None


def test_dense_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<float>")
    got = dense.search(v, v.where("id = 0"), 2)
    assert [(r.id, round(r.score, 6)) for r in got.orderBy("rank").collect()] == [(1, 1.0), (3, round(math.sqrt(0.5), 6))]
    assert dense.search(v, v.where("id = 0"), 5, threshold=0.9).count() == 1
    assert dense.search(v, v.where("id = 9"), 5).count() == 0
    blocked = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, 1.0]) for i in range(60)], "id long, vec array<float>")
    whole = rows(dense.search(blocked, blocked.where("id % 3 = 0"), 4))
    held, dense.MAX_QUERY_VALUES, dense.VECTORS_OF_PART = (dense.MAX_QUERY_VALUES, dense.VECTORS_OF_PART), 20, 17
    try:
        assert [(q, i, n) for q, i, _, n in rows(dense.search(blocked, blocked.where("id % 3 = 0"), 4))] == [(q, i, n) for q, i, _, n in whole]
    finally:
        dense.MAX_QUERY_VALUES, dense.VECTORS_OF_PART = held
    m = spark.createDataFrame([("k", 0, [3.0, 0.0], True), ("k", 1, [0.0, 4.0], True), ("k", 2, [9.0, 9.0], False), ("z", 0, [0.0, 2.0], False)], "k string, pos int, vec array<float>, valid boolean")
    got = {r.k: [round(x, 6) for x in r.vec] for r in dense.masked_mean(m, "k", "vec", "valid", "pos").collect()}
    assert got == {"k": [0.6, 0.8], "z": [0.0, 1.0]}


def test_cache_keeps_hits_from_the_function(spark):
    df = spark.createDataFrame([("1", "known"), ("2", "new words here"), ("2", "new words here")], "key string, prompt string")
    cache = spark.createDataFrame([("1", "stored")], "key string, response string")

    def never_known(prompts_):
        if "known" in prompts_:
            raise ValueError("a hit was called")
        return [p.upper() for p in prompts_]

    got = {r.key: tuple(r)[1:] for r in external.complete(df, "key", "prompt", cache, never_known).collect()}
    assert got == {"1": ("stored", True, None), "2": ("NEW WORDS HERE", False, None)}

    def broken(prompts_):
        raise RuntimeError("down")

    assert external.complete(df, "key", "prompt", cache, broken).where("key = '2'").first().error == "down"

    def picky(prompts_):
        if any("bad" in p for p in prompts_):
            raise RuntimeError("bad prompt")
        return prompts_

    three = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "fine")], "key string, prompt string").coalesce(1)
    got = {r.key: (r.response, r.error) for r in external.complete(three, "key", "prompt", cache.limit(0), picky, attempts=2).collect()}
    assert got == {"a": ("good", None), "b": (None, "bad prompt"), "c": ("fine", None)}


def test_prompts(spark):
    df = spark.createDataFrame([("q", i + 1, ts, "user", f"t{i}", f"e{i}") for i, ts in enumerate(["3", "1", "2"])], "question string, rank int, ts string, role string, text string, expansion string")
    assert prompts.context(df, 2).first().context == "[1] 1\nt1\n\n[2] 3\nt0"
    assert prompts.context(df, 2, original=True, merge="replace").first().context == "[1] 1\ne1\n\n[2] 2\ne2"
    cut = df.select(prompts.answer_prompt(F.lit("q"), F.lit("one  two three"), 2).alias("p"), prompts.answer_prompt(F.lit("q"), F.lit("one  two"), 2).alias("w")).first()
    assert cut.p.startswith("Context:\none two\n\n") and cut.w.startswith("Context:\none  two\n\n")
    bad = spark.createDataFrame([("odd",)], "k string")
    with pytest.raises(Exception, match="unknown question type"):
        bad.select(prompts.judge_prompt(F.col("k"), F.lit(False), F.lit("q"), F.lit("a"), F.lit("r"))).collect()


def test_decision_fold(spark):
    df = spark.createDataFrame([("u", "1", "m1", "red cat"), ("u", "2", "m2", "red cat"), ("u", "3", "m3", None), ("u", "4", "m4", "red dog")], "user string, at string, memory_id string, text string")
    got = [(r.action, r.target_id, r.store_size) for r in notes.decision_fold(df, "user", "at").orderBy("op_index").collect()]
    assert got == [("create", None, 1), ("update", "m1", 1), ("pass", None, 1), ("create", None, 2)]


def test_note_store_counts_like_a_plain_comparison():
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    store, held = notes.NoteStore(), {}
    for step in range(1500):
        own = {words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(1, 9))}
        for most, least in ((5, 0.3), (2, 0.6), (3, 0.0)):
            each = [(len(own & w) / len(own | w), k) for k, w in held.items() if own & w]
            assert store.similar(own, least, most) == sorted((x for x in each if x[0] >= least), key=lambda x: (-x[0], x[1]))[:most]
        key = f"m{rng.randint(0, 1400)}"
        store.put(key, own)
        held[key] = held.get(key, set()) | own
    assert store.similar(set(), 0.3, 5) == [] and {k: set(w) for k, w in store.notes.items()} == held


def test_note_store_with_many_notes_of_common_words():
    import time

    store = notes.NoteStore()
    for i in range(20_000):
        store.put(f"m{i:05}", {*"the user likes to go out and see a".split(), f"a{i % 4000}", f"b{i % 700}", f"c{i % 90}"})
    began = time.process_time()
    for i in range(300):
        words = {*"the user likes to go out and see a".split(), f"b{i}", f"c{i % 80}", f"d{i}"}
        assert len(store.similar(words, 0.3, 5)) == 5
    # A comparison word by word takes over 6 s.
    assert time.process_time() - began < 3


def test_point_in_time_does_not_see_later_rows(spark):
    q = spark.createDataFrame([("u", "2")], "k string, at string")
    i = spark.createDataFrame([("u", "1"), ("u", "2")], "k string, item_at string")
    later = i.union(spark.createDataFrame([("u", "3")], "k string, item_at string"))
    assert rows(notes.as_of(q, i, "k", "at", "item_at")) == rows(notes.as_of(q, later, "k", "at", "item_at"))


def test_configuration():
    settings_ = {"TOP_K": "7", "QA_TOP_K": " ", "QA_THRESHOLD": "0.5"}
    assert layered("top_k", "qa", settings_) == "7"
    opts = QueryOptions().with_settings(settings_, "qa")
    assert (opts.top_k, opts.threshold) == (7, 0.5) and boolean("On") and not boolean(" ")
    with pytest.raises(ValueError):
        QueryOptions(mode=("nonsense",))


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question_id": "q", "haystack_session_ids": ["s"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "x"}]]}]))
    assert readers.detect(spark, str(tmp_path / "a.json")) == "array"
    t = readers.turns(readers.json_array(spark, str(tmp_path / "a.json"), readers.HAYSTACK)).first()
    assert (t.session_id, t.session_pos, t.turns[0].content) == ("s", 0, "x")
    (tmp_path / "b.jsonl").write_text('{"uuid": "u"}\n\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.USERS, tolerant=True).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.USERS).collect()
    (tmp_path / "c.json").write_text('{"k":\n "v", "n": null}')
    assert readers.detect(spark, str(tmp_path / "c.json")) == "map"
    (tmp_path / "l.json").write_text('{"a": "' + "x" * 2_000_000 + '"}\n\n{"a": "y"}\nbad\n')
    assert readers.detect(spark, str(tmp_path / "l.json")) == "lines"
    assert rows(readers.json_map(spark, str(tmp_path / "c.json")).where("key = 'k'")) == [("k", "v")]
    (tmp_path / "g.xml").write_text('<graphml><key id="d0" attr.name="weight"/><graph><node id="A"><data key="d0">1</data></node><edge source="A" target="B"><data key="d0">2</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.xml"))
    assert nodes.first().name == "A" and edges.first().attrs == {"weight": "2"}
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    readers.write_keyed(df, str(tmp_path / "kv"), ["k"])
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 1


def test_streams(spark, tmp_path):
    from mnemolake.streaming import ingest

    df = spark.createDataFrame([("u", "m1", "red cat"), ("u", "m2", "red cat")], "user_uuid string, memory_id string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.note_stream(stream).writeStream.format("memory").queryName("notes_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("notes_out").select("memory_id", "action")) == [("m1", "create"), ("m2", "update")]
    write = ingest.snapshot_upsert(str(tmp_path / "out"), ["memory_id"])
    write(df, 0)
    write(df, 0)
    write(df.withColumn("text", F.lit("new")), 1)
    latest = ingest.latest_rows(spark.read.parquet(str(tmp_path / "out")), ["memory_id"])
    assert latest.count() == 2 and {r.text for r in latest.collect()} == {"new"}
