"""Extraction, tokenizers, stores, evaluation inputs and query contexts on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import tokenizer
from mnemolake.operators import build, context, evaluation, graph, rank, retrieval, sessions
from mnemolake.sources import readers, stores


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_extraction_with_gleaning(spark):
    chunks = spark.createDataFrame([("c1", "one"), ("c1", "one"), ("c2", "fail"), ("c3", None)], "chunk_id string, content string")
    entity = lambda n: f'("entity"<|>"{n}"<|>"person"<|>"d")'

    def first(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no")
        return [entity("A") for _ in prompts]

    found = build.extract(chunks, first, 2, more=lambda ps: [entity(f"B{p.count('entity')}") for p in ps], goes_on=lambda ps: ['"Yes"' if "one" in p else "no" for p in ps])
    got = {}
    for r in found.collect():
        got.setdefault(r.chunk_id, []).append(r.e.name)
    # The answers so far are in the prompt of the next round; c2 failed first, then gave one.
    assert sorted(got["c1"]) == ['"A"', '"B1"', '"B2"'] and got["c3"] == ['"A"', '"B1"'] and got["c2"] == ['"B0"']
    assert build.extract(chunks.limit(0), first).count() == 0


def test_expansions_only_of_what_is_missing(spark):
    df = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s2", "y")], "session string, text string")
    held = spark.createDataFrame([("s1", "summary", "known")], "session string, kind string, text string")

    def function(prompts):
        assert not any(p == "S: x" for p in prompts)
        return [p.upper() for p in prompts]

    assert rows(build.expansions(df, {"summary": "S: ", "facts": "F: "}, held, function)) == [("s1", "facts", "F: X", None), ("s1", "summary", "known", None), ("s2", "facts", "F: Y", None), ("s2", "summary", "S: Y", None)]


def test_mapping_is_used_again(spark):
    df = spark.createDataFrame([("e1", "s", 1), ("e1", "s", 2), ("e1", "s", 3), ("e2", "s", 1), ("e2", "s", 2)], "entry string, session string, pos int")
    none = spark.createDataFrame([], "session string, n int, unique_id string")
    first = build.unique_ids_with_mapping(df, "entry", "session", ["pos"], none)
    mapping = build.mapping_of(first, "session")
    assert mapping.count() == 2  # the same new id for the same occurrence in both entries
    held = mapping.withColumn("unique_id", F.concat(F.lit("old_"), F.col("n").cast("string")))
    again = rows(build.unique_ids_with_mapping(df, "entry", "session", ["pos"], held).select("entry", "pos", "unique_id"))
    assert again == [("e1", 1, "s"), ("e1", 2, "old_2"), ("e1", 3, "old_3"), ("e2", 1, "s"), ("e2", 2, "old_2")]
    rank.assert_unique(first.select("entry", "unique_id"), ["entry", "unique_id"]).collect()


@pytest.mark.parametrize("make", [tokenizer.Words, lambda: tokenizer.BytePairs("/opt/tokenizers/byte_bpe_50k.tiktoken")])
def test_tokenizers(spark, make):
    coder = make()
    if isinstance(coder, tokenizer.BytePairs) and not os.path.exists(coder.path):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([("a", "The cat  sat.\nÜber 猫 "), ("b", ""), ("c", None)], "id string, text string")
    assert all(coder.decode(coder.encode(t)) == t for t in ("The cat  sat.\nÜber 猫 ", "", " x"))
    n = {r.id: r.n for r in df.select("id", tokenizer.count_tokens(F.col("text"), coder).alias("n")).collect()}
    assert n["a"] == len(coder.encode("The cat  sat.\nÜber 猫 ")) and n["b"] == 0 and n["c"] is None
    got = tokenizer.windows(df, "id", "text", coder, 4, 1).orderBy("chunk_order_index").collect()
    assert [r.tokens for r in got] == [min(4, n["a"] - i) for i in range(0, n["a"], 3)] and {r.id for r in got} == {"a"}
    cut = df.select(tokenizer.first_tokens(coder)(F.col("text"), 2).alias("t")).collect()
    assert cut[0].t == "The cat" and cut[1].t == "" and cut[2].t is None


def test_keyed_and_vector_stores(spark, tmp_path):
    store = stores.KeyedStore(spark, f"file://{tmp_path}/kv", ["k"])
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    assert store.read() is None and store.missing(first).count() == 3
    store.write(first)
    store.upsert(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"))
    store.upsert(store.read().where("k = 'a'"))  # reads what it replaces
    assert rows(store.read()) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(store.missing(spark.createDataFrame([("a", 0), ("z", 0)], "k string, v int"))) == [("z", 0)]
    vectors = stores.VectorStore(spark, f"file://{tmp_path}/vec")
    vectors.upsert(spark.createDataFrame([("x", [1.0, 0.0], "X"), ("y", [0.0, 1.0], "Y")], "id string, vec array<float>, name string"))
    vectors.upsert(spark.createDataFrame([("y", [1.0, 0.1], "Y2")], "id string, vec array<float>, name string"))
    got = vectors.query(spark.createDataFrame([("q", [1.0, 0.0])], "id string, vec array<float>"), 5)
    assert [(r.query, r.id, r["name"]) for r in got.orderBy("rank").collect()] == [("q", "x", "X"), ("q", "y", "Y2")]


def test_snapshots_and_files(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("l", 2, "c")], "k string, session int, v string")
    assert rows(stores.snapshot(df, "session", 2, ["k"])) == [("k", 1, "a"), ("l", 2, "c")]
    stores.write_map(spark.createDataFrame([("q1", ["a", "b"])], "q string, i array<string>"), "q", "i", f"file://{tmp_path}/map")
    assert rows(readers.json_lines(spark, f"file://{tmp_path}/map", "key string, items array<string>")) == [("q1", ["a", "b"])]
    for i, name in enumerate(("r1.json", "r2.json")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert stores.latest(spark, f"file://{tmp_path}", "r*.json").endswith("r2.json") and stores.latest(spark, f"file://{tmp_path}", "z*") is None


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([('"A&B"', {"type": "<person>"}), ("C", {})], "name string, attrs map<string, string>")
    edges = spark.createDataFrame([('"A&B"', "C", {"weight": "1.5"})], "src string, tgt string, attrs map<string, string>")
    stores.write_graphml(nodes, edges, f"file://{tmp_path}/g")
    n, e = readers.graphml(spark, f"file://{tmp_path}/g")
    assert sorted((r.name, dict(r.attrs)) for r in n.collect()) == [('"A&B"', {"type": "<person>"}), ("C", {})]
    assert [(r.src, r.tgt, dict(r.attrs)) for r in e.collect()] == [('"A&B"', "C", {"weight": "1.5"})]


def test_related_communities_and_budgets(spark):
    hits = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a")], "graph_id string, name string")
    clusters = spark.createDataFrame([("g", "a", 0, "x"), ("g", "b", 0, "x"), ("g", "a", 1, "y"), ("g", "b", 1, "z"), ("g", "a", 3, "deep"), ("g", "a", 1, "none")], "graph_id string, name string, level int, cluster string")
    reports = spark.createDataFrame([("g", "x", None, "X"), ("g", "y", 1.0, "Y"), ("g", "z", None, "Z"), ("g", "deep", 9.0, "D")], "graph_id string, cluster string, rating double, report string")
    got = context.related_communities(hits, clusters, reports)
    assert [(r.cluster, r.hits) for r in got.orderBy("rank").collect()] == [("x", 2), ("y", 1), ("z", 1)]
    assert context.related_communities(hits, clusters, reports, most=1).count() == 1
    ends = spark.createDataFrame([("g", "b", "a", 1), ("g", "a", "c", 2)], "graph_id string, src string, tgt string, hit int")
    assert [r["name"] for r in context.seeds_of_relations(ends).orderBy("hit").collect()] == ["b", "a", "c"]


def test_global_context_drops_points_without_worth(spark):
    grouped = spark.createDataFrame([("g", 0), ("g", 1), ("h", 0)], "graph_id string, group int")
    points = spark.createDataFrame([("g", 0, 1, "low", 1.0), ("g", 1, 1, "high one", 9.0), ("g", 1, 2, None, 9.0), ("g", 0, 2, "none", 0.0), ("g", 0, 3, "unrated", None)], "graph_id string, group int, point int, description string, score double")
    got = context.global_context(grouped, lambda g: points.join(g, ["graph_id", "group"], "left_semi")).collect()
    assert len(got) == 1 and got[0].n_points == 3 and got[0].context.startswith("----Analyst 1----\nImportance Score: 9.0\nhigh one\n\n----Analyst 0")
    assert context.global_context(grouped, lambda g: points, 3).first().n_points == 1


def test_description_leaves_out_what_sub_reports_hold(spark):
    e = graph.merge_edges(spark.createDataFrame([("g", a, b, 1.0, 1, "d", "s") for a, b in ("ab", "bc", "ac", "cd")], "graph_id string, src string, tgt string, weight double, ord int, description string, source_id string"))
    n = spark.createDataFrame([("g", x, "T", [f"is {x}"], ["s"]) for x in "abcd"], "graph_id string, name string, type string, descriptions array<string>, source_ids array<string>")
    members = spark.createDataFrame([("g", "k", x) for x in "abcd"], "graph_id string, cluster string, name string")
    known = members.where("name in ('a', 'b')")
    items = lambda df: sorted(r["item"] for r in df.collect())
    assert items(context.describe_communities(members, n, e)) == ["a", "a - b", "a - c", "b", "b - c", "c", "c - d", "d"]
    assert items(context.describe_communities(members, n, e, reported=known)) == ["a - c", "b - c", "c", "c - d", "d"]
    assert len(items(context.describe_communities(members, n, e, 10))) == 2


def test_evaluation_inputs(spark):
    points = spark.createDataFrame([("p1", " "), ("p2", "text"), ("p3", None)], "point_id string, extracted string")
    seen = []

    def judge(asked):
        seen.append(asked.count())
        return asked.select("point_id", F.lit(None).cast("int").alias("score"))

    assert sorted(tuple(r) for r in evaluation.judge_scores(points, judge).where("point_id <> 'p2'").collect()) == [("p1", 0), ("p3", 0)] and seen == [1]
    df = spark.createDataFrame([((1, "a"), ["x", "y"], 3)], "o struct<n:int, s:string>, l array<string>, t int")
    assert tuple(df.select(evaluation.memories_text(F.col("o"), "object"), evaluation.memories_text(F.col("l"), "list"), evaluation.memories_text(F.col("t"), "text")).first()) == ('{"n":1,"s":"a"}', "x;y", "3")
    answers, refs = spark.createDataFrame([("1", "a"), ("9", "z")], "q string, a string"), spark.createDataFrame([("1", "r"), ("2", "r")], "q string, r string")
    both, odd = evaluation.joined_answers(answers, refs, "q")
    assert rows(both) == [("1", "r", "a")] and rows(odd) == [("2", "missing"), ("9", "extra")]
    q = spark.createDataFrame([("a_abs", False), ("b", None), ("c", True)], "question string, has_target boolean")
    assert rows(evaluation.ignored(q, "has_target")) == [("abstention", 1), ("no_target", 2)]


def test_items_by_session_and_small_functions(spark):
    items = spark.createDataFrame([("n", ["12345678-ab_session3 x", "12345678-ab_Session3", "12345678-ab_session3"])], "name string, source_ids array<string>")
    assert sorted(r.session_id for r in context.items_by_session(items).collect()) == ["12345678-ab_Session3", "12345678-ab_session3"]
    df = spark.createDataFrame([("One. Two.", True), ("x", None)], "c string, flag boolean")
    assert [r.s for r in df.select(sessions.note_sentences(F.col("c")).alias("s")).collect()] == [["One.", "Two."], ["x."]]
    assert [r.s for r in df.select(sessions.not_generated(F.col("flag")).alias("s")).collect()] == [False, True]
    assert rows(graph.without_user(spark.createDataFrame([('"USER"',), ("ann",)], "name string"))) == [("ann",)]
    ranking = spark.createDataFrame([("q", "s1_2", 1), ("q", "s1_1", 2), ("q", "s2_1", 3)], "question string, doc string, rank int")
    assert rows(evaluation.turn_to_session_rank(ranking).select("session", "rank")) == [("s1", 1), ("s2", 2)]
    kept = retrieval.placeholder(F.col("c"))
    assert [tuple(r) for r in spark.createDataFrame([(" ",), ("t",), (None,)], "c string").select(kept[0], kept[1]).collect()] == [("[empty]", False), ("t", True), ("[empty]", False)]
    with pytest.raises(ValueError):
        retrieval.scores("none", df, df)
