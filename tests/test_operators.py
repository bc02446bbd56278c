import math

import pytest
from pyspark.sql import functions as F

from arborix.config import EngineConfig
from arborix.functions import encode
from arborix.functions.encode import letters
from arborix.functions.text import tokens
from arborix.operators import channels, dense, feedback, graph, metrics, ranking, retrieval


def test_settings_are_checked():
    for bad in ({"seed_count": 0}, {"inhibition_ratio": 1.0}, {"sparse_weight": 0, "dense_weight": 0}, {"use_dense_retrieval": False}, {"final_fusion_strategy": "x"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_repeated_query_terms_count_again(spark):
    nodes = spark.createDataFrame([("a", "red red blue"), ("b", "blue"), ("c", "Green")], "node_id string, text string")
    once = spark.createDataFrame([(1, "red"), (2, "red RED")], "query_id long, text string")
    got = {(r.query_id, r.node_id): r.score for r in retrieval.bm25(nodes, once).collect()}
    idf, mean = math.log(1 + (3 - 1 + 0.5) / 1.5), 5 / 3
    one = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))
    assert got == {(1, "a"): pytest.approx(one), (2, "a"): pytest.approx(2 * one)}


def test_paths_are_simple_and_bounded(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.5, 1.0), ("b", "a", "x", 1.0, 1.0), ("b", "c", "x", 1.0, 0.5)], "source_id string, target_id string, edge_type string, weight double, factuality double")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, node_id string, entry double")
    c = EngineConfig()
    got = {r.node_id: r.activation for r in graph.activation(graph.paths(seeds, edges, c), c).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.35), "c": pytest.approx(0.35 * 0.35)}


def test_fusion_without_graph_rank_is_entry_alone(spark):
    entry = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5)], "query_id long, node_id string, entry double")
    act = spark.createDataFrame([(1, "b", 2.0)], "query_id long, node_id string, activation double")
    got = {r.node_id: r.final for r in ranking.fused(entry, act, EngineConfig(final_fusion_strategy="rrf")).collect()}
    assert got["a"] == pytest.approx(0.55 / 61)
    assert got["b"] == pytest.approx(0.55 / 62 + 0.45 * (1 / 61 - 1 / 62))


def test_confirmations_follow_a_geometric_schedule(spark):
    rows = [("s", "t", "x", i, i, 0.2, 0.5) for i in range(3)] + [("s", "t", "x", 0, 9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, trace_id long, seq long, increment double, weight double")
    r = feedback.confirmations(df, 0.5, 2.0).first()
    assert (r.n, r.new_weight) == (3, pytest.approx(0.5 + 0.2 * (1 + 0.5 + 0.25)))


def test_reversal_rebuilds_from_the_journal(spark):
    rows = [("s", "t", "x", 0.5, 2.0, 1.5, False), ("s", "t", "x", 0.5, 2.0, 0.1, True)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, baseline double, maximum double, delta double, active boolean")
    assert feedback.reversed_weights(df).first().new_weight == pytest.approx(0.6)


def test_replays_and_conflicts(spark):
    df = spark.createDataFrame([("k", 1, "h"), ("k", 2, "h"), ("k", 3, "g")], "idempotency_key string, seq long, payload_hash string")
    assert [r.outcome for r in feedback.replays(df).orderBy("seq").collect()] == ["run", "replay", "idempotency_conflict"]


def test_pareto_keeps_equals(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.5, 1.0)], "id string, x double, y double")
    assert sorted(r.id for r in metrics.pareto(df, ("x", "y")).collect()) == ["a", "b"]


def test_cosine_needs_vectors_of_one_size(spark):
    of = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(retrieval.cosine(F.col("a"), F.col("b"))).first()[0]
    assert of([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5) and of([0.0], [1.0]) == 0.0 and of([1.0], [-1.0]) == 0.0
    with pytest.raises(Exception, match="different sizes"):
        of([1.0], [1.0, 2.0])


def test_candidates_are_not_broadcast(spark, monkeypatch):
    plans, write = [], channels.cut
    monkeypatch.setattr(channels, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    nodes = spark.createDataFrame([("a", "red dog"), ("b", "blue cat"), ("c", "red cat")], "node_id string, text string")
    edges = spark.createDataFrame([("a", "b", "x", 0.5, 1.0)], "source_id string, target_id string, edge_type string, weight double, factuality double")
    queries = spark.createDataFrame([("q", "red dog")], "query_id string, text string")
    found = channels.search(nodes, edges, queries, EngineConfig(), 1, letters)
    assert [r.node_id for r in found.collect()] == ["a"]
    joins = [line for p in plans for line in p.splitlines() if "Join LeftAnti" in line]
    assert joins and all("rightHint=(strategy=merge)" in line for line in joins)
    tops = [line for line in plans[0].splitlines() if "Join Inner" in line and "query_id" in line]
    assert tops and "rightHint=(strategy=broadcast)" in tops[0]


def test_what_equals_the_share_is_inhibited_whatever_was_summed_first(spark):
    a, b, top = 0.01, 0.05, 0.6
    assert a + b > 0.1 * top  # by the last bit: the share of ten times their sum
    found = spark.createDataFrame([(1, "low", a), (1, "low", b), (1, "top", top), (1, "more", a + b + 1e-9)], "query_id long, node_id string, contribution double").repartition(1)
    got = graph.activation(found, EngineConfig(activation_strategy="lateral_inhibition", inhibition_ratio=0.1)).collect()
    assert sorted(r.node_id for r in got) == ["more", "top"]


def test_a_hop_is_one_shuffle_of_its_rows(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.5, 1.0), ("b", "a", "x", 1.0, 1.0), ("b", "c", "x", 1.0, 0.5), ("c", "d", "y", 1.0, 1.0)], "source_id string, target_id string, edge_type string, weight double, factuality double")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, node_id string, entry double")
    found = graph.paths(seeds, edges, EngineConfig(max_hops=3))
    got = {r.node_id: r for r in found.collect()}
    assert [(n, r.path, r.generation.split("\0")[1:], r.seed_id) for n, r in sorted(got.items())] == [("a", ["a"], [], "a"), ("b", ["a", "b"], ["b", "x"], "a"), ("c", ["a", "b", "c"], ["b", "x", "c", "x"], "a"), ("d", ["a", "b", "c", "d"], ["b", "x", "c", "x", "d", "y"], "a")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph.activation(found, EngineConfig())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "pmod(xxhash64" not in plan and "ReusedExchange" in plan  # before, parts of a query were shuffled first, and a hop once more for the next
    assert "row_number(), 10000, Partial" in plan  # tasks cut a query's rows before the shuffle


def test_scores_arise_over_all_partitions(spark):
    nodes = spark.range(400).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("red dog").alias("text"))
    queries = spark.createDataFrame([(i, "red dog") for i in range(50)], "query_id long, text string")
    got = retrieval.bm25(nodes, queries).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores")).collect()
    assert sum(r.n for r in got) == 20_000 and len(got) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one task before
    assert max(r.n for r in got) < 10_000


def test_many_texts_are_hashed_as_each_alone(spark):
    """Bit by bit, also where texts are short, empty or null, hold far code points, or fall into several chunks."""
    texts = ["", "a", "ab c", "Ab ab AB", None, "\U00020000\U00020001 x", "z" * 50, "one two three " * 30, "--", "äöü ß"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    made = rows.select("i", tokens(F.col("text")).alias("w"), encode.encoded(F.col("text")).alias("v"), encode.encoded(F.col("text"), encode.letters).alias("l")).collect()
    for r in made:
        assert r.v == encode.hashed(r.w or []).tolist() and r.l == encode.letters(r.w or []).tolist()
    words = ["_".join(r.w or []) for r in made]
    assert [x.tolist() for x in encode.hashed_rows(words)] == [r.v for r in made]
    assert sum(map(len, encode._chunks(["a" * (encode.CHUNK - 1)] * 3))) == 3 and len(list(encode._chunks(["a" * encode.CHUNK] * 3))) == 3


def test_gates_make_no_sets_of_steps(spark):
    """Two hops through a node whose tokens and type repeat, for queries with tokens, with repeated ones and with none."""
    edges = spark.createDataFrame([("a", "b", "to red", 0.5, 1.0), ("b", "c", "red red", 0.5, 1.0)], "source_id string, target_id string, edge_type string, weight double, factuality double")
    seeds = spark.createDataFrame([(i, "a", 1.0) for i in (1, 2, 3)], "query_id long, node_id string, entry double")
    asked = spark.createDataFrame([(1, ["red", "dog"]), (2, ["red", "red", "cat", "hat"])], "query_id long, query_tokens array<string>")
    named = spark.createDataFrame([("b", ["red", "dog", "dog"]), ("x", ["red"])], "target_id string, target_tokens array<string>")
    c = EngineConfig(activation_strategy="query_conditioned_transmission")
    found = graph.paths(seeds, edges, c, asked, named)
    floor, power = c.query_transmission_floor, c.query_transmission_power
    gate = lambda n, q, e: floor + (1 - floor) * (n / math.sqrt(q * e)) ** power
    want = {1: (gate(2, 2, 3), gate(1, 2, 1)), 2: (gate(1, 3, 3), gate(1, 3, 1)), 3: (floor, floor)}
    got = {(r.query_id, r.node_id): r.contribution for r in found.where("step > 0").collect()}
    for q, (one, two) in want.items():
        assert got[q, "b"] == pytest.approx(0.35 * one) and got[q, "c"] == pytest.approx(0.35**2 * one * two)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.index("seen") > 0


def test_texts_are_split_once_and_dealt(spark):
    """Counts of terms are written, and read by frequencies, corpus statistics and scores; nodes of one small file are no one task."""
    nodes = spark.createDataFrame([(i, "red dog" if i % 3 else "red cat") for i in range(60)], "node_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "red cat"), (2, "dog")], "query_id long, text string")
    posts, weights = retrieval.term_weights(nodes, asked)
    assert posts.inputFiles() and set(weights.inputFiles()) >= set(posts.inputFiles())
    assert posts.where("term = 'red'").count() == 60 and {(r.query_id, r.term) for r in weights.collect()} == {(1, "red"), (1, "cat"), (2, "dog")}
    lanes = dense.Lanes(nodes, asked)
    assert lanes.nodes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and lanes.nodes.count() == 60


def test_copies_of_a_text_stand_by_their_ids(spark, monkeypatch):
    """Scores of copies, as sums of the same terms in two orders gave them."""
    from arborix.plans import queries

    scores = spark.createDataFrame([(0, i, 10.776930138064104 if i < 2 else 10.776930138064106) for i in range(4)] + [(0, 9, 10.8)], "query_id long, node_id long, score double")
    monkeypatch.setattr(retrieval, "bm25", lambda nodes, asked: scores)
    best = queries.lexical_channel(spark, "/root/testdata/sf0.001").orderBy("rank").collect()
    assert [(r.node_id, r["rank"]) for r in best] == [(9, 1), (0, 2), (1, 3), (2, 4), (3, 5)]
    nodes, asked = scores.select("node_id", F.lit("red").alias("text")), spark.createDataFrame([(0, "red")], "query_id long, text string")
    assert [r.node_id for r in channels.lexical_channel(nodes, asked, 3).orderBy("rank").collect()] == [9, 0, 1]


def test_ranks_are_made_where_a_query_lies(spark, monkeypatch):
    """One shuffle by query, and none after it; a query of many rows, which is no one task's, gets the same ranks."""
    entry = spark.createDataFrame([(q, f"n{i}", [0.5, 1.0][i % 2]) for q in range(3) for i in range(4 + q)], "query_id long, node_id string, entry double")
    act = spark.createDataFrame([(q, f"n{i}", x) for q in range(3) for i, x in enumerate((0.0, 2.0, 0.4, 0.4 + 1e-15, 1e-12))] + [(2, "m", 3.0)], "query_id long, node_id string, activation double")
    for kind in ("max", "l1_mass", "none"):
        c = EngineConfig(final_fusion_strategy="rrf", graph_normalization=kind)
        monkeypatch.setattr(ranking, "LARGE", 1 << 20)
        one = ranking.fused(entry, act, c)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        shown = lambda df: {(r.query_id, r.node_id): r for r in df.select("query_id", "node_id", "re", "rg", "final").collect()}
        rows = shown(one)
        assert [rows[0, n].rg for n in ("n0", "n1", "n2", "n3", "n4")] == [None, 1, 2, 3, 5]  # to 9 digits n2 and n3 tie, and n4 and n0
        assert [rows[0, n].re for n in ("n1", "n3", "n0", "n2", "n4")] == [1, 2, 3, 4, 5]
        for most in (5, 0):  # some queries, all queries
            monkeypatch.setattr(ranking, "LARGE", most)
            assert shown(ranking.fused(entry, act, c)) == rows
