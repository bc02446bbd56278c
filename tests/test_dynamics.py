"""Recurrent strategies against a plain walk in Python, and the ledger against schedules worked out by hand."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arborix.config import STRATEGIES, EngineConfig
from arborix.operators import channels, dynamics, graph, ledger
from arborix.plans import experiments

EDGE = "source_id string, target_id string, edge_type string, weight double, factuality double"
RECURRENT = [s for s in STRATEGIES if s not in graph.HOP_BY_HOP]


def case(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    words = {n: {rng.choice("red blue dog cat tree".split()) for _ in range(2)} for n in names}
    edges = sorted({(a, b, rng.choice(["x", "red_of"])): (rng.uniform(0.2, 1.5), rng.uniform(0.5, 1)) for a in names for b in rng.sample(names, 3) if a != b}.items())
    return words, edges, {"n0": 0.9, "n4": 0.6}, {"red", "dog"}


def plain(strategy, c, words, edges, entry, query):
    """Activations by the rules: states are (node, walk) pairs, walks are lists of targets after the seed."""
    by_path, gated = strategy in dynamics.BY_PATH, strategy in dynamics.GATED
    states = [(n, v, (n,)) for n, v in entry.items()]
    room, steps = c.max_propagation_expansions, 0
    for _ in range(c.recurrent_steps):
        order = sorted(states, key=(lambda s: (-s[1], s[0], ">".join(s[2]))) if by_path else (lambda s: s[0]))
        sent = []
        for node, value, walk in order:
            offers = []
            for (a, b, kind), (w, f) in edges:
                if a != node or b in walk or room == 0:
                    continue
                seen = words[b] | set(kind.split("_"))
                gate = 0.4 + 0.6 * len(query & seen) / math.sqrt(len(query) * len(seen)) if gated else 1
                offers.append((value * w * f * c.hop_decay * gate, b, walk))
                room -= 1
            if strategy != "recurrent_competition" and offers:
                cut = c.inhibition_ratio * max(offers)[0] if len(offers) > 1 else 0
                offers = [(v - cut, b, p) for v, b, p in offers if v > cut]
                total = sum(o[0] for o in offers)
                offers = [(v * min(1, c.activation_budget * value / total), b, p) for v, b, p in offers]
            sent += offers
        if strategy == "recurrent_competition":
            total = sum(o[0] for o in sent)
            sent = [(v * min(1, c.activation_budget / total), b, p) for v, b, p in sent]
        steps += 1
        if by_path:
            new = defaultdict(list)
            for n, v, p in [(n, v * c.recurrent_decay, p) for n, v, p in states] + [(b, v, (*p, b)) for v, b, p in sent]:
                new[n].append((-v, ">".join(p), p))
            states = [(n, -v, p) for n, all_ in new.items() for v, _, p in sorted(all_)[: c.max_active_paths_per_node]]
        else:
            value, walk, best = defaultdict(float), {}, {}
            for n, v, p in states:
                value[n], walk[n] = v * c.recurrent_decay, p
            for v, b, p in sent:
                value[b] += v
                key = (v, p[0] if strategy == "recurrent_competition" else ">".join((*p, b)))
                if b not in best or key > best[b][0]:
                    best[b] = (key, (*p, b))
            walk |= {b: p for b, (_, p) in best.items()}
            top = max(value.values()) * c.inhibition_ratio if strategy == "recurrent_competition" else 0
            states = [(n, v - top, walk[n]) for n, v in value.items() if v > top]
        if room == 0:
            break
    out = defaultdict(float)
    for n, v, _ in states:
        out[n] += v
    if strategy in dynamics.ANCHORED:
        for n, v in entry.items():
            out[n] -= v * c.recurrent_decay**steps
    return {n: v for n, v in out.items() if v > 1e-15}


@pytest.mark.parametrize("strategy", RECURRENT)
@pytest.mark.parametrize("room", [10_000, 7])
def test_recurrent_strategies_follow_the_rules(spark, strategy, room):
    words, edges, entry, query = case(len(strategy))
    c = EngineConfig(activation_strategy=strategy, inhibition_ratio=0.1, recurrent_steps=3, max_active_paths_per_node=2, max_propagation_expansions=room)
    e = spark.createDataFrame([(*k, *v) for k, v in edges], EDGE)
    seeds = spark.createDataFrame([(1, n, v) for n, v in entry.items()], "query_id long, node_id string, entry double")
    q = spark.createDataFrame([(1, sorted(query))], "query_id long, query_tokens array<string>")
    t = spark.createDataFrame([(n, sorted(w)) for n, w in words.items()], "target_id string, target_tokens array<string>")
    got = dynamics.propagate(seeds, e, c, q, t)
    assert {r.node_id: r.activation for r in got.activation.collect()} == pytest.approx(plain(strategy, c, words, edges, entry, query))
    d = got.diagnostics.first()
    assert (d.stop_reason, d.expansions <= room) == ("recurrent_step_limit" if room > 7 else "max_expansions", True)


def test_a_hub_keeps_no_more_edges_than_walks_can_take(spark):
    e = spark.createDataFrame([("a", f"t{i:03d}", f"k{j:02d}", 0.5, 1.0) for i in range(60) for j in range(24)] + [("t000", "a", "x", 0.5, 1.0)], EDGE)
    c = EngineConfig(activation_strategy="local_neighbor_competition", recurrent_steps=3, max_propagation_expansions=50)
    at = dynamics.sliced(e, c)
    assert at.edges.where("node_id = 'a'").count() == 50 + 4 * 24  # 54 targets' edges, 1,296, before
    seeds = spark.createDataFrame([(1, "a", 1.0), (1, "t000", 1.0)], "query_id long, node_id string, entry double")
    got = dynamics.propagate(seeds, e, c)
    assert {r.generation.split("\0")[1] for r in got.paths.where("step = 1").collect()} == {"t000", "t001", "t002"}
    assert [tuple(r) for r in got.diagnostics.select("steps", "expansions", "stop_reason").collect()] == [(1, 50, "max_expansions")]


def test_hop_by_hop_expansions_end_in_the_order_of_a_walk(spark):
    e = spark.createDataFrame([("a", "c", "x", 1.0, 1.0), ("a", "b", "x", 1.0, 1.0), ("b", "d", "x", 1.0, 1.0)], EDGE)
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, node_id string, entry double")
    for room, nodes, why in ((1, "ab", "max_expansions"), (2, "abc", "max_expansions"), (9, "abcd", "max_hops")):
        got = dynamics.propagate(seeds, e, EngineConfig(max_propagation_expansions=room))
        assert "".join(sorted(r.node_id for r in got.activation.collect())) == nodes
        assert got.diagnostics.first().stop_reason == why


def test_disabled_graph_leaves_no_activation(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0, 1.0)], EDGE)
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id long, node_id string, entry double")
    got = dynamics.propagate(seeds, e, EngineConfig(use_graph_propagation=False, graph_weight=0))
    assert got.activation.count() == 0 and got.diagnostics.first().stop_reason == "graph_disabled"


def test_components_take_the_least_node(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "source_id string, target_id string")
    n = spark.createDataFrame([(x,) for x in "abcxyz"], "node_id string")
    assert {r.node_id: r.component for r in graph.components(e, n).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_channels_agree_and_credit_paths(spark):
    n = spark.createDataFrame([("a", "red cat"), ("b", "blue dog"), ("c", "blue cat")], "node_id string, text string")
    e = spark.createDataFrame([("a", "c", "x", 0.8, 1.0), ("c", "b", "x", 0.9, 1.0)], EDGE)
    q = spark.createDataFrame([(1, "red cat")], "query_id long, text string")
    c = EngineConfig(seed_count=1)
    left, right = channels.lexical_channel(n, q, 3), channels.relation_channel(n, e, q, c, 3)
    assert [r.node_id for r in left.orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r.node_id for r in right.orderBy("rank").collect()] == ["b", "c"]  # 0.529 and 0.42 after three steps
    assert channels.agreement(left, right).first().node_ids == ["b", "c"]
    used = spark.createDataFrame([(1, "b")], "query_id long, node_id string")
    assert [s.target_id for s in channels.credited_paths(right, used).first().steps] == ["c", "b"]
    hits = channels.search(n, e, q, c, 2).orderBy("rank").collect()
    assert [r.node_id for r in hits] == ["a", "c"] and hits[1].paths[0].kind == "graph"


def test_registered_agreement_runs_both_channels(spark, tmp_path):
    """Parts' names are asked of a graph of four nodes, in which one part leads to a supplier and that to a nation."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("part", [(1, "red cat"), (2, "blue dog")], "p_partkey long, p_name string")
    put("supplier", [(7, "red hat", 3)], "s_suppkey long, s_name string, s_nationkey long")
    put("nation", [(3, "north")], "n_nationkey long, n_name string")
    put("lineitem", [(1, 7, 0.0, 0.0)], "l_partkey long, l_suppkey long, l_discount double, l_tax double")
    got = {r.query_id: r.node_ids for r in experiments.channel_agreement(spark, str(tmp_path)).collect()}
    # all four nodes stand in the lexical channel (those without a term follow with 0); edges lead to two of them
    assert got == {"red cat": ["nation:3", "supplier:7"], "blue dog": ["nation:3", "supplier:7"]}
    lone = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, node_id string"), spark.createDataFrame([(1, "a"), (2, "c")], "query_id long, node_id string")
    assert {r.query_id: r.node_ids for r in channels.agreement(*lone).collect()} == {1: ["a"], 2: []}


ROWS = [("s", "t", "x", 0.5, 0), ("s", "u", "x", 0.4, 0)]
EVENT = "source_id string, target_id string, edge_type string, seq long, trace_id string, kind string, credit double"


def folded(spark, config, *events):
    edges = spark.createDataFrame(ROWS, "source_id string, target_id string, edge_type string, weight double, reinforced_count long")
    e = spark.createDataFrame([("s", "t", "x", i, t, k, 1.0) for i, (t, k) in enumerate(events)], EVENT)
    out = ledger.weights(ledger.fold(edges, e, config))
    return {r.target_id: (pytest.approx(r.weight), r.reinforced_count, r.dormant) for r in out.collect()}


def test_siblings_lose_what_an_edge_gained(spark):
    c = EngineConfig(sibling_feedback_normalization=0.5, feedback_learning_rate=0.2)
    assert folded(spark, c, ("1", "success"), ("2", "success")) == {"t": (0.9, 2, False), "u": (0.2, 0, False)}
    assert folded(spark, EngineConfig(maximum_edge_weight=0.5), ("1", "success")) == {"t": (0.5, 1, False), "u": (0.4, 0, False)}


SOFT = dict(soft_start_feedback_reinforcement=True, soft_start_feedback_ratio=0.25, confirmation_decay_ratio=0.5, outcome_driven_feedback_deactivation=True)


def test_soft_start_then_confirmation_then_reversal(spark):
    c, half = EngineConfig(**SOFT), [("1", "used")]
    assert folded(spark, c, *half) == {"t": (0.55, 1, False), "u": (0.4, 0, False)}
    assert folded(spark, c, ("1", "used"), ("2", "used"), ("1", "confirmed"), ("1", "confirmed")) == {"t": (0.7, 2, False), "u": (0.4, 0, False)}
    assert folded(spark, c, ("1", "used"), ("1", "confirmed"), ("2", "confirmed")) == {"t": (0.8, 3, False), "u": (0.4, 0, False)}
    assert folded(spark, c, ("1", "used"), ("1", "confirmed"), ("1", "corrected")) == {"t": (0.5, 0, False), "u": (0.4, 0, False)}
    assert folded(spark, c, ("1", "confirmed")) == {"t": (0.5, 0, False), "u": (0.4, 0, False)}


def test_superseded_edges_sleep_until_confirmed(spark):
    c = EngineConfig(**SOFT)
    assert folded(spark, c, ("1", "used"), ("1", "superseded"))["t"] == (0.55, 1, True)
    assert folded(spark, c, ("1", "used"), ("2", "superseded"))["t"] == (0.55, 1, False)
    assert folded(spark, c, ("1", "used"), ("1", "superseded"), ("2", "confirmed"))["t"] == (0.7, 2, False)


def test_confirmed_only_schedule(spark):
    c = EngineConfig(confirmed_outcome_reinforcement=True, confirmation_decay_ratio=0.5)
    assert folded(spark, c, ("1", "used"), ("1", "confirmed"), ("2", "confirmed"), ("2", "confirmed"))["t"] == (0.8, 2, False)


def test_steps_shuffle_no_states_by_query(spark, monkeypatch):
    """Of a step, messages are dealt to their queries once, and edges not at all; messages and states stay in their buckets."""
    plans, write = [], dynamics.dealt
    monkeypatch.setattr(dynamics, "dealt", lambda keys, *parts: (plans.append([p._jdf.queryExecution().executedPlan().toString() for p in parts]), write(keys, *parts))[1])
    words, edges, entry, query = case(3)
    seeds = spark.createDataFrame([(1, n, v) for n, v in entry.items()], "query_id long, node_id string, entry double")
    c = EngineConfig(activation_strategy="local_neighbor_path_competition", recurrent_steps=2)
    assert dynamics.propagate(seeds, spark.createDataFrame([(*k, *v) for k, v in edges], EDGE), c).activation.count() > 0
    first, left, states = plans[2][0], plans[2][1], plans[3][0]
    assert "SortMergeJoin" in first and first.count("Exchange hashpartitioning(query_id") == 1 and first.count("Exchange hashpartitioning(node_id") == 1
    assert "Exchange" not in states and "Exchange hashpartitioning" not in left


def test_a_gate_is_made_once_of_sets_and_a_query_is_sorted_once(spark):
    e = spark.createDataFrame([("a", "b", "red_of", 0.5, 1.0), ("a", "c", "x", 0.5, 1.0)], EDGE)
    t = spark.createDataFrame([("b", ["red", "dog", "dog"])], "target_id string, target_tokens array<string>")
    c = EngineConfig(activation_strategy="local_neighbor_query_competition")
    at = dynamics.sliced(e, c, t)
    assert {r.target_id: sorted(r.seen) for r in at.edges.collect()} == {"b": ["dog", "of", "red"], "c": ["x"]}
    state = spark.createDataFrame([(1, "a", 1.0, "a", [], "a", 1, 9, ["red"])], f"query_id long, node_id string, activation double, seed_id string, steps array<{dynamics.STEP}>, from string, copy int, left long, query_tokens array<string>")
    sent = dynamics._walked(state.join(at.sources, "node_id").withColumn("old", F.lit(0.0)), c)
    told = dynamics._messages(dynamics._proposals(sent, at, c), c)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "transform(" not in plan
    assert plan.count("Sort [query_id") == 2  # states in their order, and what they propose
    gates = {"b": 0.4 + 0.6 / math.sqrt(3), "c": 0.4}
    got = {r.node_id: r.value for r in told.collect()}
    assert got["b"] == pytest.approx(0.5 * 0.7 * (gates["b"] - c.inhibition_ratio * gates["b"])) and set(got) == {"b", "c"}


@pytest.mark.parametrize("strategy", ["recurrent_competition", "local_neighbor_path_competition"])
@pytest.mark.parametrize(("room", "steps"), [(10_000, 3), (5, 1)])
def test_states_of_the_last_step_carry_no_paths(spark, monkeypatch, strategy, room, steps):
    """Of the last step, or of that which uses up the expansions of all queries."""
    _, edges, entry, _ = case(3)
    seen = []

    def spied(keys, first, *parts):
        out = real(keys, first, *parts)
        seen.append((out[0], first.columns))
        return out

    real = dynamics.dealt
    monkeypatch.setattr(dynamics, "dealt", spied)
    c = EngineConfig(activation_strategy=strategy, recurrent_steps=3, max_propagation_expansions=room)
    e = spark.createDataFrame([(*k, *v) for k, v in edges], EDGE)
    q, t = spark.createDataFrame([(1, ["red"])], "query_id long, query_tokens array<string>"), spark.createDataFrame([("n1", ["red"])], "target_id string, target_tokens array<string>")
    dynamics.propagate(spark.createDataFrame([(1, n, v) for n, v in entry.items()], "query_id long, node_id string, entry double"), e, c, q, t)
    told, states = seen[2::2], seen[3::2]  # after edges and seeds
    assert len(states) == steps and [set(names) == {"query_id", "node_id", "activation", "old"} for _, names in states] == [False] * (steps - 1) + [True]
    assert [rows.where("not fresh and steps is not null").count() > 0 for rows, _ in told] == [True] * (steps - 1) + [False]
