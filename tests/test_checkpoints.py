"""Searches at checkpoints against a walk over plain lists; digests of versions against sets with counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborix.config import EngineConfig
from arborix.operators import checkpoints, experiments, snapshots
from arborix.sources.lineage import cut

EDGE = "source_id string, target_id string, edge_type string, "
ARMS, POINTS = ["none", "some"], [5, 0, 2]  # stated in any order
CASES = "case_id long, role string, target_id string, expected array<struct<source_id:string,target_id:string,edge_type:string>>"


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(4)
    names = "abcdefgh"
    edges = {(s, t, "x"): rng.choice([0.25, 0.5, 0.75]) for s in names for t in names if s != t and rng.random() < 0.5}
    moved = {(a, p, *e): rng.choice([0.0, 0.3, 0.9, edges[e]]) for e in edges for a in ARMS[1:] for p in POINTS if rng.random() < 0.4}
    seeds = [(i, names[i], 1.0) for i in range(6)] + [(0, "h", 0.5), (6, "nowhere", 1.0)]
    cases = []
    for i in range(7):
        s, t, _ = rng.choice(sorted(edges))
        target = t if i % 2 else rng.choice(names)
        cases.append((i, checkpoints.ROLES[i % 3], target, [(names[i], target, "x")]))
    return edges, moved, seeds, cases


def walked(edges, moved, seeds, cases, limit):
    """case, version -> [(node, activation, matched)] of the best nodes."""
    out = {}
    for case, _, _, expected in cases:
        for a in ARMS:
            for p in POINTS:
                weight = {e: moved.get((a, p, *e), w) for e, w in edges.items()}
                act, hit = Counter(), set()
                at = [([n], [], c) for i, n, c in seeds if i == case]
                for _ in range(2):
                    at = [([*path, e[1]], [*steps, e], c * w * 0.9 * 0.7) for path, steps, c in at for e, w in weight.items() if e[0] == path[-1] and e[1] not in path and w > 0]
                    for path, steps, c in at:
                        act[path[-1]] += c
                        if steps == expected:
                            hit.add(path[-1])
                best = sorted((-round(c, 12), n) for n, c in act.items())[:limit]
                out[case, a, p] = [(n, -c, n in hit) for c, n in best]
    return out


def test_searches_of_all_versions(spark, graph):
    edges, moved, seeds, cases = graph
    frame = spark.createDataFrame([(*e, w, 0.9) for e, w in edges.items()], EDGE + "weight double, factuality double")
    at = spark.createDataFrame([(*k, w) for k, w in moved.items()], f"arm string, checkpoint int, {EDGE}weight double")
    asked, due = spark.createDataFrame(seeds, "case_id long, node_id string, entry double"), spark.createDataFrame(cases, CASES)
    hits = checkpoints.shown(asked, due, frame, at, ARMS, POINTS, EngineConfig(max_hops=2), 3)
    want = walked(edges, moved, seeds, cases, 3)
    got = {k: [] for k in want}
    for r in hits.orderBy("rank").collect():
        got[r.case_id, r.arm, r.checkpoint].append((r.node_id, pytest.approx(r.activation, abs=1e-11), r.matched))
    assert got == want and not want[6, "none", 0]
    scored = {(r.case_id, r.arm, r.checkpoint): r for r in checkpoints.scores(hits, due, ARMS, POINTS, 3).collect()}
    assert scored.keys() == want.keys()
    before = {2: 0, 5: 2}
    for (case, arm, point), r in scored.items():
        shown, target = want[case, arm, point], cases[case][2]
        names = [n for n, *_ in shown]
        own = dict((n, a) for n, a, _ in shown).get(target, 0.0)
        assert r["rank"] == (names.index(target) + 1 if target in names else 4)
        assert r.margin == pytest.approx(own - max([a for n, a, _ in shown if n != target], default=0.0), abs=1e-11)
        assert r.matched == any(m for n, _, m in shown if n == target)
        old = [n for n, *_ in want[case, arm, before[point]]] if point in before else names
        assert r.entered == len(set(names) - set(old))
    assert {r.entered for r in scored.values()} > {0} and {r.matched for r in scored.values()} == {True, False}


def test_gates_fail_where_they_must(spark):
    rows = [("c", p, r, 0.5, True) for p in (0, 1, 2) for r in checkpoints.ROLES]
    rows += [("t", p, "headroom", m, True) for p, m in ((0, 0.2), (1, 0.1), (2, 0.4))]
    rows += [("t", p, "control", m, p < 2) for p, m in ((0, 0.5), (1, 0.5), (2, 0.4))]
    measured = spark.createDataFrame(rows, "arm string, checkpoint int, role string, mrr double, all_matched boolean")
    edges = spark.createDataFrame([("a", "b", "x", 0.5), ("a", "c", "x", 0.5)], EDGE + "weight double")
    at = [(arm, p, "a", t, "x", w) for arm, p, t, w in (("c", 1, "b", 0.5), ("c", 2, "b", 0.6), ("t", 1, "b", 0.7), ("t", 1, "c", 0.5), ("t", 2, "b", 0.7), ("t", 2, "c", 0.4))]
    moved = checkpoints.mutations(edges, spark.createDataFrame(at, f"arm string, checkpoint int, {EDGE}weight double"), spark.createDataFrame([(p, "a", "b", "x") for p in (1, 1, 2)], f"checkpoint int, {EDGE[:-2]}"))
    got = {(a, p, g): ok for a, p, g, ok in checkpoints.trajectory_gates(measured, moved, "c").collect()}
    g = checkpoints.GATES
    assert {k for k, ok in got.items() if not ok} == {("t", 1, g[2]), ("t", 2, g[3]), ("t", 2, g[0]), ("c", 2, g[6]), ("t", 2, g[7])}
    assert got["t", 2, g[1]] and got["t", 2, g[2]] and got["c", 2, g[5]] and not any(x == g[4] for *_, x in got)


def test_adaptation_against_its_control(spark):
    """Arm c loses a case that the control shows, and moves an edge that isn't credited; b shows no more than the control."""
    ranks = {"a": (2, 3, 4), "b": (1, 1, 4), "c": (4, 1, 1), "d": (2, 2, 2)}  # a is the control; limit 3
    rows = [(arm, 9, i, "headroom", r, r < 4) for arm, rs in ranks.items() for i, r in enumerate(rs)]
    rows += [("d", 1, i, "headroom", 4, False) for i in range(3)] + [("b", 9, 7, "control", 4, False)]
    scored = spark.createDataFrame(rows, "arm string, checkpoint int, case_id long, role string, rank int, matched boolean")
    moved = spark.createDataFrame([("a", 9, 0, False), ("b", 9, 1, True), ("c", 9, 2, False), ("d", 9, 1, True), ("a", 1, 5, False)], "arm string, checkpoint int, moved long, only_credited boolean")
    got = {r.arm: r for r in checkpoints.adaptation(scored, moved, "a", "headroom", 3).collect()}
    assert sorted(got) == ["b", "c", "d"]
    for arm, r in got.items():
        assert r.mrr == pytest.approx(sum(1 / x for x in ranks[arm]) / 3) and r.control_mrr == pytest.approx((1 / 2 + 1 / 3 + 1 / 4) / 3)
        assert r.recall == pytest.approx(sum(x < 4 for x in ranks[arm]) / 3) and r.control_recall == pytest.approx(2 / 3)
    assert [got[a].recall_kept for a in "bcd"] == [True, False, True]
    assert [got[a].paths_matched for a in "bcd"] == [False, False, True]
    assert [got[a].only_credited for a in "bcd"] == [True, False, True] and all(r.mrr_improved for r in got.values())


def test_searches_over_empty_tables(spark, graph):
    edges, _, seeds, cases = graph
    frame = spark.createDataFrame([(*e, w, 0.9) for e, w in edges.items()], EDGE + "weight double, factuality double")
    none = spark.createDataFrame([], f"arm string, checkpoint int, {EDGE}weight double")
    asked, due = spark.createDataFrame(seeds, "case_id long, node_id string, entry double"), spark.createDataFrame(cases, CASES)
    hits = checkpoints.shown(asked, due, frame.where("false"), none, ARMS, [0], EngineConfig(max_hops=2), 3)
    assert hits.count() == 0
    assert [tuple(r) for r in checkpoints.scores(hits, due, ARMS, [0], 3).select("rank", "margin", "entered").distinct().collect()] == [(4, 0.0, 0)]
    assert checkpoints.scores(hits, due.where("false"), ARMS, [0], 3).count() == 0


def test_versions_that_differ_are_located(spark):
    rows = [(i % 50, f"v{i % 7}", None if i % 5 == 0 else i % 3) for i in range(400)] + [(None, "", 1), (1, "2", None), (1, None, 2)]
    make = lambda x: spark.createDataFrame(x, "k long, a string, b long").repartition(3)
    assert snapshots.unequal(make(rows), make(rows[::-1]), ["k"], 8).count() == 0
    assert snapshots.unequal(make([(1, "1,2", None)]), make([(1, "1", 2)]), ["k"], 8).count() == 1
    changed = [*rows[3:], (None, "", 2), rows[5], rows[5], (900, None, None)]
    more = Counter(changed)
    more.subtract(Counter(rows))
    want = sorted((str(r), "after" if n > 0 else "before", abs(n)) for r, n in more.items() if n)
    got = snapshots.located(make(rows), make(changed), ["k"], 8).collect()
    assert sorted((str((r.k, r.a, r.b)), r.side, r.copies) for r in got) == want
    assert snapshots.located(make([]), make([(1, "x", 2)] * 3), ["k"], 8).first().copies == 3
    assert snapshots.unequal(make([]), make([]), ["k"], 8).count() == 0
    assert 0 < snapshots.unequal(make(rows), make([*rows, (3, "new", 1)]), ["k"], 8).count() == 1


def test_tasks_of_searches_stay_small(spark, monkeypatch):
    """Replays sort no journal for their last lines; what is cut for many searches is shuffled into as many tasks as are asked
    for, though Spark would put all rows into one; and few nodes that many paths lead to are no few tasks."""
    edges = spark.createDataFrame([("a", "b", "x", 0.5, 0)], EDGE + "weight double, reinforced_count long")
    events = spark.createDataFrame([("a", "b", "x", i, str(i), "success", 1.0) for i in range(3)], EDGE + "seq long, trace_id string, kind string, credit double")
    points = spark.createDataFrame([(0, -1), (9, 1)], "checkpoint int, until long")
    made = experiments.replayed(edges, events, {"none": None, "some": EngineConfig()}, points)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("MapInPandas")[0]
    assert {(r.arm, r.checkpoint): (round(r.weight, 9), r.reinforced_count) for r in made.collect()} == {("none", 0): (0.5, 0), ("none", 9): (0.5, 0), ("some", 0): (0.5, 0), ("some", 9): (0.9, 2)}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    few = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    assert len(cut(few, 7).inputFiles()) == 7 and len(cut(few, 1).inputFiles()) == int(before[0]) and len(cut(few).inputFiles()) == 1
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))
    asked = []
    monkeypatch.setattr(checkpoints, "cut", lambda df, tasks=0: asked.append(tasks) or cut(df, tasks))
    monkeypatch.setattr(checkpoints, "SEARCHES", 10)
    cases = spark.createDataFrame([(i, "control", "b", []) for i in range(20)], CASES)
    seeds = cases.select("case_id", F.lit("a").alias("node_id"), F.lit(1.0).alias("entry"))
    hits = checkpoints.shown(seeds, cases, edges.withColumn("factuality", F.lit(1.0)), made.where("false"), ["none"], [0, 9], EngineConfig(), 3)
    assert hits.count() == 40 and asked == [5]
