"""The demonstration, the small evaluation, and benchmarks of a corpus with its expected answers."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .engine import EDGES, NODES, Engine
from .operators import channels, experiments, metrics
from .sources import store

#: A small corpus for the demonstration and for tests: a garden's notes. Links branch at the orchid house and at its
#: thermostat, and one note is reached from two sides.
SAMPLE_NODES = [
    ("orchid-house", "Orchids flower late in the house by the wall, where vents stay shut all night.", 1.0, {}),
    ("thermostat", "A wireless thermostat hangs above the second bench.", 1.0, {}),
    ("batteries", "Cells are swapped every tenth week by whoever has the early shift.", 1.0, {}),
    ("siren", "It rings below four degrees and wakes the lodge.", 1.0, {}),
    ("rain-barrels", "Barrels under the gutter feed drip lines among ferns.", 1.0, {}),
    ("gravel-path", "Visitors walk on gravel, past signs and three oaks.", 1.0, {}),
    ("pruning", "Roses are cut back when forsythia blooms.", 1.0, {}),
]
SAMPLE_EDGES = [
    ("orchid-house", "thermostat", "heated_with", 0.82, 0.97, 0),
    ("orchid-house", "rain-barrels", "watered_from", 0.36, 0.88, 0),
    ("thermostat", "batteries", "runs_on", 0.74, 0.99, 0),
    ("thermostat", "siren", "sets_off", 0.58, 0.92, 0),
    ("gravel-path", "orchid-house", "leads_to", 0.41, 0.96, 0),
    ("siren", "rain-barrels", "drains", 0.22, 0.79, 0),
    ("pruning", "gravel-path", "blocks", 0.31, 0.83, 0),
]
SAMPLE_CASES = [
    ("what keeps the house of late orchids warm", "thermostat"),
    ("who wakes up when it gets cold above the second bench", "siren"),
    ("signs for visitors", "gravel-path"),
    ("where orchids get water by night", "rain-barrels"),
]
#: Settings of the two compared searches; fixed values.
BASELINE = {"entry_weight": 1.0, "graph_weight": 0.0, "seed_count": 1, "max_hops": 2}
GRAPH = {"entry_weight": 0.25, "graph_weight": 0.75, "seed_count": 1, "max_hops": 2}


def demo(spark: SparkSession, folder: str) -> dict:
    """A search, a success, and the same search: what an edge learned and how its target's activation rose."""
    engine = Engine(spark, folder, EngineConfig(seed_count=1, max_hops=2))
    engine.add_documents(SAMPLE_NODES)
    engine.add_edges(SAMPLE_EDGES)
    query, target = "orchids flower late by the wall", "batteries"
    seen = lambda t: next({"rank": h.rank, "score": h.score, "paths": [p.asDict(True) for p in h.paths or ()]} for h in t.hits if h.node_id == target)
    first = engine.search(query, 5, now=1000.0)
    moved = engine.record_success(first.trace_id, [target])
    second = engine.search(query, 5, now=1002.0)
    return {"query": query, "target": target, "before": seen(first), "after": seen(second), "reinforced_edges": [r.asDict() for r in moved], "counts": engine.counts()}


def ranks(nodes: DataFrame, edges: DataFrame, cases: DataFrame, config: EngineConfig, limit: int) -> DataFrame:
    """cases(query_id, cohort, query, expected_node_id, acceptable_rank) with rank: all of them in one search."""
    hits = channels.search(nodes, edges, cases.select("query_id", F.col("query").alias("text")), config, limit)
    return metrics.expected_ranks(cases, hits, limit)


def compared(nodes: DataFrame, edges: DataFrame, cases: DataFrame, baseline: EngineConfig, graph: EngineConfig, limit: int) -> tuple[dict, DataFrame]:
    """Measures of both settings, how ranks move from one to the other, and cases with both ranks."""
    a, b = ranks(nodes, edges, cases, baseline, limit), ranks(nodes, edges, cases, graph, limit)
    rows = lambda df: [r.asDict() for r in df.collect()]
    both = a.withColumnRenamed("rank", "baseline_rank").join(b.select("query_id", F.col("rank").alias("graph_rank")), "query_id")
    return {"baseline_hybrid": rows(metrics.cohort_metrics(a)), "graph_integrated": rows(metrics.cohort_metrics(b)), "comparison": rows(metrics.rank_changes(a, b))}, both


CASES = "query_id string, cohort string, query string, expected_node_id string, acceptable_rank int"


def evaluate(spark: SparkSession, limit: int = 5) -> dict:
    nodes, edges = spark.createDataFrame(SAMPLE_NODES, NODES), spark.createDataFrame(SAMPLE_EDGES, EDGES)
    cases = spark.createDataFrame([(str(i), "relation", q, n, limit) for i, (q, n) in enumerate(SAMPLE_CASES)], CASES)
    out, both = compared(nodes, edges, cases, EngineConfig(**BASELINE), EngineConfig(**GRAPH), limit)
    return out | {"corpus_size": len(SAMPLE_NODES), "cases": len(SAMPLE_CASES), "improved_queries": both.where("graph_rank < baseline_rank").count()}


def run_benchmark(spark: SparkSession, fixture: str, gold: str) -> dict:
    """Measures, cases and hypotheses of a fixture and its gold file. Explanations hold if a case's expected path is among
    those shown; without expected paths they hold."""
    nodes, edges = store.fixture(spark, fixture)
    with open(gold, encoding="utf-8") as f:
        spec = json.load(f)
    known, own = {f.name for f in fields(EngineConfig)}, spec.get("benchmark", {})
    config = lambda name, other: EngineConfig(**{k: v for k, v in own.get(name, other).items() if k in known})
    limit, graph = own.get("limit", 10), config("graph_config", GRAPH)
    cases = spark.createDataFrame([(c["id"], c["cohort"], c["query"], c["expected_node_id"], c.get("acceptable_rank", limit)) for c in spec["cases"]], CASES)
    out, both = compared(nodes, edges, cases, config("baseline_config", BASELINE), graph, limit)
    wanted = [(c["id"], c["expected_node_id"], ">".join([c["expected_path"][0]["source_id"], *(s["target_id"] for s in c["expected_path"])])) for c in spec["cases"] if c.get("expected_path")]
    due = spark.createDataFrame(wanted, "query_id string, node_id string, due string")
    shown = channels.search(nodes, edges, cases.select("query_id", F.col("query").alias("text")), graph, limit).select("query_id", "node_id", F.transform("paths", lambda p: F.concat_ws(">", p.seed_id, F.transform(p.steps, lambda s: s.target_id))).alias("shown"))
    matched = due.join(shown, ["query_id", "node_id"], "left").select("query_id", F.coalesce(F.array_contains("shown", F.col("due")), F.lit(False)).alias("matched"))
    still = spark.createDataFrame([(0, 0, 0)], "changed_edges int, uncredited_edge_changes int, non_target_rank_changes int")
    rows = lambda df: [r.asDict() for r in df.collect()]
    return out | {"cases": rows(both), "explanations": rows(matched), "hypotheses": rows(experiments.hypotheses(both, matched, still))}
