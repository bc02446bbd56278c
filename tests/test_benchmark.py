"""The demonstration, benchmarks of files, the tools, and experiments on small rows."""

import json

import pytest

from arborix import benchmark, server
from arborix.config import EngineConfig
from arborix.engine import Engine
from arborix.operators import experiments


def test_demo(spark, tmp_path):
    out = benchmark.demo(spark, str(tmp_path))
    assert [(r["source_id"], r["target_id"]) for r in out["reinforced_edges"]] == [("orchid-house", "thermostat"), ("thermostat", "batteries")]
    assert all(r["new_weight"] > r["old_weight"] for r in out["reinforced_edges"])
    assert out["after"]["paths"][0]["contribution"] > out["before"]["paths"][0]["contribution"]


def test_benchmark_of_files(spark, tmp_path):
    nodes = [{"node_id": n, "text": t} for n, t, _, _ in benchmark.SAMPLE_NODES]
    edges = [dict(zip(("source_id", "target_id", "edge_type", "weight", "factuality"), e, strict=False)) for e in benchmark.SAMPLE_EDGES]
    path = [{"source_id": a, "target_id": b} for a, b in (("orchid-house", "thermostat"), ("thermostat", "batteries"))]
    cases = [{"id": "a", "cohort": "relation", "query": "orchids flower late by the wall", "expected_node_id": "batteries", "acceptable_rank": 5, "expected_path": path}, {"id": "b", "cohort": "direct_lookup", "query": "signs for visitors", "expected_node_id": "gravel-path", "acceptable_rank": 1}]
    (tmp_path / "f.json").write_text(json.dumps({"schema_version": 1, "nodes": nodes, "edges": edges}))
    (tmp_path / "g.json").write_text(json.dumps({"cases": cases}))
    out = benchmark.run_benchmark(spark, str(tmp_path / "f.json"), str(tmp_path / "g.json"))
    assert {r["query_id"]: r["matched"] for r in out["explanations"]} == {"a": True}
    assert {h["id"]: h["status"] for h in out["hypotheses"]}["H3"] == "supported"
    assert {r["query_id"]: r["graph_rank"] for r in out["cases"]}["b"] == 1


def test_tools(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), EngineConfig(use_dense_retrieval=False, dense_weight=0))
    ask = lambda tool, **given: json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": given}})
    codes = lambda *lines: [json.loads(x)["result"]["structuredContent"].get("code") for x in server.served(engine, lines)]
    assert codes(ask("search", query="x"), ask("search", query="x", limit=0), ask("search", query="x", more=1), ask("record_source_use", idempotency_key="k", trace_id="t", events=[["n", "eaten"]])) == ["empty_corpus", "invalid_argument", "invalid_argument", "invalid_argument"]
    engine.add_documents(benchmark.SAMPLE_NODES)
    listed, found, bad = (json.loads(x) for x in server.served(engine, ['{"id":1,"method":"tools/list"}', ask("search", query="gravel", limit=1), "{"]))
    assert [t["name"] for t in listed["result"]["tools"]] == list(server.TOOLS) and bad["error"]["code"] == -32700
    assert found["result"]["structuredContent"]["combined"]["hits"][0]["node_id"] == "gravel-path"


def test_arms_and_packets(spark):
    edges = spark.createDataFrame([("s", "t", "x", 0.5, 0), ("s", "u", "x", 0.5, 0)], "source_id string, target_id string, edge_type string, weight double, reinforced_count long")
    events = spark.createDataFrame([("s", "t", "x", i, str(i), "success", 1.0) for i in (1, 2, 3)], "source_id string, target_id string, edge_type string, seq long, trace_id string, kind string, credit double")
    at = spark.createDataFrame([(0, 0), (1, 1), (3, 3)], "checkpoint int, until long")
    out = experiments.replayed(edges, events, {"control": None, "siblings": EngineConfig(sibling_feedback_normalization=0.5)}, at)
    got = {(r.arm, r.checkpoint, r.target_id): round(r.weight, 6) for r in out.collect()}
    assert [got["siblings", c, t] for c in (0, 1, 3) for t in "tu"] == [0.5, 0.5, 0.7, 0.4, 1.1, 0.2]
    assert {w for (arm, _, _), w in got.items() if arm == "control"} == {0.5}
    cases = spark.createDataFrame([(1, "why", "n"), (2, "how", "m")], "case_id int, query string, expected_node_id string")
    hits = spark.createDataFrame([(1, "lexical", 1, "n", "text")], "case_id int, channel string, rank int, node_id string, text string")
    packets = {r.case_id: json.loads(r.packet) for r in experiments.packets(cases, hits).collect()}
    assert packets[2] == {"case_id": 2, "query": "how", "hits": []} and "expected_node_id" not in packets[1]


def test_gates(spark):
    row = lambda v, c, cohort, rank: (v, c, cohort, rank, 1, 1, True, True, True, True, True)
    rows = [row(v, c, cohort, r) for v, ranks in {"current": (1, 2, 1), "better": (1, 1, 1), "worse": (2, 1, 1)}.items() for c, cohort, r in zip("abc", experiments.COHORTS, ranks, strict=True)]
    results = spark.createDataFrame(rows, "variant_id string, case_id string, cohort string, rank int, expansions int, complexity int, path_matched boolean, isolated boolean, anchored boolean, edge_only boolean, recomputable boolean")
    gated = experiments.gates(experiments.variant_report(results), "fusion")
    assert {r.variant_id: r.passed for r in gated.collect()} == {"current": False, "better": True, "worse": False}
    assert experiments.chosen(gated, "fusion").first().variant_id == "better"
    assert experiments.chosen(gated.where("variant_id <> 'better'"), "fusion").first().variant_id == "current"


@pytest.mark.parametrize("name", list(server.TOOLS))
def test_schemas(name):
    assert server.schema(name)["additionalProperties"] is False
