"""Judgments, corpus checks, tables, encoder and stream on small cases."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.config import EngineConfig
from arborix.functions.encode import encoded, hashed
from arborix.operators import corpus, feedback, judgments, metrics, selection
from arborix.sources import store
from arborix.streaming import feedback as stream

EVENT = "judgment_id string, seq long, action string, expected_revision int, statement string, rationale string"


def test_judgments_follow_their_life(spark):
    acts = [("a", "add", None), ("a", "update", 1), ("a", "update", 1), ("a", "restore", None), ("a", "archive", None), ("a", "update", 2), ("a", "restore", None), ("a", "supersede", 2), ("a", "archive", None), ("b", "update", None), ("b", "add", None), ("b", "add", None), ("b", "delete", None), ("b", "archive", None), ("b", "delete", None), ("c", "add", None)]
    df = spark.createDataFrame([(j, i, a, r, f"s{i}", "r") for i, (j, a, r) in enumerate(acts)], EVENT)
    h = judgments.replayed(df)
    want = [None, None, "revision_conflict", "no_change", None, "not_active", None, None, "superseded", "unknown_judgment", None, "already_exists", "not_archived", None, None, None]
    assert [r.reject_code for r in h.orderBy("seq").collect()] == want
    now = judgments.current(h)
    assert sorted((r.judgment_id, r.revision, r.lifecycle, r.statement) for r in now.collect()) == [("a", 2, "superseded", "s1"), ("c", 1, "active", "s15")]
    assert judgments.as_nodes(now).first().text == "s15\n\nr"
    rel = spark.createDataFrame([("c", "zz", "x"), ("c", "c", "supersedes")], "source_id string, target_id string, relation_type string")
    assert sorted((r.reason, r.id) for r in judgments.audit(now, rel).collect()) == [("dangling_target_id", "c>zz>x"), ("successor_of_unsuperseded", "c"), ("superseded_without_successor", "a")]


def test_chains_end_and_cycles_have_no_tip(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", None), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame(rows, "packet_id string, supersedes string")
    assert {r.packet_id: r.tip for r in judgments.chain_tips(df, 4).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d"}


def test_hash_decisions(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("a\nb", sha("a\nb"), "raw_match"), ("a\nb", sha("a\r\nb"), "newline_equivalent_lf_to_crlf"), ("a\r\nb", sha("a\nb"), "newline_equivalent_crlf_to_lf"), ("ab", sha("x"), "rejected_no_newline_conversion"), ("a\rb\n", sha("x"), "rejected_bare_cr"), ("a\r\nb\n", sha("a\nb\n"), "rejected_mixed_newlines"), ("a\n", sha("x"), "rejected_hash_mismatch")]
    df = spark.createDataFrame(rows, "raw string, expected string, want string")
    assert df.where(corpus.hash_decision(F.col("raw"), F.col("expected")) != F.col("want")).count() == 0


def test_corpus_is_checked_before_it_is_loaded(spark):
    n = spark.createDataFrame([("a",), ("a",), ("b",)], "node_id string")
    e = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("b", "z", "x")], "source_id string, target_id string, edge_type string")
    assert sorted((r.reason, r.id) for r in corpus.rejected_rows(n, e).collect()) == [("dangling_target_id", "b>z>x"), ("duplicate_edge", "a>b>x"), ("duplicate_node", "a")]
    q = spark.createDataFrame([('{"a": {"score": 1}}', True), ('{"a": "score"}', False)], "j string, want boolean")
    assert q.where(corpus.forbidden_keys(F.col("j"), ["score", "answer"]) != F.col("want")).count() == 0


def test_sources_read_and_reject(spark, tmp_path):
    good = {"schema_version": 1, "nodes": [{"node_id": "a", "text": "t"}], "edges": [{"source_id": "a", "target_id": "a", "edge_type": "x", "weight": 1.0, "factuality": 0.5}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(good | {"schema_version": 2}))
    nodes, edges = store.fixture(spark, str(tmp_path / "good.json"))
    assert nodes.first().confidence == 1.0 and edges.first().factuality == 0.5
    with pytest.raises(Exception, match="unknown schema version"):
        store.fixture(spark, str(tmp_path / "bad.json"))[0].collect()
    pin = {"schema_version": 1, "repository": "o/r", "commit": "c", "documents": [{"path": "p.md", "blob_sha": "1", "content": "x", "source_url": "https://github.com/o/r/blob/c/p.md"}]}
    (tmp_path / "pin.json").write_text(json.dumps(pin))
    row = store.snapshot(spark, str(tmp_path / "pin.json")).first()
    assert (row.node_id, row.text) == ("github:o/r:p.md", "p.md\n\nx")
    pin["documents"][0]["source_url"] = "https://github.com/o/r/blob/main/p.md"
    (tmp_path / "loose.json").write_text(json.dumps(pin))
    with pytest.raises(Exception, match="must pin"):
        store.snapshot(spark, str(tmp_path / "loose.json")).collect()
    (tmp_path / "one.md").write_text("# a\n[b](b.md)")
    assert [tuple(r) for r in corpus.links(store.markdown(spark, str(tmp_path)), r"\]\(([^)]+)\)").collect()] == [("one.md", "b.md")]


def test_versions_are_written_once(spark, tmp_path):
    folder, df = str(tmp_path / "t"), spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, v int, w int")
    store.publish(df, folder, 0)
    with pytest.raises(Exception):
        store.publish(df, folder, 0)
    changes = spark.createDataFrame([("a", 3, None, 1), ("a", 4, None, 2), ("c", 9, 9, 1)], "k string, v int, w int, seq long")
    store.publish(store.upserted(store.read(spark, folder), changes, ["k"]), folder, 1)
    assert sorted(map(tuple, store.read(spark, folder).collect())) == [("a", 4, 5), ("b", 2, 6), ("c", 9, 9)]
    assert store.versions(spark, folder) == [0, 1] and store.read(spark, folder, 0).count() == 2
    one, two = (store.fingerprint(x, ["k"]).first() for x in (df, df.orderBy(F.desc("k")).coalesce(1)))
    assert one == two and one != store.fingerprint(store.read(spark, folder), ["k"]).first()


def test_encoder_by_batches_is_the_plain_one(spark):
    texts = ["Red cat, red dog", "", None, "Straße"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.v for r in df.select("i", encoded(F.col("text")).alias("v")).orderBy("i").collect()]
    for v, words in zip(got, (["red", "cat", "red", "dog"], [], [], ["strasse"])):
        assert v == hashed(words).tolist()
    assert np.linalg.norm(got[0]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        hashed(["a"], 4)


@pytest.mark.parametrize("ratio", [0.0, 0.5])
def test_stream_publishes_a_version_for_each_batch(spark, tmp_path, ratio):
    folder, source = str(tmp_path / "edges"), str(tmp_path / "in")
    edges = spark.createDataFrame([("s", "t", "x", 0.5, 0), ("s", "u", "x", 0.4, 0)], "source_id string, target_id string, edge_type string, weight double, reinforced_count long")
    store.publish(edges, folder, 0)
    kind = "source_id string, target_id string, edge_type string, seq long, trace_id string, kind string, credit double, idempotency_key string, at timestamp"
    e = spark.createDataFrame([("s", "t", "x", i, "1", "success", 1.0, k) for i, k in enumerate("aab")], kind.rsplit(",", 1)[0])
    e.withColumn("at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(source)
    for _ in range(2):
        stream.reinforce(spark.readStream.schema(kind).parquet(source), folder, EngineConfig(sibling_feedback_normalization=ratio), str(tmp_path / "c")).awaitTermination(120)
    got = {r.target_id: (pytest.approx(r.weight), r.reinforced_count) for r in store.read(spark, folder).collect()}
    assert got == {"t": (0.9, 2), "u": (0.4 if not ratio else 0.2, 0)}


def test_metrics_name_what_changed(spark):
    g = spark.createDataFrame([(0, "a", True), (1, "c", True), (2, "b", False)], "position int, name string, passed boolean")
    assert sorted(tuple(r) for r in metrics.failed_gates(g, ["a", "b", "b", "d"]).collect()) == [(1, "c", "out_of_order"), (2, "b", "failed"), (3, "d", "missing")]
    r = spark.createDataFrame([("k", 0, 2, 1.0, 1.0, 0), ("k", 1, 2, 1.0, 1.0, 1)], "case_id string, feedback_count int, rank int, normalised double, final double, changed_edges int")
    x = metrics.elasticity(r).first()
    assert (x.classification, x.fusion_side_ceiling) == ("edge_changed_but_rank_unchanged", True)
    h = spark.createDataFrame([("v", "a"), ("v", "a"), ("v", "b")], "k string, x string")
    assert metrics.histogram(h, "k", "x").first().counts == {"a": 2, "b": 1}


def test_activation_is_cut_at_each_event(spark):
    rows = [("a", 0.0, 1.0), ("a", 10.0, 1.0), ("a", 10.0, 0.5), ("a", 25.0, 0.1), ("b", 5.0, 0.3), ("b", 30.0, 5.0)]
    out = feedback.activation_history(spark.createDataFrame(rows, "node_id string, at double, value double"), F.lit(40.0), 10.0, 1.2)
    plain = {}
    for n, at, v in rows:
        x, last = plain.get(n, (0.0, at))
        plain[n] = (min(1.2, x * 0.5 ** ((at - last) / 10) + v), at)
    want = {n: x * 0.5 ** ((40.0 - at) / 10) for n, (x, at) in plain.items()}
    assert {r.node_id: r.activation for r in out.collect()} == pytest.approx(want)


def test_majorities_and_their_gates(spark):
    cases = spark.createDataFrame([(1, i, "relation" if i == 3 else "direct_lookup", "relation" if i == 3 else "lexical", f"n{i}", True, True) for i in (1, 2, 3)], "experiment int, case_id int, cohort string, intended string, expected_node_id string, in_union boolean, edges_unchanged boolean")
    vote = "experiment int, case_id int, judge_id int, channel string, node_id string, rank int, path_matched boolean"
    rows = [(1, i, j, "relation" if i == 3 else "lexical", f"n{i}", i, True) for i in (1, 2, 3) for j in (0, 1, 2)]
    agreed = spark.createDataFrame(rows, vote)
    for node_first in (False, True):
        made = selection.decided(agreed, cases, node_first)
        assert all(r.passed for r in selection.selection_gates(made, agreed, node_first).collect())
    r = selection.selection_report(selection.decided(agreed, cases)).first()
    assert (r.node_accuracy, r.unanimity, r.oracle_gap) == (1.0, 1.0, 0.0) and r.selected_mrr == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    # Case 1: two abstain. Case 2: one node by two channels. Case 3 has no votes.
    split = spark.createDataFrame([(1, 1, 0, "abstain", None, None, True), (1, 1, 1, "abstain", None, None, True), (1, 1, 2, "lexical", "n1", 1, True), (1, 2, 0, "lexical", "n2", 1, True), (1, 2, 1, "relation", "n2", 2, True), (1, 2, 2, "lexical", "x", 3, True)], vote)
    chosen = lambda f: {r.case_id: (r.has_majority, r.node_id) for r in selection.decided(split, cases, f).collect()}
    assert chosen(False) == {1: (False, None), 2: (False, None), 3: (False, None)}
    assert chosen(True) == {1: (False, None), 2: (True, "n2"), 3: (False, None)}
