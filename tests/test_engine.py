"""The engine over a folder: searches, feedback, replays and judgments on a small graph."""

import pytest

from arborix.config import EngineConfig
from arborix.engine import Engine, EngineError, replaced
from arborix.sources import files

DOCS = [("source", "retry rules of payments", 1.0, {}), ("used", "a code change", 1.0, {}), ("unused", "a chart", 1.0, {})]
LINKS = [("source", "used", "leads", 0.5, 0.8, 0), ("source", "unused", "leads", 0.4, 0.7, 0)]

FROM = {"from": "a meeting"}


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), EngineConfig(seed_count=1, hop_decay=0.8, use_dense_retrieval=False, dense_weight=0))
    e.add_documents(DOCS)
    e.add_edges(LINKS)
    return e


def weights(e):
    return {r.target_id: r.weight for r in e.edges().collect()}


def test_search_and_success(engine):
    t = engine.search("retry payments", 3, now=100.0)
    assert [h.node_id for h in t.hits] == ["source", "used", "unused"]
    moved = engine.record_success(t.trace_id, ["used"])
    assert [(r.target_id, r.old_weight) for r in moved] == [("used", 0.5)]
    assert weights(engine) == {"used": pytest.approx(0.5 + 0.2 * 0.32), "unused": 0.4}
    assert engine.activation("source", 100.0) == pytest.approx(1.0) and engine.activation("source", 3700.0) == pytest.approx(0.5)
    with pytest.raises(EngineError, match="nothing"):
        engine.record_success("nothing", ["used"])


def test_use_outcome_and_replay(engine):
    e = replaced(engine, soft_start_feedback_reinforcement=True, soft_start_feedback_ratio=0.25, confirmation_decay_ratio=0.5, outcome_driven_feedback_deactivation=True)
    t = e.search_channels("retry payments", 3, now=1.0)["relation"].trace_id
    with pytest.raises(EngineError) as wrong:
        e.record_source_use("k0", t, [("used", "used")])
    assert wrong.value.code == "invalid_stage_transition"
    with pytest.raises(EngineError) as early:
        e.record_outcome("k9", t, ["used"], "confirmed")
    assert early.value.code == "source_not_used"
    steps = [("used", "selected"), ("used", "validated"), ("used", "used")]
    first = e.record_source_use("k1", t, steps)
    assert e.record_source_use("k1", t, steps) == first and len(first["edges"]) == 1
    with pytest.raises(EngineError) as conflict:
        e.record_source_use("k1", t, steps[:1])
    assert conflict.value.code == "idempotency_conflict"
    soft = weights(e)["used"]
    e.record_outcome("k2", t, ["used"], "confirmed")
    full = weights(e)["used"]
    assert 0.5 < soft < full and soft - 0.5 == pytest.approx((full - 0.5) / 4)
    e.record_outcome("k3", t, ["used"], "rolled_back")
    assert weights(e)["used"] == pytest.approx(0.5)


def test_judgments(engine):
    made = engine.write_judgment("j1", "add", "retry five times", "it failed less", provenance=FROM)
    assert (made.revision, made.lifecycle) == (1, "active")
    assert "j1" in {h.node_id for h in engine.search("failed less", 5, now=0.0).hits}
    with pytest.raises(EngineError, match="provenance_needed"):
        engine.write_judgment("j0", "add", "x", "y")
    for action in ("update", "supersede", "archive", "restore", "delete"):
        with pytest.raises(EngineError, match="revision_needed"):
            engine.write_judgment("j1", action, "x", "y", provenance=FROM, successor_id="j9")
    with pytest.raises(EngineError, match="revision_conflict"):
        engine.write_judgment("j1", "update", "x", "y", 3, provenance=FROM)
    with pytest.raises(EngineError, match="unknown_target"):
        engine.write_judgment("j2", "add", "use a queue", "bursts", relations=[("nobody", "supports")], provenance=FROM)
    engine.write_judgment("j2", "add", "use a queue", "bursts", relations=[("j1", "supports")], provenance=FROM)
    assert ("j2", "j1", "supports", 1.0) in {(e.source_id, e.target_id, e.edge_type, e.weight) for e in engine.edges().collect()}
    with pytest.raises(EngineError, match="already_exists"):
        engine.write_judgment("j1", "supersede", "retry six times", "less still", 1, successor_id="j2", provenance=FROM)
    heir = engine.write_judgment("j1", "supersede", "retry six times", "less still", 1, successor_id="j3", provenance=FROM)
    assert (heir.judgment_id, heir.revision, heir.lifecycle) == ("j3", 1, "active")
    assert {tuple(r) for r in engine.relations().collect()} == {("j2", "j1", "supports"), ("j3", "j1", "supersedes")}
    engine.write_judgment("j2", "update", "use a queue", "bursts, mostly", 1, relations=[("j3", "supports")], provenance=FROM)
    engine.write_judgment("j3", "archive", expected_revision=1)
    with pytest.raises(EngineError, match="still_related"):
        engine.write_judgment("j3", "delete", expected_revision=1)


def test_judgments_go_out_and_in(spark, engine, tmp_path):
    engine.write_judgment("a", "add", "s", "r", relations=[], provenance={"from": "x"})
    engine.write_judgment("a", "supersede", "t", "r", 1, successor_id="b", provenance={"from": "y"})
    out = engine.export_judgments()
    rows = sorted(map(str, out.collect()))
    assert {(r.judgment_id, r.lifecycle, r.superseded_by) for r in out.collect()} == {("a", "archived", "b"), ("b", "active", None)}
    other = Engine(spark, str(tmp_path / "other"))
    assert other.import_judgments(out) == 2
    assert sorted(map(str, other.export_judgments().collect())) == rows
    with pytest.raises(EngineError, match="already_exists"):
        other.import_judgments(out)
    with pytest.raises(EngineError, match="dangling_relation"):
        Engine(spark, str(tmp_path / "third")).import_judgments(out.where("judgment_id = 'b'"))
    with pytest.raises(EngineError, match="superseded"):
        other.write_judgment("a", "restore", expected_revision=1)
    other.backup(str(tmp_path / "copy"))
    assert sorted(map(str, Engine(spark, str(tmp_path / "copy")).export_judgments().collect())) == rows
    with pytest.raises(FileExistsError):
        other.backup(str(tmp_path / "copy"))


def test_settings_are_checked_and_named(tmp_path):
    for bad in ({"hop_decay": float("nan")}, {"maximum_activation": 0.0}, {"max_propagation_expansions": 0}, {"activation_budget": float("inf")}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    plain, other = EngineConfig(), EngineConfig(feedback_learning_rate=0.3)
    assert "soft_start_feedback_ratio" not in plain.effective()["feedback"] and "rrf_k" in plain.effective()["retrieval"]
    a, b = plain.fingerprints(), other.fingerprints()
    assert a["retrieval_config_fingerprint"] == b["retrieval_config_fingerprint"]
    assert a["feedback_config_fingerprint"] != b["feedback_config_fingerprint"] and a["full_config_fingerprint"] != b["full_config_fingerprint"]
    soft = EngineConfig(soft_start_feedback_reinforcement=True, soft_start_feedback_ratio=0.25, confirmation_decay_ratio=0.5)
    assert soft.effective()["feedback"]["soft_start_feedback_ratio"] == 0.25


def test_canonical_files(tmp_path):
    path = str(tmp_path / "deep" / "x.json")
    files.write_canonical(path, {"b": [1, "é"], "a": None})
    assert files.read_canonical(path) == {"a": None, "b": [1, "é"]}
    with pytest.raises(FileExistsError):
        files.write_canonical(path, {})
    for raw in (b'{"a":1}', b"[]\n", b"\xff", b'{\n  "b": 1,\n  "a": 2\n}\n'):
        (tmp_path / "y.json").write_bytes(raw)
        with pytest.raises(ValueError):
            files.read_canonical(str(tmp_path / "y.json"))
