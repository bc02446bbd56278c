"""An engine over a folder: documents, typed edges, searches and the feedback on them.

All state is in versioned Parquet tables that are only added to. Weights are what the ledger makes of the edges as they were
added and the events so far: feedback on a trace appends its events and folds the sources anew that it touches. A trace is
known by its id; it holds at most as many hits as its search was asked for."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.text import decayed
from .operators import channels, feedback, graph, judgments, ledger
from .sources import store

NODES = "node_id string, text string, confidence double, metadata map<string,string>"
EDGES = "source_id string, target_id string, edge_type string, weight double, factuality double, reinforced_count long"
STEP = "struct<source_id:string,target_id:string,edge_type:string,weight:double,factuality:double>"
HITS = f"trace_id string, channel string, query string, created_at double, rank int, node_id string, score double, paths array<struct<r:int,seed_id:string,contribution:double,steps:array<{STEP}>,kind:string>>"
EVENTS = "source_id string, target_id string, edge_type string, seq long, trace_id string, kind string, credit double, channel string"
USES = "trace_id string, node_id string, stage string, seq long"
REQUESTS = "idempotency_key string, operation string, payload_hash string, receipt string"
JUDGED = f"judgment_id string, seq long, action string, expected_revision int, statement string, rationale string, relations {judgments.RELATIONS}, provenance map<string,string>, successor_id string"
#: Stages of use in their order, outcomes, and the codes of errors (fixed values).
STAGES = ("retrieved", "selected", "validated", "used")
OUTCOMES = ("confirmed", "corrected", "rolled_back", "superseded")
CODES = ("unknown_trace", "node_not_in_trace", "invalid_stage_transition", "source_not_used", "idempotency_conflict", "empty_corpus", "invalid_argument", "unknown_node", "judgment_rejected")


class EngineError(ValueError):
    """An error with a code, as callers are to see it."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Trace:
    trace_id: str
    hits: list[Row]


class Engine:
    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig | None = None) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or EngineConfig()

    # ------------------------------------------------------------ tables

    def _next(self, name: str) -> int:
        return 1 + max(store.versions(self.spark, f"{self.folder}/{name}"), default=0)

    def _add(self, name: str, rows: DataFrame | list, schema: str) -> int:
        """Appends rows as a version of a table and returns its number."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        n = self._next(name)
        store.publish(df, f"{self.folder}/{name}", n)
        return n

    def _all(self, name: str, schema: str) -> DataFrame:
        """All versions of a table, with its number as v."""
        if not store.versions(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, v int")
        return self.spark.read.schema(f"{schema}, v int").parquet(f"{self.folder}/{name}")

    def add_documents(self, rows: DataFrame | list[tuple]) -> None:
        """rows(node_id, text, confidence, metadata); one with a known id takes its place."""
        self._add("nodes", rows, NODES)

    def add_edges(self, rows: DataFrame | list[tuple]) -> None:
        """rows(source_id, target_id, edge_type, weight, factuality, reinforced_count) between known documents."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, EDGES)
        for end in ("source_id", "target_id"):
            if not df.join(self.nodes().select(F.col("node_id").alias(end)), end, "left_anti").isEmpty():
                raise EngineError("unknown_node", f"an edge's {end} is no document")
        self._add("edges", df, EDGES)

    def nodes(self) -> DataFrame:
        added = store.latest(self._all("nodes", NODES), ["node_id"], "v").select("node_id", "text", "confidence")
        return added.unionByName(judgments.as_nodes(self.judgments())) if store.versions(self.spark, f"{self.folder}/judgments") else added

    def _base(self) -> DataFrame:
        added = store.latest(self._all("edges", EDGES), list(feedback.EDGE), "v").drop("v")
        if not store.versions(self.spark, f"{self.folder}/judgments"):
            return added
        live = self.judgments().where("lifecycle = 'active'").select("judgment_id")
        r = self.relations()
        for end in ("source_id", "target_id"):
            r = r.join(live.withColumnRenamed("judgment_id", end), end, "left_semi")
        r = r.select(*feedback.EDGE[:2], F.col("relation_type").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("factuality"), F.lit(0).cast("long").alias("reinforced_count"))
        return added.unionByName(r.join(added, list(feedback.EDGE), "left_anti"))

    def edges(self) -> DataFrame:
        """All edges with their weights as of now, and whether they sleep."""
        learned = store.latest(self._all("weights", "source_id string, target_id string, edge_type string, weight double, reinforced_count long, dormant boolean"), list(feedback.EDGE), "v")
        new = learned.select(*feedback.EDGE, F.col("weight").alias("w"), F.col("reinforced_count").alias("n"), "dormant")
        both = self._base().join(new, list(feedback.EDGE), "left")
        return both.select(*feedback.EDGE, F.coalesce("w", "weight").alias("weight"), "factuality", F.coalesce("n", "reinforced_count").alias("reinforced_count"), F.coalesce("dormant", F.lit(False)).alias("dormant"))

    def counts(self) -> dict[str, int]:
        traces = self._all("traces", HITS)
        return {
            "nodes": self.nodes().count(), "edges": self._base().count(),
            "retrievals": traces.select("trace_id").distinct().count(),
            "feedback": self._all("events", EVENTS).select("v").distinct().count(),
        }

    # ------------------------------------------------------------ searches

    def _visible(self) -> DataFrame:
        return graph.visible_edges(self.edges().where("not dormant").drop("dormant", "reinforced_count"))

    def _asked(self, query: str) -> tuple[DataFrame, DataFrame]:
        if not query.strip() or len(query) > 8192:
            raise EngineError("invalid_argument", "a query has 1 to 8192 characters")
        nodes = self.nodes().select("node_id", "text")
        if nodes.isEmpty():
            raise EngineError("empty_corpus", "there are no documents")
        return nodes, self.spark.createDataFrame([("q", query)], "query_id string, text string")

    def _traced(self, found: DataFrame, channel: str, score: str, query: str, now: float) -> Trace:
        name = uuid.uuid4().hex
        paths = F.col("paths").cast(HITS.split("paths ")[1]) if "paths" in found.columns else F.lit(None).cast(HITS.split("paths ")[1])
        hits = found.select(F.lit(name).alias("trace_id"), F.lit(channel).alias("channel"), F.lit(query).alias("query"), F.lit(float(now)).alias("created_at"), F.col("rank").cast("int").alias("rank"), "node_id", F.col(score).cast("double").alias("score"), paths.alias("paths"))
        n = self._add("traces", hits, HITS)
        return Trace(name, self._all("traces", HITS).where(F.col("v") == n).orderBy("rank").collect())

    def search(self, query: str, limit: int = 10, now: float | None = None) -> Trace:
        """The combined search; all that it activates is remembered."""
        if not 1 <= limit <= 100:
            raise EngineError("invalid_argument", "a limit is 1 to 100")
        nodes, asked = self._asked(query)
        now = time.time() if now is None else now
        scored = channels.scored(nodes, self._visible(), asked, self.config, limit)
        trace = self._traced(channels.best(scored, self.config), "combined", "final", query, now)
        live = scored.found.activation.where("activation > 0").select("node_id", F.col("activation").cast("double").alias("value"), F.lit(float(now)).alias("at"))
        self._add("activations", live, "")
        return trace

    def search_channels(self, query: str, limit: int = 10, now: float | None = None) -> dict[str, Trace]:
        """The lexical and the relation channel, a trace for each."""
        nodes, asked = self._asked(query)
        now = time.time() if now is None else now
        relation = channels.relation_channel(nodes, self._visible(), asked, self.config, limit)
        return {"lexical": self._traced(channels.lexical_channel(nodes, asked, limit), "lexical", "score", query, now), "relation": self._traced(relation, "relation", "score", query, now)}

    def activation(self, node_id: str, now: float) -> float:
        """A node's decayed activation; each search adds its own, up to the maximum."""
        if self.nodes().where(F.col("node_id") == node_id).isEmpty():
            raise EngineError("unknown_node", node_id)
        c = self.config
        rows = self._all("activations", "node_id string, value double, at double").where(F.col("node_id") == node_id)
        zero = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("at"))
        add = lambda s, x: F.struct(F.least(F.lit(c.maximum_activation), decayed(s.value, x.at - s.at, c.activation_half_life_seconds) + x.value).alias("value"), x.at.alias("at"))
        last = rows.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "value"))), zero, add).alias("x"))
        return last.select(decayed(F.col("x.value"), F.lit(float(now)) - F.col("x.at"), c.activation_half_life_seconds)).first()[0]

    # ------------------------------------------------------------ feedback

    def _trace(self, trace_id: str, used: list[str]) -> tuple[DataFrame, str]:
        hits = self._all("traces", HITS).where(F.col("trace_id") == trace_id)
        there = {r.node_id: r.channel for r in hits.select("node_id", "channel").collect()}
        if not there:
            raise EngineError("unknown_trace", trace_id)
        if missing := sorted(set(used) - set(there)):
            raise EngineError("node_not_in_trace", ", ".join(missing))
        return hits, next(iter(there.values()))

    def _learn(self, kind: str, trace_id: str, used: list[str]) -> list[Row]:
        """Appends the events of a trace's credited edges and folds their sources; the rows that changed."""
        hits, channel = self._trace(trace_id, used)
        nodes = self.spark.createDataFrame([(trace_id, n) for n in used], "query_id string, node_id string")
        paths = channels.credited_paths(hits.withColumnRenamed("trace_id", "query_id"), nodes)
        if kind == "success" and channel != "relation":
            kind = "plain"
        n = self._next("events")
        credit = feedback.edge_credit(paths).select(*feedback.EDGE, F.lit(n).cast("long").alias("seq"), "trace_id", F.lit(kind).alias("kind"), "credit", F.lit(channel).alias("channel"))
        self._add("events", credit, EVENTS)
        log = self._all("events", EVENTS).drop("v")
        new = log.where(F.col("seq") == n)
        touched = new.select("source_id").distinct()
        log = log.join(touched, "source_id", "left_semi")
        if self.config.relation_feedback_evidence_quorum > 1:
            due = feedback.quorum(log.where("kind = 'success'"), self.config.relation_feedback_evidence_quorum).where("activated")
            log = log.where("kind <> 'success'").unionByName(log.join(due.select(*feedback.EDGE, "trace_id", "seq"), [*feedback.EDGE, "trace_id", "seq"], "left_semi"))
        base = self._base().join(touched, "source_id", "left_semi")
        before = self.edges().join(touched, "source_id", "left_semi").select(*feedback.EDGE, F.col("weight").alias("old_weight"), F.col("dormant").alias("slept"))
        after = ledger.weights(ledger.fold(base, log, self.config))
        moved = before.join(after, list(feedback.EDGE)).where("old_weight <> weight or slept <> dormant")
        rows = moved.select(*feedback.EDGE, "old_weight", F.col("weight").alias("new_weight")).orderBy(*feedback.EDGE).collect()
        self._add("weights", after, "")
        return rows

    def record_success(self, trace_id: str, used: list[str]) -> list[Row]:
        """Edges that changed because a trace's nodes were of use, whatever the policy of outcomes is."""
        if not used:
            raise EngineError("invalid_argument", "no nodes were used")
        return self._learn("success", trace_id, used)

    def _once(self, key: str, operation: str, payload: dict, run) -> dict:  # noqa: ANN001
        """Runs a request once; an equal one gets the stored receipt, another under the same key is refused."""
        digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        for r in self._all("requests", REQUESTS).where(F.col("idempotency_key") == key).collect():
            if (r.operation, r.payload_hash) != (operation, digest):
                raise EngineError("idempotency_conflict", key)
            return json.loads(r.receipt)
        receipt = run()
        self._add("requests", [(key, operation, digest, json.dumps(receipt))], REQUESTS)
        return receipt

    def record_source_use(self, key: str, trace_id: str, events: list[tuple[str, str]]) -> dict:
        """Stages of a trace's nodes, one step at a time; all are taken or none. Nodes newly used teach, unless outcomes do."""

        def run() -> dict:
            self._trace(trace_id, [n for n, _ in events])
            uses = self._all("uses", USES).where(F.col("trace_id") == trace_id)
            at = {r.node_id: STAGES.index(r.stage) for r in store.latest(uses, ["node_id"], "seq").collect()}
            out, fresh = [], []
            for node, stage in events:
                if stage not in STAGES or not 0 <= STAGES.index(stage) - at.get(node, 0) <= 1:
                    raise EngineError("invalid_stage_transition", f"{node}: {STAGES[at.get(node, 0)]} to {stage}")
                changed = STAGES.index(stage) != at.get(node, 0)
                at[node] = STAGES.index(stage)
                out.append({"node_id": node, "stage": stage, "changed": changed})
                fresh += [node] if changed and stage == "used" else []
            n = 1000 * self._next("uses")
            self._add("uses", [(trace_id, e["node_id"], e["stage"], n + i) for i, e in enumerate(out)], USES)
            c, moved = self.config, []
            if fresh and not c.confirmed_outcome_reinforcement:
                moved = self._learn("used" if c.soft_start_feedback_reinforcement else "success", trace_id, fresh)
            return {"trace_id": trace_id, "events": out, "edges": [r.asDict() for r in moved]}

        return self._once(key, "record_source_use", {"trace_id": trace_id, "events": [list(e) for e in events]}, run)

    def record_outcome(self, key: str, trace_id: str, used: list[str], status: str, summary: str = "") -> dict:
        """What came of used nodes; it teaches if the policy says so, else it is kept for audits alone."""
        if status not in OUTCOMES or not used or len(summary) > 2000:
            raise EngineError("invalid_argument", "unknown outcome, no nodes, or a summary over 2000 characters")

        def run() -> dict:
            self._trace(trace_id, used)
            at = store.latest(self._all("uses", USES).where(F.col("trace_id") == trace_id), ["node_id"], "seq")
            if missing := sorted(set(used) - {r.node_id for r in at.where("stage = 'used'").collect()}):
                raise EngineError("source_not_used", ", ".join(missing))
            c = self.config
            taught = c.soft_start_feedback_reinforcement or c.confirmed_outcome_reinforcement
            moved = self._learn(status, trace_id, used) if (taught if status == "confirmed" else c.outcome_driven_feedback_deactivation) else []
            return {"trace_id": trace_id, "status": status, "edges": [r.asDict() for r in moved]}

        return self._once(key, "record_outcome", {"trace_id": trace_id, "used": sorted(used), "status": status, "summary": summary}, run)

    # ------------------------------------------------------------ judgments

    def _judged(self) -> DataFrame:
        return judgments.replayed(self._all("judgments", JUDGED).drop("v"))

    def judgments(self) -> DataFrame:
        return judgments.current(self._judged())

    def relations(self) -> DataFrame:
        return judgments.relations(self._judged())

    def write_judgment(
        self, judgment_id: str, action: str, statement: str = "", rationale: str = "", expected_revision: int | None = None,
        relations: list[tuple[str, str]] = (), provenance: dict[str, str] | None = None, successor_id: str | None = None,
    ) -> Row | None:
        """One event of a judgment's history, if it is allowed; the judgment as it then stands, or its successor.

        An add or an update sets all relations(target_id, relation_type); their targets must be there. To supersede needs
        the successor's id, text and relations: it is added, with a relation to its predecessor. A judgment that others
        relate to can't be deleted. What writes a text needs provenance, so that all that is written can be imported; all
        but an add need the revision that they build on, so that a stale writer is refused."""

        def refuse(bad: bool, why: str) -> None:
            if bad:
                raise EngineError("judgment_rejected", why)

        n, history, found = self._next("judgments"), self._all("judgments", JUDGED).drop("v"), sorted(set(relations))
        subject = successor_id if action == "supersede" else judgment_id
        writes = action in ("add", "update", "supersede")
        refuse(action not in ("add", "update", "supersede", "archive", "restore", "delete"), "unknown_action")
        refuse(subject is None or subject == judgment_id and action == "supersede", "successor_needed")
        refuse(writes and not (statement.strip() and rationale.strip()), "text_needed")
        refuse(writes and not provenance, "provenance_needed")
        refuse(action != "add" and expected_revision is None, "revision_needed")
        refuse(not re.fullmatch(judgments.ID, subject), "invalid_identity")
        refuse(len(found) < len(relations) or any(t == subject for t, _ in found), "invalid_relation")
        refuse(not all(re.fullmatch(judgments.ID, t) and re.fullmatch(judgments.RELATION, k) for t, k in found), "invalid_relation")
        text = (statement.strip(), rationale.strip())
        row = lambda j, a, r, text, links, heir: (j, n, a, r, *text, links, provenance, heir)
        if action == "supersede":
            heir = sorted({*found, (judgment_id, "supersedes")})
            events = [row(judgment_id, action, expected_revision, ("", ""), None, successor_id), row(successor_id, "add", None, text, heir, None)]
        else:
            events = [row(judgment_id, action, expected_revision, text, found if writes else None, None)]
        own = history.where(F.col("judgment_id").isin(judgment_id, subject)).unionByName(self.spark.createDataFrame(events, JUDGED))
        bad = judgments.replayed(own).where((F.col("seq") == n) & F.col("reject_code").isNotNull()).select("reject_code").first()
        refuse(bad is not None, bad.reject_code if bad else "")
        if found:
            wanted = {t for t, _ in found}
            refuse(self.judgments().where(F.col("judgment_id").isin(*wanted)).count() < len(wanted), "unknown_target")
        refuse(action == "delete" and not self.relations().where(F.col("target_id") == judgment_id).isEmpty(), "still_related")
        self._add("judgments", events, JUDGED)
        return self.judgments().where(F.col("judgment_id") == subject).first()

    def export_judgments(self) -> DataFrame:
        """All judgments as records, which import_judgments takes."""
        return judgments.exported(self._judged())

    def import_judgments(self, records: DataFrame) -> int:
        """Adds records (judgments.RECORD) all at once, as one version, or none; how many there were."""
        wrong = judgments.import_errors(records).orderBy("reason", "id").first()
        if wrong is not None:
            raise EngineError("judgment_rejected", f"{wrong.reason}: {wrong.id}")
        if not records.join(self.judgments().select("judgment_id"), "judgment_id", "left_semi").isEmpty():
            raise EngineError("judgment_rejected", "already_exists")
        self._add("judgments", judgments.import_events(records, self._next("judgments")), JUDGED)
        return records.count()

    def backup(self, folder: str) -> None:
        """All tables and their versions to a folder that must not be there yet; Engine(spark, folder) reads it. To
        restore, back up the backup."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path(folder)):
            raise FileExistsError(f"won't write over {folder}")
        source = path(self.folder)
        for table in source.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(source):
            name = table.getPath().getName()
            for v in store.versions(self.spark, f"{self.folder}/{name}"):
                store.publish(store.read(self.spark, f"{self.folder}/{name}", v), f"{folder}/{name}", v)


def replaced(engine: Engine, **settings: object) -> Engine:
    """The same tables under other settings."""
    return Engine(engine.spark, engine.folder, replace(engine.config, **settings))
