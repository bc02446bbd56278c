"""The ledger of feedback: ordered events folded into edge weights, with siblings, soft start, reversal and dormancy.

Coupling never crosses a source, so rows are dealt by source_id and sorted by seq, and each task streams through its
sorted rows with the state of one source at a time. Without siblings and reversals, feedback.reinforced and
feedback.confirmations give the same weights as aggregates and should be used instead."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

#: "plain" is a success that leaves siblings alone.
KINDS = ("success", "plain", "used", "confirmed", "corrected", "rolled_back", "superseded")
JOURNAL = "source_id string, line long, seq long, trace_id string, kind string, role string, target_id string, edge_type string, old_weight double, new_weight double, reinforced_count long, dormant boolean"
COLUMNS = [c.split()[0] for c in JOURNAL.split(", ")]


@dataclass
class Contribution:
    trace: str
    edge: tuple
    lines: dict = field(default_factory=dict)
    active: bool = True


@dataclass
class Edge:
    weight: float
    count: int
    dormant: bool = False
    baseline: tuple | None = None
    base: float | None = None
    initial: float = 0.0
    cap: float = 0.0
    confirmed: int = 0


class Source:
    """The edges of one source and what feedback has done to them."""

    def __init__(self, config: EngineConfig) -> None:
        self.config, self.edges, self.journal, self.seen = config, {}, [], set()
        self.touching: dict[tuple, list[Contribution]] = {}

    def total(self, key: tuple) -> tuple[float, int]:
        live = [c for c in self.touching.get(key, ()) if c.active]
        return sum(c.lines[key] for c in live), sum(c.edge == key for c in live)

    def enter(self, trace: str, key: tuple, lines: dict, before: dict) -> None:
        """A contribution and its lines; nothing is journalled for what didn't move."""
        entry = Contribution(trace, key, {k: d for k, d in lines.items() if d})
        self.journal.append(entry)
        for k in entry.lines:
            e = self.edges[k]
            if e.baseline is None:
                e.baseline = before[k]
            self.touching.setdefault(k, []).append(entry)

    def rise(self, kind: str, trace: str, key: tuple, increment: float) -> float | None:
        """The new weight that an event gives an edge; None if it does nothing."""
        c, e = self.config, self.edges[key]
        if kind in ("success", "plain"):
            return max(e.weight, min(c.maximum_edge_weight, e.weight + increment))
        if kind == "used":
            if not c.soft_start_feedback_reinforcement or ("used", key, trace) in self.seen:
                return None
            self.seen.add(("used", key, trace))
            if e.base is not None:
                self.enter(trace, key, {}, {})
                return None
            e.base, e.initial = increment, e.weight
            e.cap = min(c.maximum_edge_weight, e.weight + increment / (1 - c.confirmation_decay_ratio))
            return max(e.weight, min(e.cap, e.weight + increment * c.soft_start_feedback_ratio))
        if ("confirmed", key, trace) in self.seen:
            return None
        e.dormant = False
        if e.base is None:
            if c.soft_start_feedback_reinforcement:
                return None
            e.base, e.initial = increment, e.weight
            e.cap = max(e.weight, min(c.maximum_edge_weight, e.weight + increment / (1 - c.confirmation_decay_ratio)))
        self.seen.add(("confirmed", key, trace))
        e.confirmed += 1
        if c.soft_start_feedback_reinforcement and e.confirmed == 1:
            return max(e.weight, min(e.cap, e.initial + e.base))
        return max(e.weight, min(e.cap, e.weight + e.base * c.confirmation_decay_ratio ** (e.confirmed - 1)))

    def raised(self, kind: str, trace: str, credits: list[tuple[tuple, float]]) -> Iterator[tuple]:
        """One request: credited edges rise; what they gained is taken, in part, off their siblings."""
        c, gains, before = self.config, {}, {}
        for key, credit in credits:
            if key not in self.edges:
                continue
            e = self.edges[key]
            slept, old = e.dormant, (e.weight, e.count)
            new = self.rise(kind, trace, key, c.feedback_learning_rate * credit)
            if new is None:
                if slept != e.dormant:
                    yield ("credited", key, e.weight, e.weight)
                continue
            before[key], gains[key] = old, new - e.weight
            e.weight, e.count = new, e.count + 1
            yield ("credited", key, old[0], new)
        total, lost = sum(gains.values()), {}
        if c.sibling_feedback_normalization > 0 and total > 0 and kind not in ("used", "plain"):
            keys = {k for k, _ in credits}
            spared = (lambda k: any(x.active for x in self.touching.get(k, ()))) if c.outcome_driven_feedback_deactivation else (lambda k: False)
            siblings = sorted(k for k, e in self.edges.items() if k not in keys and not e.dormant and not spared(k))
            for k in siblings:
                e = self.edges[k]
                new = max(0.0, e.weight - total * c.sibling_feedback_normalization / len(siblings))
                if new < e.weight:
                    before[k], lost[k] = (e.weight, e.count), e.weight - new
                    yield ("sibling", k, e.weight, new)
                    e.weight = new
        if kind not in ("success", "plain") and c.soft_start_feedback_reinforcement:
            for key, gain in gains.items():
                share = gain / total if total > 0 else 0.0
                self.enter(trace, key, {key: gain} | {k: -d * share for k, d in lost.items()}, before)

    def undone(self, kind: str, trace: str, keys: list[tuple]) -> Iterator[tuple]:
        """Reversal rebuilds edges from what is still active; superseded edges sleep."""
        if not self.config.outcome_driven_feedback_deactivation:
            return
        for key in sorted(keys):
            own = [x for x in self.journal if x.trace == trace and x.edge == key]
            if kind == "superseded":
                if own and key in self.edges and not self.edges[key].dormant:
                    self.edges[key].dormant = True
                    yield ("credited", key, self.edges[key].weight, self.edges[key].weight)
                continue
            for entry in [x for x in reversed(own) if x.active]:
                entry.active = False
                for k in sorted(entry.lines, key=lambda k: (k != key, k)):
                    e, (delta, count) = self.edges[k], self.total(k)
                    weight, n = e.baseline
                    new = min(max(weight, self.config.maximum_edge_weight), max(0.0, weight + delta))
                    old, e.weight, e.count = e.weight, new, n + count
                    yield ("credited" if k == key else "sibling", k, old, new)


def _requests(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows, and None where a source or a request ends."""
    last = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = (row.source_id, row.seq)
            if last is not None and key != last:
                yield None
            last = key
            yield row
    yield None


def fold(edges: DataFrame, events: DataFrame, config: EngineConfig) -> DataFrame:
    """The journal of edges(source_id, target_id, edge_type, weight, reinforced_count) under events(source_id, target_id,
    edge_type, seq, trace_id, kind, credit). Rows of one source and seq are one request of one kind; an edge stands in it
    once, with its greatest credit. The journal begins with a row of kind "edge" for each edge; an edge's last row holds
    its weight. Events of unknown edges are passed over: validation of whole requests comes before."""
    start = edges.select("source_id", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("trace_id"), F.lit("edge").alias("kind"), "target_id", "edge_type", F.col("weight").cast("double").alias("value"), F.coalesce(F.col("reinforced_count").cast("long"), F.lit(0)).alias("n"))
    e = events.groupBy("source_id", "seq", "target_id", "edge_type").agg(F.max("trace_id").alias("trace_id"), F.max("kind").alias("kind"), F.max("credit").cast("double").alias("value"))
    rows = start.unionByName(e.withColumn("n", F.lit(0).cast("long"))).repartition("source_id").sortWithinPartitions("source_id", "seq", "target_id", "edge_type")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, name, line, request, out = None, None, 0, [], []
        for row in _requests(batches):
            if row is not None:
                if row.source_id != name:
                    source, name, line = Source(config), row.source_id, 0
                if row.kind == "edge":
                    key = (row.target_id, row.edge_type)
                    source.edges[key] = Edge(row.value, row.n)
                    line += 1
                    out.append((name, line, row.seq, row.trace_id, row.kind, "edge", *key, row.value, row.value, row.n, False))
                else:
                    request.append(row)
            elif request:
                first = request[0]
                if first.kind in KINDS[:4]:
                    moves = source.raised(first.kind, first.trace_id, [((r.target_id, r.edge_type), r.value) for r in request])
                else:
                    moves = source.undone(first.kind, first.trace_id, [(r.target_id, r.edge_type) for r in request])
                for role, key, old, new in moves:
                    at, line = source.edges[key], line + 1
                    out.append((name, line, first.seq, first.trace_id, first.kind, role, *key, old, new, at.count, at.dormant))
                request = []
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(run, JOURNAL)


def weights(journal: DataFrame) -> DataFrame:
    """The last weight, count and dormancy of each edge."""
    last = journal.groupBy("source_id", "target_id", "edge_type").agg(F.max_by(F.struct("new_weight", "reinforced_count", "dormant"), "line").alias("x"))
    return last.select("source_id", "target_id", "edge_type", F.col("x.new_weight").alias("weight"), "x.reinforced_count", "x.dormant")
