"""Folds of ordered usage events into edge weights and states, as windows and closed forms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped, decayed

EDGE = ("source_id", "target_id", "edge_type")


def edge_credit(paths: DataFrame) -> DataFrame:
    """Credit of each edge of paths(trace_id, contribution, steps): the greatest clamped contribution in a trace."""
    step = paths.select("trace_id", "contribution", F.explode("steps").alias("s"))
    return step.groupBy("trace_id", *(F.col(f"s.{c}").alias(c) for c in EDGE)).agg(F.max(clamped(F.col("contribution"), 0.1, 1.0)).alias("credit"))


def reinforced(edges: DataFrame, credits: DataFrame, rate: float, maximum: float) -> DataFrame:
    """New weight and count of each edge: rises add up to the maximum; a weight above it stays."""
    total = credits.groupBy(*EDGE).agg(F.sum("credit").alias("credit"), F.count("*").alias("n"))
    both = edges.join(total, list(EDGE), "left").fillna(0, ["credit", "n"])
    new = F.greatest(F.col("weight"), F.least(F.lit(maximum), F.col("weight") + rate * F.col("credit")))
    return both.select(*EDGE, F.col("weight").alias("old_weight"), new.alias("new_weight"), F.col("n").alias("reinforced"))


def quorum(evidence: DataFrame, needed: int) -> DataFrame:
    """evidence(edge, trace_id, seq): the first of each trace counts; each from the needed one on activates."""
    first = evidence.groupBy(*EDGE, "trace_id").agg(F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy(*EDGE).orderBy("seq", "trace_id"))
    return first.withColumn("evidence_count", n).withColumn("activated", n >= needed)


def confirmations(confirmed: DataFrame, ratio: float, maximum: float) -> DataFrame:
    """confirmed(edge, trace_id, seq, increment, weight): the n-th distinct trace adds the first increment times
    ratio ** (n - 1); the weight after all of them is a geometric sum, up to its limit and the maximum."""
    first = confirmed.groupBy(*EDGE, "trace_id").agg(F.min(F.struct("seq", "increment", "weight")).alias("x"))
    agg = first.groupBy(*EDGE).agg(F.count("*").alias("n"), F.min_by("x.increment", "x.seq").alias("base"), F.min_by("x.weight", "x.seq").alias("initial"))
    raised = F.col("initial") + F.col("base") * (1 - F.pow(F.lit(ratio), F.col("n"))) / (1 - ratio)
    return agg.withColumn("new_weight", F.greatest(F.col("initial"), F.least(F.lit(maximum), raised)))


def reversed_weights(journal: DataFrame) -> DataFrame:
    """journal(edge, baseline, maximum, delta, active): baseline and the deltas that are still active, clamped."""
    left = journal.groupBy(*EDGE, "baseline", "maximum").agg(F.sum(F.when(F.col("active"), F.col("delta")).otherwise(0.0)).alias("left"))
    return left.withColumn("new_weight", F.greatest(F.lit(0.0), F.least(F.greatest("baseline", "maximum"), F.col("baseline") + F.col("left"))))


STAGED = "trace_id long, batch long, seq long, node_id string, stage int, changed boolean, accepted boolean"


def _staged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, one request after the other; what is held are the stages of one trace's nodes and one request."""
    names = [c.split()[0] for c in STAGED.split(", ")]
    last, at, tried, held, ok, out = None, {}, {}, [], True, []
    for rows in chain((b.itertuples(index=False) for b in batches), [[None]]):
        for row in rows:
            key = None if row is None else (row.trace_id, row.batch)
            if key != last:
                at |= tried if ok else {}
                out += [(*h, h[-1] and ok, ok) for h in held]
                if key is None or last is None or key[0] != last[0]:
                    at = {}
                last, tried, held, ok = key, {}, [], True
            if row is None:
                continue
            now = tried.get(row.node_id, at.get(row.node_id, 0))
            ok = ok and row.stage - now in (0, 1)
            held.append((row.trace_id, row.batch, row.seq, row.node_id, row.stage, row.stage != now))
            if ok:
                tried[row.node_id] = row.stage
            if len(out) >= 10_000:
                yield pd.DataFrame([o[:5] + o[6:] for o in out], columns=names)
                out = []
    if out:
        yield pd.DataFrame([o[:5] + o[6:] for o in out], columns=names)


def stages(events: DataFrame) -> DataFrame:
    """events(trace_id, batch, node_id, seq, stage 0-3) with changed and accepted. The events of one batch are one request,
    in the order of seq; batches of a trace go in their order. An event may keep its node's stage or take the next one
    (0 to begin with); one that may not refuses its whole batch, which then leaves all stages as they were.

    A trace is folded in order by one task, which streams through its rows; it has few, as a search shows 100 nodes at most."""
    rows = events.select("trace_id", "batch", "seq", "node_id", F.col("stage").cast("int").alias("stage"))
    return rows.repartition("trace_id").sortWithinPartitions("trace_id", "batch", "seq").mapInPandas(_staged, STAGED)


def replays(requests: DataFrame) -> DataFrame:
    """requests(idempotency_key, seq, payload_hash): the first of a key runs, an equal one replays, another conflicts."""
    w = Window.partitionBy("idempotency_key").orderBy("seq")
    first = F.first("payload_hash").over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "run").when(F.col("payload_hash") == first, "replay").otherwise("idempotency_conflict"))


def activation_history(events: DataFrame, now, half_life: float, maximum: float) -> DataFrame:  # noqa: ANN001
    """Decayed activation of each node as of now (a column of seconds), where each event(node_id, at, value >= 0) adds to
    what is left of the ones before and is cut at the maximum.

    In units of now, with s the sum up to an event and m what the maximum at that event has decayed to, the result is
    s_n + min(0, min(m_j - s_j)): one running sum and one aggregate, so no history is folded or held in memory. Events of
    the same time count together."""
    w = Window.partitionBy("node_id").orderBy("at")
    age = now - F.col("at")
    e = events.withColumns({"own": decayed(F.col("value"), age, half_life), "most": decayed(F.lit(maximum), age, half_life)})
    e = e.withColumn("room", F.col("most") - F.sum("own").over(w))
    return e.groupBy("node_id").agg((F.sum("own") + F.least(F.lit(0.0), F.min("room"))).alias("activation"), F.count("*").alias("n"))
