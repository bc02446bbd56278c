"""Feedback as a stream: repeated requests fall away within a watermark, and each micro-batch is folded into the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators import feedback, ledger
from ..sources import store


def decayed_counts(events: DataFrame, late: str, window: str) -> DataFrame:
    """Events of each node and window of event time; what is later than the watermark is not counted."""
    from pyspark.sql import functions as F

    return events.withWatermark("at", late).groupBy(F.window("at", window), "node_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def reinforce(events: DataFrame, folder: str, config: EngineConfig, checkpoint: str) -> StreamingQuery:
    """Folds events(source_id, target_id, edge_type, seq, trace_id, kind, credit, idempotency_key, at) into the table of
    edges in the folder, one version for each micro-batch. A batch that is run again finds its version and does nothing.

    Successes without siblings go by their closed form; with siblings, by the ledger. Policies whose state outlives a batch
    (soft start, confirmations) need the whole history and are for ledger.fold."""
    if config.soft_start_feedback_reinforcement or config.confirmed_outcome_reinforcement:
        raise ValueError("policies with a history are folded over all events")
    fresh = events.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["idempotency_key"])

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n + 1 in store.versions(spark, folder):
            return
        edges, own = store.read(spark, folder, n), batch.where("kind = 'success'")
        if config.sibling_feedback_normalization > 0:
            out = ledger.weights(ledger.fold(edges, own, config)).drop("dormant")
        else:
            new = feedback.reinforced(edges, own, config.feedback_learning_rate, config.maximum_edge_weight)
            new = new.withColumnRenamed("new_weight", "weight").drop("old_weight")
            out = edges.drop("weight").join(new, list(feedback.EDGE)).selectExpr(*feedback.EDGE, "weight", "reinforced_count + reinforced as reinforced_count")
        store.publish(out, folder, n + 1)

    return fresh.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
