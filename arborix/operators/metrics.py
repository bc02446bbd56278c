"""Evaluation: ranks, cohorts, differences, selection and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expected_ranks(cases: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """rank of each case's expected node; limit + 1 if it isn't there."""
    got = hits.select("query_id", F.col("node_id").alias("expected_node_id"), "rank")
    return cases.join(got, ["query_id", "expected_node_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(limit + 1)))


def cohort_metrics(ranks: DataFrame) -> DataFrame:
    """Cases, MRR, Hit@1 and Hit@3 of each cohort and overall, by grouping sets."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    out = ranks.rollup("cohort").agg(F.count("*").alias("n_cases"), F.avg(1 / F.col("rank")).alias("mrr"), hit(1).alias("hit_1"), hit(3).alias("hit_3"))
    return out.withColumn("cohort", F.coalesce("cohort", F.lit("overall")))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("query_id", "cohort", F.col("rank").alias("a")).join(after.select("query_id", F.col("rank").alias("b")), "query_id")
    kind = F.when(F.col("a") > F.col("b"), "improved").when(F.col("a") < F.col("b"), "worsened").otherwise("equal")
    return both.withColumn("outcome", kind).groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("a") - F.col("b")).alias("rank_delta"))


def edge_changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows that differ, come or go, null-safe."""
    a, b = before.select(*key, F.col(value).alias("before")), after.select(*key, F.col(value).alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def pareto(variants: DataFrame, up: tuple[str, str]) -> DataFrame:
    """Variants that no other is at least as good as in both and better in one; variants are few by nature."""
    x, y = up
    o = F.broadcast(variants.select(F.col(x).alias("ox"), F.col(y).alias("oy")))
    beaten = (F.col("ox") >= F.col(x)) & (F.col("oy") >= F.col(y)) & ((F.col("ox") > F.col(x)) | (F.col("oy") > F.col(y)))
    return variants.join(o, beaten, "left_anti")


def majority(votes: DataFrame, judges: int = 3) -> DataFrame:
    """case_id, choice, n of votes(case_id, choice): what two thirds or more chose, else no choice."""
    n = votes.groupBy("case_id", "choice").agg(F.count("*").alias("n"))
    first = n.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "choice"))).where("r = 1")
    return first.select("case_id", F.when(F.col("n") * 3 >= 2 * judges, F.col("choice")).alias("choice"), "n")


def selected(variants: DataFrame) -> DataFrame:
    """The variant to keep: of those that pass and that none beats, by worst cohort, expansions, complexity and id."""
    front = pareto(variants.where("passed"), ("relation_mrr", "negative_mrr"))
    return front.orderBy(F.desc("worst_mrr"), "expansions", "complexity", "variant_id").limit(1)


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, counts: how often each value stands with a key."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def rank_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, node_id, baseline_rank, current_rank, delta, top_k_status; who isn't in a list stands behind the longer one."""
    a, b = (x.select("case_id", "node_id", F.col("rank").alias(n)) for x, n in ((before, "baseline_rank"), (after, "current_rank")))
    longest = before.groupBy("case_id", F.lit(0).alias("s")).count().unionByName(after.groupBy("case_id", F.lit(1).alias("s")).count())
    behind = longest.groupBy("case_id").agg((F.max("count") + 1).alias("behind"))
    both = a.join(b, ["case_id", "node_id"], "full").join(behind, "case_id")
    status = F.when(F.col("baseline_rank").isNull(), "entered").when(F.col("current_rank").isNull(), "left").otherwise("retained")
    return both.select("case_id", "node_id", "baseline_rank", "current_rank", (F.coalesce("baseline_rank", "behind") - F.coalesce("current_rank", "behind")).alias("delta"), status.alias("top_k_status"))


def elasticity(records: DataFrame) -> DataFrame:
    """What feedback did to each case of records(case_id, feedback_count, rank, normalised, final, changed_edges): a
    regression, else a flip at a checkpoint, else changed edges without effect, else nothing."""
    w = Window.partitionBy("case_id").orderBy("feedback_count").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = records.select("*", *(F.first(c).over(w).alias(f"{c}_0") for c in ("rank", "normalised", "final", "feedback_count")))
    later = F.col("feedback_count") > F.col("feedback_count_0")
    near = lambda c: F.bool_and(F.abs(F.col(c) - F.col(f"{c}_0")) <= 1e-12)
    first = lambda cond: F.min(F.when(later & cond, F.col("feedback_count")))
    out = base.groupBy("case_id").agg(
        first(F.col("rank") < F.col("rank_0")).alias("flip"),
        first(F.col("rank") > F.col("rank_0")).alias("regression"),
        F.coalesce(F.bool_or(F.when(later, F.col("changed_edges") > 0)), F.lit(False)).alias("changed"),
        F.bool_and(F.col("rank") == F.col("rank_0")).alias("stable"),
        (near("normalised") & near("final")).alias("same"),
    )
    still = F.col("changed") & F.col("stable")
    kind = F.when(F.col("regression").isNotNull(), "rank_regression").when(F.col("flip").isNotNull(), "rank_flip_threshold").when(still, "edge_changed_but_rank_unchanged").otherwise("rank_stable_through_schedule")
    return out.select("case_id", kind.alias("classification"), F.col("flip").alias("rank_flip_threshold"), F.col("regression").alias("rank_regression_first_checkpoint"), F.col("stable").alias("rank_stable_through_schedule"), (still & F.col("same")).alias("fusion_side_ceiling"))


def trajectory(points: DataFrame) -> DataFrame:
    """arm, role, non_decreasing, gain of points(arm, role, checkpoint, mrr)."""
    w = Window.partitionBy("arm", "role").orderBy("checkpoint")
    step = points.withColumn("step", F.col("mrr") - F.lag("mrr").over(w))
    return step.groupBy("arm", "role").agg(F.coalesce(F.min("step") >= 0, F.lit(True)).alias("non_decreasing"), (F.max_by("mrr", "checkpoint") - F.min_by("mrr", "checkpoint")).alias("gain"))


def channel_metrics(ranks: DataFrame) -> DataFrame:
    """Intended MRR and Hit@1, relation against lexical MRR, and coverage of ranks(query_id, intended, lexical, relation),
    in which a rank is null if the expected node isn't in the channel's list."""
    own = F.when(F.col("intended") == "lexical", F.col("lexical")).otherwise(F.col("relation"))
    mrr = lambda c: F.avg(F.coalesce(1 / c, F.lit(0.0)))
    any_ = F.col("lexical").isNotNull() | F.col("relation").isNotNull()
    rel = F.col("intended") == "relation"
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return ranks.agg(mrr(own).alias("intended_mrr"), share(own == 1).alias("intended_hit_1"), F.avg(F.when(rel, F.coalesce(1 / F.col("lexical"), F.lit(0.0)))).alias("relation_cases_lexical_mrr"), F.avg(F.when(rel, F.coalesce(1 / F.col("relation"), F.lit(0.0)))).alias("relation_cases_relation_mrr"), share(any_).alias("union_coverage"))


def failed_gates(gates: DataFrame, wanted: list[str]) -> DataFrame:
    """position, name, reason of gates(position, name, passed) that are missing, misplaced, repeated or not true."""
    w = gates.sparkSession.createDataFrame(list(enumerate(wanted)), "position int, wanted string")
    both = gates.join(w, "position", "full")
    reason = F.when(F.col("name").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("name") != F.col("wanted"), "out_of_order").when(~F.coalesce("passed", F.lit(False)), "failed")
    return both.select("position", F.coalesce("name", "wanted").alias("name"), reason.alias("reason")).where("reason is not null")


def formula_audit(rows: DataFrame, entry_weight: float, graph_weight: float) -> DataFrame:
    """query_id, holds: whether stored finals are what entry and graph give, and stand in their order."""
    due = (F.col("entry") * entry_weight + F.col("graph") * graph_weight) / (entry_weight + graph_weight)
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "node_id")
    return rows.withColumn("turn", F.row_number().over(w)).groupBy("query_id").agg(F.bool_and((F.abs(F.col("final") - due) <= 1e-12) & (F.col("turn") == F.col("rank"))).alias("holds"))
