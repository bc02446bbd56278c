"""Experiments: arms replayed over checkpoints, reports of variants, gates, selection and hypotheses.

Variants, arms and checkpoints are stated lists, a few rows each; cases, hits, edges and events may be large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import ledger
from .feedback import EDGE

#: Cohorts and the names of gates (fixed values).
COHORTS = ("direct_lookup", "relation", "negative_control")
BASE_GATES = ("relation_strictly_above_current", "direct_non_regression", "negative_non_regression", "all_relation_paths_match", "feedback_isolated")
GATES = {
    "local": (*BASE_GATES, "relation_strictly_above_recurrent_balanced"),
    "anchored": (*BASE_GATES, "entry_anchor_invariant", "graph_signal_excludes_zero_hop"),
    "fusion": (*BASE_GATES, "individual_control_rank_non_regression", "individual_relation_rank_improvement", "entry_anchor_invariant", "graph_signal_excludes_zero_hop", "final_order_recomputable"),
}
#: Variants that are measured but can't be chosen (fixed values).
BASELINES = {"local": ("current", "recurrent-balanced"), "anchored": ("current", "bm25-only"), "fusion": ("current",)}
FLAGS = ("path_matched", "isolated", "anchored", "edge_only", "recomputable")


def replayed(edges: DataFrame, events: DataFrame, arms: dict[str, EngineConfig | None], checkpoints: DataFrame) -> DataFrame:
    """arm, checkpoint, edge, weight, reinforced_count of edges and events (as for ledger.fold) after all events up to
    checkpoints(checkpoint, until). Each arm folds the events once, by its policy; an arm without one is a control, whose
    events change nothing."""
    none = events.where(F.lit(False))
    made = [ledger.fold(edges, none if c is None else events, c or EngineConfig()).withColumn("arm", F.lit(a)) for a, c in arms.items()]
    at = reduce(DataFrame.unionByName, made).join(F.broadcast(checkpoints), F.col("seq") <= F.col("until"))
    last = lambda c, name: F.max_by(c, "line").alias(name)
    return at.groupBy("arm", "checkpoint", *EDGE).agg(last("new_weight", "weight"), last("reinforced_count", "reinforced_count"))  # numbers: no sort of the journal


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand in one alone, with its side; none: a replay or a stored result is equal to what it is held against."""
    one = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return one(a, b, "left").unionByName(one(b.select(*a.columns), a, "right"))


def isolation(before: DataFrame, after: DataFrame, credited: DataFrame) -> DataFrame:
    """role, changed, untouched: what feedback did to credited and to other edges; edges that come or go are changed."""
    a, b = before.select(*EDGE, F.col("weight").alias("old")), after.select(*EDGE, F.col("weight").alias("new"))
    both = a.join(b, list(EDGE), "full").join(credited.select(*EDGE).distinct().withColumn("c", F.lit(True)), list(EDGE), "left")
    same = F.col("old").eqNullSafe(F.col("new"))
    role = F.when(F.col("c"), "credited").otherwise("uncredited")
    return both.groupBy(role.alias("role")).agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("untouched"))


def variant_report(results: DataFrame, current: str = "current") -> DataFrame:
    """One row for each variant of results(variant_id, case_id, cohort, rank, expansions, complexity, and the flags): MRR of
    each cohort, mean expansions, whether each flag holds in all cases (paths: in those of relations), and how cases move
    against the current variant."""
    now = results.where(F.col("variant_id") == current).select("case_id", F.col("rank").alias("old"))
    both = results.join(now, "case_id", "left")
    of = lambda c: F.col("cohort") == c
    control = F.col("cohort").isin(COHORTS[0], COHORTS[2])
    fine = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    mrr = [F.coalesce(F.avg(F.when(of(c), 1 / F.col("rank"))), F.lit(0.0)).alias(f"{c}_mrr") for c in COHORTS]
    flags = [fine(F.col(c) | ~of("relation") if c == "path_matched" else F.col(c)).alias(c) for c in FLAGS]
    better = F.col("rank") < F.col("old")
    moves = [F.count_if(better).alias("n_improved"), F.count_if(better & of("relation")).alias("n_relation_improved"), F.count_if(control & (F.col("rank") > F.col("old"))).alias("n_control_worsened")]
    return both.groupBy("variant_id").agg(*mrr, F.avg("expansions").alias("mean_expansions"), F.max("complexity").alias("complexity"), *flags, *moves)


def gates(report: DataFrame, family: str) -> DataFrame:
    """The report with a column for each gate of the family, and passed: all hold, and the variant isn't a baseline."""
    held = {f"{c}_mrr": f"{c}_now" for c in COHORTS}
    now = report.where("variant_id = 'current'").select(*(F.col(c).alias(n) for c, n in held.items()))
    out = report.join(F.broadcast(now))
    if family == "local":
        rival = report.where("variant_id = 'recurrent-balanced'").select(F.col("relation_mrr").alias("rival"))
        out = out.join(F.broadcast(rival))
    rule: dict[str, Column] = {
        "relation_strictly_above_current": F.col("relation_mrr") > F.col("relation_now"),
        "relation_strictly_above_recurrent_balanced": F.col("relation_mrr") > F.col("rival"),
        "direct_non_regression": F.col("direct_lookup_mrr") >= F.col("direct_lookup_now"),
        "negative_non_regression": F.col("negative_control_mrr") >= F.col("negative_control_now"),
        "all_relation_paths_match": F.col("path_matched"),
        "feedback_isolated": F.col("isolated"),
        "entry_anchor_invariant": F.col("anchored"),
        "graph_signal_excludes_zero_hop": F.col("edge_only"),
        "final_order_recomputable": F.col("recomputable"),
        "individual_control_rank_non_regression": F.col("n_control_worsened") == 0,
        "individual_relation_rank_improvement": F.col("n_relation_improved") > 0,
    }
    chosen = GATES[family]
    passed = reduce(Column.__and__, [F.col(g) for g in chosen]) & ~F.col("variant_id").isin(*BASELINES[family])
    return out.withColumns({g: rule[g] for g in chosen}).withColumn("passed", passed).drop(*held.values(), "rival")


def chosen(gated: DataFrame, family: str) -> DataFrame:
    """variant_id of the one to keep, in the family's order of preference; the current one if none passes."""
    worst, relation = F.desc(F.least(*(f"{c}_mrr" for c in COHORTS))), F.desc("relation_mrr")
    first = {"local": (worst, relation), "anchored": (relation, worst), "fusion": (relation, worst, F.desc("n_improved"))}[family]
    best = gated.where("passed").orderBy(*first, "mean_expansions", "complexity", "variant_id").limit(1).select("variant_id", F.lit(0).alias("turn"))
    lone = gated.where("variant_id = 'current'").select("variant_id", F.lit(1).alias("turn"))
    return best.unionByName(lone).orderBy("turn").limit(1).select("variant_id")


def hypotheses(cases: DataFrame, explanations: DataFrame, feedback: DataFrame) -> DataFrame:
    """H1 to H4 with supported, unsupported or inconclusive, of cases(cohort, baseline_rank, graph_rank, acceptable_rank),
    explanations(matched) and feedback(changed_edges, uncredited_edge_changes, non_target_rank_changes).

    H1: the graph helps relations. H2: it leaves controls alone. H3: all expected paths are shown. H4: feedback changes
    what it credits and nothing else."""
    rel, control = F.col("cohort") == "relation", F.col("cohort").isin("direct_lookup", "negative_control")
    delta = F.col("baseline_rank") - F.col("graph_rank")
    c = cases.agg(
        F.avg(F.when(rel, 1 / F.col("baseline_rank"))).alias("before"),
        F.avg(F.when(rel, 1 / F.col("graph_rank"))).alias("after"),
        F.count_if(rel & (delta > 0)).alias("up"),
        F.count_if(rel & (delta < 0)).alias("down"),
        F.coalesce(F.bool_or(control & ((F.col("graph_rank") > F.col("acceptable_rank")) | (delta < -1))), F.lit(False)).alias("excess"),
        F.coalesce(F.bool_and(~control | (delta >= 0)), F.lit(True)).alias("kept"),
    )
    e = explanations.agg(F.coalesce(F.bool_and("matched"), F.lit(True)).alias("shown"))
    f = feedback.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("changed_edges", "uncredited_edge_changes", "non_target_rank_changes")))
    yes, no, open_ = F.lit("supported"), F.lit("unsupported"), F.lit("inconclusive")
    rise, more = F.col("after") > F.col("before"), F.col("up") > F.col("down")
    h1 = F.when(rise & more, yes).when(~rise & ~more, no).otherwise(open_)
    h2 = F.when(F.col("excess"), no).when(F.col("kept"), yes).otherwise(open_)
    h3 = F.when(F.col("shown"), yes).otherwise(no)
    h4 = F.when((F.col("uncredited_edge_changes") > 0) | (F.col("non_target_rank_changes") > 0), no).when(F.col("changed_edges") > 0, yes).otherwise(open_)
    row = c.join(F.broadcast(e)).join(F.broadcast(f))
    found = F.array(*(F.struct(F.lit(f"H{i}").alias("id"), h.alias("status")) for i, h in enumerate((h1, h2, h3, h4), 1)))
    return row.select(F.inline(found))


def margins(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """arm, checkpoint, case_id, margin of scores(arm, checkpoint, case_id, node_id, final) and targets(case_id, target_id):
    the target's score less the best of the others; who isn't scored counts 0."""
    own = F.col("node_id") == F.col("target_id")
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("final"))), F.lit(0.0))
    both = scores.join(targets, "case_id")
    return both.groupBy("arm", "checkpoint", "case_id").agg((best(own) - best(~own)).alias("margin"))


def registry(identifiers: DataFrame) -> DataFrame:
    """kind, n, repeated, shared of identifiers(split, kind, identifier): how many stand twice in a split, and in several."""
    n = identifiers.groupBy("kind", "identifier").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"))
    return n.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > F.col("splits")).alias("repeated"), F.count_if(F.col("splits") > 1).alias("shared"))


def packets(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, packet, packet_sha256: a case's query and what each channel shows for it, without any answer; hits(case_id,
    channel, rank, node_id, text) are lists cut at a limit."""
    line = F.struct("channel", "rank", "node_id", "text")
    shown = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(line)).alias("hits"))
    body = F.to_json(F.struct("case_id", "query", F.coalesce("hits", F.array().cast("array<struct<channel:string,rank:int,node_id:string,text:string>>")).alias("hits")))
    made = cases.select("case_id", "query").join(shown, "case_id", "left").select("case_id", body.alias("packet"))
    return made.withColumn("packet_sha256", F.sha2(F.col("packet").cast("binary"), 256))
