"""Searches at checkpoints: all arms and checkpoints of an experiment in one propagation, their measures, and gates as rows.

Arms and checkpoints are stated lists, a few each; a version is one of each. An edge stands once, whatever the number of
versions: what an arm has made of its weight by a checkpoint is an entry of a map, and edges that feedback leaves alone
have no entry. Cases, edges and events may be large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.lineage import cut
from . import graph, ranking
from .feedback import EDGE

#: Roles of cases and names of gates (fixed values).
ROLES = ("headroom", "control", "ceiling")
GATES = (
    "expected_paths",
    "headroom_strict_improvement",
    "headroom_intermediate_non_regression",
    "control_case_non_regression",
    "ceiling_case_non_regression",
    "control_arm_non_regression",
    "control_feedback_recorded_without_mutation",
    "treatment_credited_edges_only",
)
VERSION = ("arm", "checkpoint")
#: Searches of a task.
SEARCHES = 20_000


def _name(arm: Column, checkpoint: Column) -> Column:
    return F.concat_ws("@", checkpoint.cast("string"), arm)


def versions(arms: Sequence[str], checkpoints: Sequence[int]) -> Column:
    """A column that makes a row for each version, with arm and checkpoint."""
    return F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(c).alias("checkpoint")) for a in arms for c in checkpoints)))


def versioned(edges: DataFrame, at: DataFrame) -> DataFrame:
    """edges with weights: from the name of a version to the weight there, for versions in which it isn't the edge's own.
    at(arm, checkpoint, edge, weight) is what experiments.replayed gives."""
    own = edges.select(*EDGE, F.col("weight").alias("own"))
    moved = at.join(own, list(EDGE)).where(F.col("weight") != F.col("own"))
    entry = F.struct(_name(F.col("arm"), F.col("checkpoint")).alias("version"), F.col("weight").cast("double").alias("weight"))
    return edges.join(moved.groupBy(*EDGE).agg(F.map_from_entries(F.collect_list(entry)).alias("weights")), list(EDGE), "left")


def shown(seeds: DataFrame, cases: DataFrame, edges: DataFrame, at: DataFrame, arms: Sequence[str], checkpoints: Sequence[int], config: EngineConfig, limit: int) -> DataFrame:
    """arm, checkpoint, case_id, role, target_id, node_id, activation, rank, matched: what each case's search shows in each
    version, cut at the limit, from seeds(case_id, node_id, entry) and cases(case_id, role, target_id, expected). Nodes count
    that an edge leads to. matched: a path to the node has the steps that the case expects, in any weights.

    One hop is one join for all versions. The rows are written once, and all measures read them. Rows of paths hold names
    once, in their walk, and sums need no sort."""
    asked = seeds.select("case_id", "node_id", "entry", versions(arms, checkpoints))
    asked = asked.select(F.struct("case_id", _name(F.col("arm"), F.col("checkpoint")).alias("version")).alias("query_id"), "node_id", "entry")
    found = graph.paths(asked, versioned(edges, at), config).where("step > 0")
    ends = F.zip_with(F.slice("path", F.lit(1), F.col("step")), F.slice("path", F.lit(2), F.col("step")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = F.zip_with(ends, "types", lambda x, t: F.struct(x.a.alias("source_id"), x.b.alias("target_id"), t.alias("edge_type")))
    found = found.select("query_id", F.col("query_id.case_id").alias("case_id"), "node_id", "contribution", steps.alias("steps"))
    due = found.join(cases.select("case_id", "expected"), "case_id")
    act = due.groupBy("query_id", "node_id").agg(F.round(F.sum("contribution"), ranking.DIGITS).alias("activation"), F.bool_or(F.col("steps") == F.col("expected")).alias("matched"))
    name = F.split("query_id.version", "@", 2)
    best = ranking.top(act, "activation", limit).select(name[1].alias("arm"), name[0].cast("int").alias("checkpoint"), "query_id.case_id", "node_id", "activation", "rank", "matched")
    best = best.join(cases.select("case_id", "role", "target_id"), "case_id")
    return cut(best.select(*VERSION, "case_id", "role", "target_id", "node_id", "activation", "rank", "matched"), 1 + cases.count() * len(arms) * len(checkpoints) // SEARCHES)


def scores(hits: DataFrame, cases: DataFrame, arms: Sequence[str], checkpoints: Sequence[int], limit: int) -> DataFrame:
    """arm, checkpoint, case_id, role, rank, margin, matched, entered: a row for each case and version, also for cases whose
    search shows nothing. A target that isn't shown has rank limit + 1; margin is its activation less the best of the
    others shown, 0 standing for who isn't; entered: nodes that the search didn't show at the checkpoint before."""
    key = [*VERSION, "case_id"]
    own = F.col("node_id") == F.col("target_id")
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("activation"))), F.lit(0.0))
    each = hits.groupBy(*key).agg(F.max(F.when(own, F.col("rank"))).alias("rank"), (best(own) - best(~own)).alias("margin"), F.max(F.when(own, F.col("matched"))).alias("matched"))
    order = sorted(checkpoints)
    follows = F.create_map(*(F.lit(x) for pair in zip(order, order[1:], strict=False) for x in pair)) if len(order) > 1 else F.lit(None).cast("map<int,int>")
    before = hits.select("arm", F.try_element_at(follows, F.col("checkpoint")).alias("checkpoint"), "case_id", "node_id")
    later = hits.where(F.col("checkpoint") != order[0])
    new = later.join(before, [*key, "node_id"], "left_anti").groupBy(*key).agg(F.count("*").alias("entered"))
    out = cases.select("case_id", "role", versions(arms, checkpoints)).join(each, key, "left").join(new, key, "left")
    filled = {"rank": F.coalesce("rank", F.lit(limit + 1)), "margin": F.coalesce("margin", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(False)), "entered": F.coalesce("entered", F.lit(0))}
    return out.withColumns(filled).select(*key, "role", *filled)


def report(scored: DataFrame) -> DataFrame:
    """arm, checkpoint, role, n_cases, mrr, mean_margin, entered, all_matched: a row for each role of each version."""
    near = lambda c: F.round(c, ranking.DIGITS)
    return scored.groupBy(*VERSION, "role").agg(F.count("*").alias("n_cases"), near(F.avg(1 / F.col("rank"))).alias("mrr"), near(F.avg("margin")).alias("mean_margin"), F.sum("entered").alias("entered"), F.bool_and("matched").alias("all_matched"))


def mutations(edges: DataFrame, at: DataFrame, credited: DataFrame) -> DataFrame:
    """arm, checkpoint, moved, only_credited: how many edges stand elsewhere than at the start, and whether these are just the
    ones of credited(checkpoint, edge), which feedback had credited by then."""
    named = credited.select("checkpoint", *EDGE).distinct().withColumn("due", F.lit(True))
    both = at.join(edges.select(*EDGE, F.col("weight").alias("own")), list(EDGE)).join(named, ["checkpoint", *EDGE], "left")
    moved = F.col("weight") != F.col("own")
    return both.groupBy(*VERSION).agg(F.count_if(moved).alias("moved"), F.bool_and(moved == F.coalesce("due", F.lit(False))).alias("only_credited"))


def trajectory_gates(measured: DataFrame, moved: DataFrame, control: str) -> DataFrame:
    """arm, checkpoint, gate, passed of report(...) and mutations(...): which gates of a trajectory hold where.

    What compares holds against the checkpoint before, so the first has no such row; strict improvement is asked of the last
    against the first. Gates of single roles are those of the arms under treatment; the control arm must not fall in any role."""
    w = Window.partitionBy("arm", "role").orderBy("checkpoint")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = measured.withColumns({"before": F.lag("mrr").over(w), "first": F.first("mrr").over(whole), "last": F.max("checkpoint").over(whole)})
    treated, later = F.col("arm") != control, F.col("before").isNotNull()
    line = lambda df, gate, passed: df.select(*VERSION, F.lit(gate).alias("gate"), passed.alias("passed"))
    head, ctrl, ceil = (at.where(treated & later & (F.col("role") == r)) for r in ROLES)
    kept = F.col("mrr") >= F.col("before")
    paths = measured.groupBy(*VERSION).agg(F.bool_and("all_matched").alias("ok"))
    still = at.where(~treated & later).groupBy(*VERSION).agg(F.bool_and(kept).alias("ok"))
    rows = [
        line(paths, GATES[0], F.col("ok")),
        line(head.where(F.col("checkpoint") == F.col("last")), GATES[1], F.col("mrr") > F.col("first")),
        line(head, GATES[2], kept),
        line(ctrl, GATES[3], kept),
        line(ceil, GATES[4], kept),
        line(still, GATES[5], F.col("ok")),
        line(moved.where(~treated), GATES[6], F.col("moved") == 0),
        line(moved.where(treated), GATES[7], F.col("only_credited")),
    ]
    return reduce(DataFrame.unionByName, rows)


def adaptation(scored: DataFrame, moved: DataFrame, control: str, role: str, limit: int) -> DataFrame:
    """A row for each arm but the control, at the last checkpoint of scores(...) and mutations(...): MRR and recall (the share
    of cases whose target is shown) of one role's cases, beside those of the control, and what is asked of an adaptation:
    a higher MRR, no case lost, every expected path shown, and no edge moved but those credited, and none by the control."""
    end = scored.agg(F.max("checkpoint").alias("checkpoint"))  # one row
    at = scored.where(F.col("role") == role).join(F.broadcast(end), "checkpoint", "left_semi").withColumn("found", F.col("rank") <= limit)
    still = at.where(F.col("arm") == control).select("case_id", F.col("rank").alias("rank_0"), F.col("found").alias("found_0"))
    both = at.where(F.col("arm") != control).join(still, "case_id")
    near = lambda c: F.round(F.avg(c), ranking.DIGITS)
    share = lambda c: near(F.col(c).cast("double"))
    out = both.groupBy("arm").agg(
        near(1 / F.col("rank_0")).alias("control_mrr"),
        near(1 / F.col("rank")).alias("mrr"),
        share("found_0").alias("control_recall"),
        share("found").alias("recall"),
        F.bool_and(F.col("found") | ~F.col("found_0")).alias("recall_kept"),
        F.bool_and("matched").alias("paths_matched"),
    )
    edges = moved.join(F.broadcast(end), "checkpoint", "left_semi")
    held = edges.where(F.col("arm") == control).agg(F.coalesce(F.max("moved"), F.lit(0)).alias("control_moved"))
    out = out.join(edges.select("arm", "only_credited"), "arm").join(F.broadcast(held))
    fine = F.col("only_credited") & (F.col("control_moved") == 0)
    return out.withColumns({"mrr_improved": F.col("mrr") > F.col("control_mrr"), "only_credited": fine}).drop("control_moved")
