"""Gates and measures of experiments with two channels: what searches show, and what judges choose from it. All of them work
on tables of many experiments at once, by aggregates alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cohorts whose cases the lexical channel is to answer (fixed values).
CONTROLS = ("direct_lookup", "directional_negative")


def _all(condition: Column, among: Column | None = None) -> Column:
    """Whether it holds in all rows, or in all among some; a null doesn't hold, and no rows do."""
    held = F.coalesce(condition, F.lit(False))
    return F.coalesce(F.bool_and(held if among is None else ~among | held), F.lit(True))


def _rows(one: DataFrame, gates: list[str], *keys: str) -> DataFrame:
    """experiment, gate, passed: a row for each gate of a table with a column for each."""
    line = F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in gates))
    return one.select(*keys, F.inline(line))


def channel_gates(cases: DataFrame, feedback: DataFrame, limit: int = 10) -> DataFrame:
    """experiment, gate, passed of cases(experiment, cohort, lexical_rank, relation_rank, bm25_rank, acceptable_rank,
    lexical_parity, relation_parity, path_matched, no_combined_result, traces_share_query, edges_unchanged, deterministic)
    and feedback(experiment, lexical_isolated, relation_isolated, misuse_rejected), one row for each experiment; without
    that row, its three gates fail. A null rank (the node is not among the hits) counts as limit + 1; a null
    acceptable_rank accepts nothing."""
    rel, control = F.col("cohort") == "relation", F.col("cohort").isin(*CONTROLS)
    lexical, relation, bm25 = (F.coalesce(F.col(f"{c}_rank"), F.lit(limit + 1)) for c in ("lexical", "relation", "bm25"))
    mrr = lambda c: F.avg(F.when(rel, 1 / c))
    better = F.coalesce(F.bool_or(rel & (relation < bm25)), F.lit(False))
    kept = (lexical <= bm25) & (lexical <= F.col("acceptable_rank"))
    # Names and order of the gates are fixed values.
    own = {
        "lexical_lane_matches_isolated_bm25": _all(F.col("lexical_parity")),
        "lexical_controls_do_not_regress": _all(kept, control),
        "relation_lane_matches_isolated_anchored_graph": _all(F.col("relation_parity")),
        "relation_strictly_improves_bm25": better & F.coalesce(mrr(relation) > mrr(bm25), F.lit(False)),
        "relation_paths_match_and_exclude_zero_hop": _all(F.col("path_matched"), rel),
        "no_cross_lane_combined_result": _all(F.col("no_combined_result")),
        "independent_trace_ids_share_query": _all(F.col("traces_share_query")),
        "search_does_not_change_edges": _all(F.col("edges_unchanged")),
    }
    fed = {
        "lexical_success_does_not_change_edges": "lexical_isolated",
        "relation_success_changes_only_credited_edges": "relation_isolated",
        "cross_lane_trace_misuse_rejected": "misuse_rejected",
    }
    last = {"deterministic_lane_results": _all(F.col("deterministic"))}
    one = cases.groupBy("experiment").agg(*(c.alias(g) for g, c in (own | last).items()))
    one = one.join(feedback, "experiment", "left").withColumns({g: F.coalesce(c, F.lit(False)) for g, c in fed.items()})
    return _rows(one, [*own, *fed, *last], "experiment")


def decided(votes: DataFrame, cases: DataFrame, node_first: bool = False) -> DataFrame:
    """cases(experiment, case_id, cohort, intended, expected_node_id, in_union, edges_unchanged) with what two or more of
    votes(experiment, case_id, judge_id, channel, node_id, rank, path_matched) agree on: has_majority, channel, node_id,
    rank, path_matched, node_correct, channel_correct, unanimous.

    Judges agree on channel and node, or on the node alone (node_first: the channel is then null, the rank the least and
    path_matched holds if it does for all relation votes); to abstain is no choice, whoever agrees."""
    key = ["node_id"] if node_first else ["channel", "node_id"]
    rel = F.col("channel") == "relation"
    n = votes.groupBy("experiment", "case_id", *key).agg(F.count("*").alias("n"), F.min("rank").alias("rank"), _all(F.col("path_matched"), rel if node_first else None).alias("path"))
    name = F.lit(None).cast("string").alias("channel") if node_first else F.col("channel")
    of = F.max_by(F.struct(name, "node_id", "rank", "path", "n"), F.struct("n", *key))
    n = n.groupBy("experiment", "case_id").agg(of.alias("top"), (F.count("*") == 1).alias("unanimous"))
    paths = votes.groupBy("experiment", "case_id").agg(_all(F.col("path_matched"), rel).alias("all_paths")) if node_first else None
    both = cases.join(n, ["experiment", "case_id"], "left")
    has = F.coalesce((F.col("top.n") >= 2) & F.col("top.node_id").isNotNull(), F.lit(False))
    if paths is None:
        has = has & F.coalesce(F.col("top.channel") != "abstain", F.lit(False))
    chosen = lambda c: F.when(has, F.col(f"top.{c}"))
    own = both.withColumns({"has_majority": has, "channel": chosen("channel"), "node_id": chosen("node_id"), "rank": chosen("rank"), "unanimous": F.coalesce("unanimous", F.lit(False))})
    fine = F.coalesce(chosen("path"), F.lit(False)) | (F.col("intended") != "relation")
    if paths is not None:
        own, fine = own.join(paths, ["experiment", "case_id"], "left"), F.coalesce("all_paths", F.lit(True))
    right = {"path_matched": fine, "node_correct": F.coalesce(F.col("node_id") == F.col("expected_node_id"), F.lit(False)), "channel_correct": F.coalesce(F.col("channel") == F.col("intended"), F.lit(False))}
    return own.withColumns(right).select(*cases.columns, "has_majority", "channel", "node_id", "rank", "path_matched", "node_correct", "channel_correct", "unanimous")


def selection_report(cases: DataFrame) -> DataFrame:
    """experiment and measures of decided cases; the gap is what both channels show and the judges don't choose."""
    share = lambda c: F.avg(c.cast("double"))
    gap = share(F.col("in_union")) - share(F.col("node_correct"))
    return cases.groupBy("experiment").agg(share(F.col("node_correct")).alias("node_accuracy"), share(F.col("channel_correct")).alias("channel_accuracy"), share(~F.col("has_majority")).alias("abstention_rate"), share(F.col("unanimous")).alias("unanimity"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("selected_mrr"), share(F.col("in_union")).alias("union_coverage"), gap.alias("oracle_gap"))


def selection_gates(cases: DataFrame, votes: DataFrame, node_first: bool = False, each: int = 3) -> DataFrame:
    """experiment, gate, passed of decided cases and the votes on them: the gates that follow from votes. A judge has to find
    as many expected nodes as each says; node_first asks for no channel."""
    rel, control = F.col("cohort") == "relation", F.col("cohort").isin(*CONTROLS)
    # Names and order of the gates are fixed values.
    if node_first:
        own = {
            "node_majority_exists_for_every_case": _all(F.col("has_majority")),
            "majority_selects_every_expected_node": _all(F.col("node_correct")),
            "selected_relation_paths_match": _all(F.col("path_matched")),
            "abstain_is_never_majority": _all(F.col("node_id").isNotNull()),
            "search_and_scoring_do_not_change_edges": _all(F.col("edges_unchanged")),
        }
        return _rows(cases.groupBy("experiment").agg(*(c.alias(g) for g, c in own.items())), [*own], "experiment")
    own = {
        "majority_exists_for_every_case": _all(F.col("has_majority")),
        "majority_selects_every_expected_node": _all(F.col("node_correct")),
        "lexical_controls_select_lexical": _all(F.col("channel_correct"), control),
        "relation_case_selects_relation": _all(F.col("channel_correct"), rel),
        "relation_path_matches_after_projection": _all(F.col("path_matched"), rel),
    }
    last = {"search_does_not_change_edge_weights": _all(F.col("edges_unchanged"))}
    judges = "each_judge_selects_three_expected_nodes"
    right = votes.join(cases.select("experiment", "case_id", "expected_node_id"), ["experiment", "case_id"])
    found = right.groupBy("experiment", "judge_id").agg(F.count_if(F.col("node_id") == F.col("expected_node_id")).alias("n"))
    found = found.groupBy("experiment").agg((F.min("n") >= each).alias(judges))
    one = cases.groupBy("experiment").agg(*(c.alias(g) for g, c in (own | last).items())).join(found, "experiment", "left")
    return _rows(one.withColumn(judges, F.coalesce(judges, F.lit(False))), [*own, judges, *last], "experiment")
