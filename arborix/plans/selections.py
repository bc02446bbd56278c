"""Queries of experiments with two channels; labelled documents stand in for cases, groups of them for experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection
from .queries import query, table

CASES = """WITH c AS (SELECT doc_id % 97 AS experiment, doc_id AS case_id, doc_id AS d, CASE WHEN quality = 1 THEN 'direct_lookup' ELSE 'relation' END AS cohort, CASE WHEN quality = 1 THEN 'lexical' ELSE 'relation' END AS intended, doc_id % 31 <> 4 AS in_union, doc_id % 43 <> 5 AS edges_unchanged FROM labels),
v AS (SELECT experiment, case_id, j AS judge_id, CASE WHEN (d * 7 + j * 3) % 11 = 0 THEN 'abstain' WHEN (d + j) % 13 = 0 THEN 'lexical' ELSE intended END AS channel, CASE WHEN (d * 7 + j * 3) % 11 <> 0 THEN CASE WHEN d % 5 = 2 AND j < 2 THEN d + 1 ELSE d END END AS node_id, CASE WHEN (d * 7 + j * 3) % 11 <> 0 THEN 1 + d % 4 END AS rank, d % 29 <> 3 AS ok FROM c, (SELECT unnest([0, 1, 2]) AS j)),
"""
PAIR = CASES + """n AS (SELECT experiment, case_id, channel, node_id, count(*) AS n, min(rank) AS rank, bool_and(ok) AS path FROM v GROUP BY experiment, case_id, channel, node_id),
t AS (SELECT *, count(*) OVER (PARTITION BY experiment, case_id) AS kinds FROM n QUALIFY row_number() OVER (PARTITION BY experiment, case_id ORDER BY n DESC, channel DESC, node_id DESC) = 1),
m AS (SELECT c.*, t.n >= 2 AND t.channel <> 'abstain' AS has, CASE WHEN has THEN t.channel END AS channel, CASE WHEN has THEN t.node_id END AS node_id, CASE WHEN has THEN t.rank END AS rank, has AND t.path AS path, kinds = 1 AS unanimous,
  coalesce(has AND t.node_id = c.case_id, false) AS right_node, coalesce(has AND t.channel = intended, false) AS right_channel FROM c JOIN t USING (experiment, case_id))
"""
NODE = CASES + """n AS (SELECT experiment, case_id, node_id, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT experiment, case_id, bool_and(channel <> 'relation' OR ok) AS path FROM v GROUP BY ALL),
t AS (SELECT experiment, case_id, arg_max(node_id, n) FILTER (n >= 2) AS node_id FROM n WHERE node_id IS NOT NULL GROUP BY ALL), m AS (SELECT c.*, t.node_id, path FROM c LEFT JOIN t USING (experiment, case_id) JOIN p USING (experiment, case_id))
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, good = F.col("doc_id"), F.col("quality") == 1
    return table(spark, sf_dir, "labels").select((d % 97).alias("experiment"), d.alias("case_id"), F.when(good, "direct_lookup").otherwise("relation").alias("cohort"), F.when(good, "lexical").otherwise("relation").alias("intended"), d.alias("expected_node_id"), (d % 31 != 4).alias("in_union"), (d % 43 != 5).alias("edges_unchanged"))


def _votes(cases: DataFrame) -> DataFrame:
    """Three judges for each case; some abstain, some leave the intended channel, and some choose another node."""
    d, j = F.col("case_id"), F.col("judge_id")
    none = (d * 7 + j * 3) % 11 == 0
    v = cases.select("experiment", "case_id", "intended", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("judge_id"))
    channel = F.when(none, "abstain").when((d + j) % 13 == 0, "lexical").otherwise(F.col("intended"))
    node = F.when(~none, F.when((d % 5 == 2) & (j < 2), d + 1).otherwise(d))
    return v.select("experiment", "case_id", "judge_id", channel.alias("channel"), node.alias("node_id"), F.when(~none, 1 + d % 4).alias("rank"), (d % 29 != 3).alias("path_matched"))


@query(PAIR + """SELECT experiment, round(avg(right_node::INT), 9) AS node_accuracy, round(avg(right_channel::INT), 9) AS channel_accuracy, round(avg((NOT has)::INT), 9) AS abstention_rate, round(avg(unanimous::INT), 9) AS unanimity, round(avg(coalesce(1.0 / rank, 0)), 9) AS selected_mrr, round(avg(in_union::INT), 9) AS union_coverage, round(avg(in_union::INT) - avg(right_node::INT), 9) AS oracle_gap FROM m GROUP BY experiment""")
def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of what majorities of judges choose."""
    c = _cases(spark, sf_dir)
    out = selection.selection_report(selection.decided(_votes(c), c))
    return out.select("experiment", *(F.round(x, 9).alias(x) for x in out.columns[1:]))


@query(PAIR + """, g AS (SELECT experiment, bool_and(has) AS a, bool_and(right_node) AS b, bool_and(cohort = 'relation' OR right_channel) AS l, bool_and(cohort <> 'relation' OR right_channel) AS r, bool_and(cohort <> 'relation' OR path) AS p, bool_and(edges_unchanged) AS e FROM m GROUP BY experiment),
k AS (SELECT experiment, min(n) >= 3 AS k FROM (SELECT experiment, judge_id, count(*) FILTER (node_id = case_id) AS n FROM v GROUP BY ALL) GROUP BY experiment)
SELECT experiment, unnest(['majority_exists_for_every_case', 'majority_selects_every_expected_node', 'lexical_controls_select_lexical', 'relation_case_selects_relation', 'relation_path_matches_after_projection', 'each_judge_selects_three_expected_nodes', 'search_does_not_change_edge_weights']) AS gate, unnest([a, b, l, r, p, k, e]) AS passed FROM g JOIN k USING (experiment)""")
def selection_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of choices of a channel and a node."""
    c = _cases(spark, sf_dir)
    v = _votes(c)
    return selection.selection_gates(selection.decided(v, c), v)


@query(NODE + """, g AS (SELECT experiment, bool_and(node_id IS NOT NULL) AS a, bool_and(coalesce(node_id = case_id, false)) AS b, bool_and(path) AS p, bool_and(edges_unchanged) AS e FROM m GROUP BY experiment)
SELECT experiment, unnest(['node_majority_exists_for_every_case', 'majority_selects_every_expected_node', 'selected_relation_paths_match', 'abstain_is_never_majority', 'search_and_scoring_do_not_change_edges']) AS gate, unnest([a, b, p, a, e]) AS passed FROM g""")
def node_first_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of choices of a node, whatever the channel."""
    c = _cases(spark, sf_dir)
    v = _votes(c)
    return selection.selection_gates(selection.decided(v, c, True), v, True)


@query("""WITH c AS (SELECT doc_id % 97 AS x, doc_id AS d, CASE WHEN quality = 1 THEN 'direct_lookup' ELSE 'relation' END AS cohort, CASE WHEN doc_id % 23 <> 3 THEN 1 + doc_id % 3 ELSE 11 END AS l, CASE WHEN doc_id % 11 <> 4 THEN 1 + doc_id % 4 ELSE 11 END AS r, CASE WHEN doc_id % 7 <> 5 THEN 1 + doc_id % 5 ELSE 11 END AS b FROM labels),
g AS (SELECT x, bool_and(d % 41 <> 1) AS g1, bool_and(cohort = 'relation' OR l <= b AND l <= 2) AS g2, bool_and(d % 37 <> 2) AS g3, bool_or(cohort = 'relation' AND r < b) AND coalesce(avg(1.0 / r) FILTER (cohort = 'relation') > avg(1.0 / b) FILTER (cohort = 'relation'), false) AS g4,
  bool_and(cohort <> 'relation' OR d % 29 <> 3) AS g5, bool_and(d % 53 <> 4) AS g6, bool_and(d % 59 <> 5) AS g7, bool_and(d % 43 <> 5) AS g8, x % 5 <> 0 AND x % 8 <> 7 AS g9, x % 7 <> 0 AND x % 8 <> 7 AS g10, x % 8 <> 7 AS g11, bool_and(d % 47 <> 6) AS g12 FROM c GROUP BY x)
SELECT x AS experiment, unnest(['lexical_lane_matches_isolated_bm25', 'lexical_controls_do_not_regress', 'relation_lane_matches_isolated_anchored_graph', 'relation_strictly_improves_bm25', 'relation_paths_match_and_exclude_zero_hop', 'no_cross_lane_combined_result', 'independent_trace_ids_share_query', 'search_does_not_change_edges', 'lexical_success_does_not_change_edges', 'relation_success_changes_only_credited_edges', 'cross_lane_trace_misuse_rejected', 'deterministic_lane_results']) AS gate, unnest([g1, g2, g3, g4, g5, g6, g7, g8, g9, g10, g11, g12]) AS passed FROM g""")
def channel_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve gates of both channels; some cases have no rank in a channel, some experiments no feedback."""
    c = _cases(spark, sf_dir)
    d, x = F.col("case_id"), F.col("experiment")
    rank = lambda n, every, at: F.when(d % every != at, (1 + d % n).cast("int"))
    flags = {"lexical_parity": d % 41 != 1, "relation_parity": d % 37 != 2, "path_matched": d % 29 != 3, "no_combined_result": d % 53 != 4, "traces_share_query": d % 59 != 5, "deterministic": d % 47 != 6}
    cases = c.withColumns({"lexical_rank": rank(3, 23, 3), "relation_rank": rank(4, 11, 4), "bm25_rank": rank(5, 7, 5), "acceptable_rank": F.lit(2)} | flags)
    fed = c.select("experiment").distinct().where(x % 8 != 7).select("experiment", (x % 5 != 0).alias("lexical_isolated"), (x % 7 != 0).alias("relation_isolated"), F.lit(True).alias("misuse_rejected"))
    return selection.channel_gates(cases, fed)
