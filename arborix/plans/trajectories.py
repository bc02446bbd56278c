"""Queries of searches at checkpoints: arms that learn from events in different ways, over a graph with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import checkpoints, experiments, feedback
from .queries import query, table
from .searches import event_edges

ARMS = {"control": None, "immediate": EngineConfig(), "siblings": EngineConfig(sibling_feedback_normalization=0.5)}
POINTS, LIMIT = (0, 10, 30, 100), 3
#: Events that a task replays.
EVENTS = 200_000

WEIGHTS = """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, value, 0.2 * least(1, greatest(0.1, value / 100)) AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
ks AS (SELECT user_id, list(DISTINCT event_type) AS ks FROM e GROUP BY user_id),
r AS (SELECT user_id, ks, list_transform(ks, lambda x: CAST(0.5 AS DOUBLE)) AS w, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq FROM ks
  UNION ALL
  SELECT r.user_id, ks, list_transform(range(1, len(ks) + 1), lambda j: CASE WHEN ks[j] = event_type THEN greatest(w[j], least(2.0, w[j] + up))
    ELSE greatest(0.0, w[j] - (greatest(w[list_position(ks, event_type)], least(2.0, w[list_position(ks, event_type)] + up)) - w[list_position(ks, event_type)]) * 0.5 / greatest(1, len(ks) - 1)) END), e.i, e.event_id
  FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1),
c AS (SELECT checkpoint, (SELECT max(event_id) FROM events) * checkpoint // 100 AS until FROM (SELECT CAST(unnest([0, 10, 30, 100]) AS INTEGER) AS checkpoint)),
cum AS (SELECT checkpoint, user_id, event_type, coalesce(sum(up) FILTER (event_id <= until), 0) AS up, count(*) FILTER (event_id <= until) AS n FROM e CROSS JOIN c GROUP BY checkpoint, user_id, event_type),
s AS (SELECT checkpoint, user_id, unnest(ks) AS event_type, unnest(w) AS w FROM (SELECT checkpoint, r.user_id, ks, w FROM r JOIN c ON r.seq <= c.until QUALIFY row_number() OVER (PARTITION BY checkpoint, r.user_id ORDER BY i DESC) = 1)),
w AS (SELECT 'control' AS arm, checkpoint, user_id, event_type, CAST(0.5 AS DOUBLE) AS w, n FROM cum UNION ALL SELECT 'immediate', checkpoint, user_id, event_type, least(2.0, 0.5 + up), n FROM cum
  UNION ALL SELECT 'siblings', checkpoint, user_id, event_type, s.w, n FROM s JOIN cum USING (checkpoint, user_id, event_type)),
"""
MEASURES = WEIGHTS + """t AS (SELECT a.event_type AS a, b.event_type AS b, x FROM (SELECT DISTINCT event_type FROM e) a, (SELECT event_type, round(avg(value) / 200, 6) AS x FROM e GROUP BY event_type) b WHERE a.event_type <> b.event_type),
p AS (SELECT arm, checkpoint, user_id, event_type AS node, w * 0.7 AS c, CAST(NULL AS VARCHAR) AS via FROM w WHERE w > 0 UNION ALL SELECT arm, checkpoint, user_id, b, w * 0.7 * x * 0.7, a FROM w JOIN t ON a = event_type WHERE w > 0),
g AS (SELECT user_id, ['headroom', 'control', 'ceiling'][user_id % 3 + 1] AS role, CASE user_id % 3 WHEN 0 THEN max_by(event_type, event_id) WHEN 1 THEN min(event_type) ELSE max(event_type) END AS target, CASE WHEN user_id % 3 = 1 THEN max(event_type) END AS via FROM e GROUP BY user_id),
a AS (SELECT arm, checkpoint, user_id, node, round(sum(c), 12) AS activation FROM p GROUP BY arm, checkpoint, user_id, node),
top AS (SELECT *, row_number() OVER (PARTITION BY arm, checkpoint, user_id ORDER BY activation DESC, node) AS rank FROM a QUALIFY rank <= 3),
ok AS (SELECT DISTINCT arm, checkpoint, user_id FROM p JOIN g USING (user_id) WHERE node = target AND p.via IS NOT DISTINCT FROM g.via),
new AS (SELECT n.arm, n.checkpoint, n.user_id, count(*) AS entered FROM top n LEFT JOIN top o ON o.arm = n.arm AND o.user_id = n.user_id AND o.node = n.node AND o.checkpoint = CASE n.checkpoint WHEN 10 THEN 0 WHEN 30 THEN 10 WHEN 100 THEN 30 END
  WHERE n.checkpoint > 0 AND o.node IS NULL GROUP BY n.arm, n.checkpoint, n.user_id),
sc AS (SELECT arm, checkpoint, user_id, role, coalesce(max(rank) FILTER (node = target), 4) AS rank, coalesce(max(activation) FILTER (node = target), 0) - coalesce(max(activation) FILTER (node <> target), 0) AS margin
  FROM (SELECT DISTINCT arm, checkpoint FROM w) v CROSS JOIN g LEFT JOIN top USING (arm, checkpoint, user_id) GROUP BY arm, checkpoint, user_id, role),
m AS (SELECT arm, checkpoint, role, count(*) AS n_cases, round(avg(1.0 / rank), 12) AS mrr, avg(margin) AS mean_margin, CAST(coalesce(sum(entered), 0) AS BIGINT) AS entered, bool_and(rank <= 3 AND ok.user_id IS NOT NULL) AS all_matched
  FROM sc LEFT JOIN new USING (arm, checkpoint, user_id) LEFT JOIN ok USING (arm, checkpoint, user_id) GROUP BY arm, checkpoint, role)
"""


def _setting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Seeds, cases, edges, events and checkpoints: users do kinds of events and learn what they do most; each kind leads to
    all others, by what these are worth on average, so there are cycles. A case for each user; those of one role expect a
    path of two steps."""
    e = event_edges(spark, sf_dir).select(F.concat(F.lit("user:"), "source_id").alias("source_id"), F.col("edge_type").alias("target_id"), F.lit("did").alias("edge_type"), "seq", "trace_id", "credit", F.lit("success").alias("kind"))
    raw = table(spark, sf_dir, "events").where("value is not null")
    worth = raw.groupBy(F.col("event_type").alias("target_id")).agg(F.round(F.avg("value") / 200, 6).alias("weight"))
    kinds = worth.select(F.col("target_id").alias("source_id"))  # kinds of events, a few
    leads = kinds.join(worth, F.col("source_id") != F.col("target_id")).select("source_id", "target_id", F.lit("leads_to").alias("edge_type"), "weight")
    edges = e.select(*feedback.EDGE).distinct().withColumn("weight", F.lit(0.5)).unionByName(leads).withColumns({"factuality": F.lit(1.0), "reinforced_count": F.lit(0)})
    user, t = F.concat(F.lit("user:"), F.col("case_id").cast("string")), F.col("event_type")
    of = raw.groupBy(F.col("user_id").alias("case_id")).agg(F.max_by(t, "event_id").alias("latest"), F.min(t).alias("least"), F.max(t).alias("most"))
    turn = F.col("case_id") % 3
    target = F.when(turn == 0, F.col("latest")).when(turn == 1, F.col("least")).otherwise(F.col("most"))
    step = lambda a, b, kind: F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("edge_type"))
    expected = F.when(turn == 1, F.array(step(user, F.col("most"), "did"), step(F.col("most"), target, "leads_to"))).otherwise(F.array(step(user, target, "did")))
    cases = of.select("case_id", F.element_at(F.array(*map(F.lit, checkpoints.ROLES)), (turn + 1).cast("int")).alias("role"), target.alias("target_id"), expected.alias("expected"))
    seeds = cases.select("case_id", user.alias("node_id"), F.lit(1.0).alias("entry"))
    top = table(spark, sf_dir, "events").agg(F.max("event_id").alias("m"))
    points = top.select(F.explode(F.array(*map(F.lit, POINTS))).alias("checkpoint"), "m").select("checkpoint", F.floor(F.col("m") * F.col("checkpoint") / 100).alias("until"))
    return seeds, cases, edges, e, points


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """checkpoints.scores and checkpoints.mutations of the arms."""
    seeds, cases, edges, e, points = _setting(spark, sf_dir)
    at = checkpoints.cut(experiments.replayed(edges, e, ARMS, points), 1 + e.count() // EVENTS)
    hits = checkpoints.shown(seeds, cases, edges, at, list(ARMS), POINTS, EngineConfig(max_hops=2), LIMIT)
    credited = e.join(F.broadcast(points), F.col("seq") <= F.col("until"))
    return checkpoints.scores(hits, cases, list(ARMS), POINTS, LIMIT), checkpoints.mutations(edges, at, credited)


@query(MEASURES + "SELECT arm, checkpoint, role, n_cases, round(mrr, 9) AS mrr, round(mean_margin, 9) AS mean_margin, entered, all_matched FROM m")
def checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, margins, changes of lists and expected paths of all cases, by arm, checkpoint and role: a control,
    reinforcement at once, and reinforcement that takes off siblings; every search runs over the weights of its version."""
    out = checkpoints.report(_scored(spark, sf_dir)[0])
    return out.select("arm", "checkpoint", "role", "n_cases", F.round("mrr", 9).alias("mrr"), F.round("mean_margin", 9).alias("mean_margin"), "entered", "all_matched")


@query(MEASURES + """, q AS (SELECT *, lag(mrr) OVER o AS before, first_value(mrr) OVER o AS start FROM m WINDOW o AS (PARTITION BY arm, role ORDER BY checkpoint)),
x AS (SELECT arm, checkpoint, count(*) FILTER (w <> 0.5) AS moved, bool_and((w <> 0.5) = (n > 0)) AS only_credited FROM w GROUP BY arm, checkpoint)
SELECT arm, checkpoint, 'expected_paths' AS gate, bool_and(all_matched) AS passed FROM m GROUP BY arm, checkpoint
UNION ALL SELECT arm, checkpoint, 'headroom_strict_improvement', mrr > start FROM q WHERE arm <> 'control' AND role = 'headroom' AND checkpoint = 100
UNION ALL SELECT arm, checkpoint, CASE role WHEN 'headroom' THEN 'headroom_intermediate_non_regression' ELSE role || '_case_non_regression' END, mrr >= before FROM q WHERE arm <> 'control' AND checkpoint > 0
UNION ALL SELECT arm, checkpoint, 'control_arm_non_regression', bool_and(mrr >= before) FROM q WHERE arm = 'control' AND checkpoint > 0 GROUP BY arm, checkpoint
UNION ALL SELECT arm, checkpoint, 'control_feedback_recorded_without_mutation', moved = 0 FROM x WHERE arm = 'control'
UNION ALL SELECT arm, checkpoint, 'treatment_credited_edges_only', only_credited FROM x WHERE arm <> 'control'""")
def trajectory_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gates of a trajectory hold in which arm, at which checkpoint; some fail here, above all those of siblings."""
    scored, moved = _scored(spark, sf_dir)
    return checkpoints.trajectory_gates(checkpoints.report(scored), moved, "control")


@query(MEASURES + """, x AS (SELECT arm, bool_and((w <> 0.5) = (n > 0)) AS ok, count(*) FILTER (w <> 0.5) AS moved FROM w WHERE checkpoint = 100 GROUP BY arm),
f AS (SELECT t.arm, round(avg(1.0 / c.rank), 12) AS control_mrr, round(avg(1.0 / t.rank), 12) AS mrr, avg(CAST(c.rank <= 3 AS DOUBLE)) AS control_recall, avg(CAST(t.rank <= 3 AS DOUBLE)) AS recall,
  bool_and(t.rank <= 3 OR c.rank > 3) AS recall_kept, bool_and(t.rank <= 3 AND ok.user_id IS NOT NULL) AS paths_matched
  FROM sc t JOIN sc c ON c.user_id = t.user_id AND c.checkpoint = 100 AND c.arm = 'control' LEFT JOIN ok ON ok.arm = t.arm AND ok.checkpoint = t.checkpoint AND ok.user_id = t.user_id
  WHERE t.checkpoint = 100 AND t.arm <> 'control' AND t.role = 'headroom' GROUP BY t.arm)
SELECT arm, round(control_mrr, 9) AS control_mrr, round(mrr, 9) AS mrr, round(control_recall, 9) AS control_recall, round(recall, 9) AS recall, recall_kept, paths_matched, mrr > control_mrr AS mrr_improved,
  x.ok AND (SELECT moved = 0 FROM x WHERE arm = 'control') AS only_credited FROM f JOIN x USING (arm)""")
def adaptation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRR and recall of arms that learn against the control after all events, and what is asked of them."""
    out = checkpoints.adaptation(*_scored(spark, sf_dir), "control", "headroom", LIMIT)
    return out.withColumns({c: F.round(c, 9) for c in ("control_mrr", "mrr", "control_recall", "recall")})
