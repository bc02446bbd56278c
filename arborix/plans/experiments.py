"""Queries of experiments, checks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import checks
from ..operators import channels, corpus, experiments, feedback, judgments, metrics, retrieval
from .queries import query, table, text_nodes, typed_edges
from .searches import event_edges, name_queries, part_nodes

SIDE = """WITH top AS (SELECT max(event_id) AS m FROM events), c AS (SELECT unnest([0, 10, 30, 100]) AS checkpoint),
e AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_type AS edge_type, event_id AS seq, least(1, greatest(0.1, value / 100)) AS credit FROM events WHERE value IS NOT NULL),
k AS (SELECT DISTINCT source_id, edge_type FROM e)
"""


@query(SIDE + """, i AS (SELECT checkpoint, k.source_id, k.edge_type, coalesce(sum(credit), 0) AS credit, count(credit) AS n FROM c CROSS JOIN top CROSS JOIN k LEFT JOIN e ON e.source_id = k.source_id AND e.edge_type = k.edge_type AND seq <= m * checkpoint // 100 GROUP BY ALL)
SELECT 'control' AS arm, CAST(checkpoint AS INTEGER) AS checkpoint, source_id, edge_type, CAST(0.5 AS DOUBLE) AS weight, 0 AS reinforced_count FROM i
UNION ALL SELECT 'immediate', checkpoint, source_id, edge_type, round(least(2.0, 0.5 + 0.2 * credit), 9), n FROM i""")
def arm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a control and a treatment after none, a tenth, three tenths and all of the events; what searches
    make of such weights, and gates, are in checkpoint_report, trajectory_gates and adaptation_report."""
    e = event_edges(spark, sf_dir).withColumn("kind", F.lit("success"))
    edges = e.select(*feedback.EDGE).distinct().withColumns({"weight": F.lit(0.5), "reinforced_count": F.lit(0)})
    top = table(spark, sf_dir, "events").agg(F.max("event_id").alias("m"))
    at = top.select(F.explode(F.array(*map(F.lit, (0, 10, 30, 100)))).alias("checkpoint"), "m").select("checkpoint", F.floor(F.col("m") * F.col("checkpoint") / 100).alias("until"))
    out = experiments.replayed(edges, e, {"control": None, "immediate": EngineConfig()}, at)
    return out.select("arm", "checkpoint", "source_id", "edge_type", F.round("weight", 9).alias("weight"), "reinforced_count")


VARIANTS = """WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'current' WHEN 'click' THEN 'recurrent-balanced' WHEN 'signup' THEN 'bm25-only' ELSE event_type END AS variant_id, user_id AS case_id,
  ['direct_lookup', 'relation', 'negative_control'][user_id % 3 + 1] AS cohort, 1 + min(event_id % 7) AS rank, count(*) AS expansions, 1 AS complexity FROM events GROUP BY ALL),
b AS (SELECT r.*, n.rank AS old FROM r LEFT JOIN (SELECT case_id, rank FROM r WHERE variant_id = 'current') n USING (case_id)),
p AS (SELECT variant_id, coalesce(avg(1.0 / rank) FILTER (cohort = 'direct_lookup'), 0) AS d, coalesce(avg(1.0 / rank) FILTER (cohort = 'relation'), 0) AS r, coalesce(avg(1.0 / rank) FILTER (cohort = 'negative_control'), 0) AS g, avg(expansions) AS x,
  variant_id <> 'error' AS iso, bool_and(cohort <> 'relation' OR case_id % 9 <> 4 OR variant_id <> 'purchase') AS paths, variant_id <> 'bm25-only' AS edges, variant_id <> 'recurrent-balanced' AS again, count(*) FILTER (rank < old) AS up, count(*) FILTER (rank < old AND cohort = 'relation') AS rel_up, count(*) FILTER (rank > old AND cohort <> 'relation') AS down FROM b GROUP BY variant_id),
o AS (SELECT d AS d0, r AS r0, g AS g0 FROM p WHERE variant_id = 'current'), w AS (SELECT r AS r1 FROM p WHERE variant_id = 'recurrent-balanced')
"""


def variant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as variants, users as cases. One kind changes what it isn't credited for, one misses some paths of
    relations, one shows paths without steps, one can't be recomputed."""
    t, k = F.col("event_type"), F.col("user_id")
    name = F.when(t == "view", "current").when(t == "click", "recurrent-balanced").when(t == "signup", "bm25-only").otherwise(t)
    cohort = F.element_at(F.array(*map(F.lit, experiments.COHORTS)), (k % 3 + 1).cast("int"))
    r = table(spark, sf_dir, "events").groupBy(name.alias("variant_id"), k.alias("case_id"), cohort.alias("cohort"))
    r = r.agg((1 + F.min(F.col("event_id") % 7)).alias("rank"), F.count("*").alias("expansions"), F.lit(1).alias("complexity"))
    v, c = F.col("variant_id"), F.col("case_id")
    lost = (v == "purchase") & (c % 9 == 4) | (v == "bm25-only") & (c % 3 == 0)  # the first are relations, the second controls
    flags = (~lost, v != "error", F.lit(True), v != "bm25-only", v != "recurrent-balanced")
    return r.withColumns(dict(zip(experiments.FLAGS, flags, strict=True)))


@query(VARIANTS + "SELECT variant_id, round(d, 9) AS direct_lookup_mrr, round(r, 9) AS relation_mrr, round(g, 9) AS negative_control_mrr, round(x, 9) AS mean_expansions, up AS n_improved, rel_up AS n_relation_improved, down AS n_control_worsened FROM p")
def variant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant's measures."""
    out = experiments.variant_report(variant_results(spark, sf_dir))
    return out.select("variant_id", *(F.round(c, 9).alias(c) for c in (*(f"{c}_mrr" for c in experiments.COHORTS), "mean_expansions")), "n_improved", "n_relation_improved", "n_control_worsened")


@query(VARIANTS + """SELECT 'local' AS family, variant_id, r > r0 AND r > r1 AND d >= d0 AND g >= g0 AND iso AND paths AND variant_id NOT IN ('current', 'recurrent-balanced') AS passed FROM p, o, w
UNION ALL SELECT 'anchored', variant_id, r > r0 AND d >= d0 AND g >= g0 AND iso AND paths AND edges AND variant_id NOT IN ('current', 'bm25-only') FROM p, o
UNION ALL SELECT 'fusion', variant_id, r > r0 AND d >= d0 AND g >= g0 AND iso AND paths AND edges AND again AND down = 0 AND rel_up > 0 AND variant_id <> 'current' FROM p, o""")
def variant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: which variants pass the gates of each family."""
    report = experiments.variant_report(variant_results(spark, sf_dir))
    one = lambda f: experiments.gates(report, f).select(F.lit(f).alias("family"), "variant_id", "passed")
    return one("local").unionByName(one("anchored")).unionByName(one("fusion"))


@query(VARIANTS + """, a AS (SELECT 'local' AS family, variant_id, r > r0 AND r > r1 AND d >= d0 AND g >= g0 AND iso AND paths AND variant_id NOT IN ('current', 'recurrent-balanced') AS passed, least(d, r, g) AS k1, r AS k2, x FROM p, o, w
UNION ALL SELECT 'anchored', variant_id, r > r0 AND d >= d0 AND g >= g0 AND iso AND paths AND edges AND variant_id NOT IN ('current', 'bm25-only'), r, least(d, r, g), x FROM p, o)
SELECT family, variant_id FROM a WHERE passed OR variant_id = 'current' QUALIFY row_number() OVER (PARTITION BY family ORDER BY passed DESC, k1 DESC, k2 DESC, x, variant_id) = 1""")
def variant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the variant that each family keeps."""
    report = experiments.variant_report(variant_results(spark, sf_dir))
    one = lambda f: experiments.chosen(experiments.gates(report, f), f).select(F.lit(f).alias("family"), "variant_id")
    return one("local").unionByName(one("anchored"))


@query("""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'relation' WHEN toxic = 1 THEN 'negative_control' ELSE 'direct_lookup' END AS cohort, 2 + doc_id % 5 AS b, 1 + doc_id % 5 + toxic AS g FROM labels)
SELECT 'H1' AS id, CASE WHEN (SELECT avg(1.0 / g) > avg(1.0 / b) AND count(*) FILTER (g < b) > count(*) FILTER (g > b) FROM c WHERE cohort = 'relation') THEN 'supported' ELSE 'inconclusive' END AS status
UNION ALL SELECT 'H2', CASE WHEN bool_or(g > 6 OR b - g < -1) THEN 'unsupported' WHEN bool_and(b >= g) THEN 'supported' ELSE 'inconclusive' END FROM c WHERE cohort <> 'relation'
UNION ALL SELECT 'H3', CASE WHEN bool_and(quality = 1) THEN 'supported' ELSE 'unsupported' END FROM labels
UNION ALL SELECT 'H4', CASE WHEN count(*) > 0 THEN 'supported' ELSE 'inconclusive' END FROM labels""")
def hypothesis_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: what four hypotheses come to; labels stand in for cases, explanations and feedback."""
    x, d = table(spark, sf_dir, "labels"), F.col("doc_id") % 5
    cohort = F.when(F.col("quality") == 1, "relation").when(F.col("toxic") == 1, "negative_control").otherwise("direct_lookup")
    cases = x.select(cohort.alias("cohort"), (2 + d).alias("baseline_rank"), (1 + d + F.col("toxic")).alias("graph_rank"), F.lit(6).alias("acceptable_rank"))
    fed = x.select(F.lit(1).alias("changed_edges"), F.lit(0).alias("uncredited_edge_changes"), F.lit(0).alias("non_target_rank_changes"))
    return experiments.hypotheses(cases, x.select((F.col("quality") == 1).alias("matched")), fed)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS s, event_type AS t, max(value) AS v, bool_or(event_type = 'purchase') AS c FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN c THEN 'credited' ELSE 'uncredited' END AS role, count(*) FILTER (c AND v > 50) AS changed, count(*) FILTER (NOT (c AND v > 50)) AS untouched FROM e GROUP BY c""")
def feedback_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credited and other edges, before and after; purchases over 50 raise theirs."""
    e = event_edges(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq").groupBy(*feedback.EDGE).agg(F.max("value").alias("value"))
    own = F.col("edge_type") == "purchase"
    after = e.select(*feedback.EDGE, F.when(own & (F.col("value") > 50), 0.7).otherwise(0.5).alias("weight"))
    return experiments.isolation(e.withColumn("weight", F.lit(0.5)), after, e.where(own))


@query("""WITH i AS (SELECT lang AS split, 'source' AS kind, source AS identifier FROM documents UNION ALL SELECT lang, 'text', sha256(text) FROM documents WHERE text IS NOT NULL),
n AS (SELECT kind, identifier, count(*) AS n, count(DISTINCT split) AS s FROM i GROUP BY ALL) SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > s) AS repeated, count(*) FILTER (s > 1) AS shared FROM n GROUP BY kind""")
def identity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and texts that stand twice in a language, and in several."""
    d = table(spark, sf_dir, "documents")
    one = lambda k, c: d.where(c.isNotNull()).select(F.col("lang").alias("split"), F.lit(k).alias("kind"), c.alias("identifier"))
    return experiments.registry(one("source", F.col("source")).unionByName(one("text", F.sha2(F.col("text").cast("binary"), 256))))


@query("""WITH s AS (SELECT event_type AS arm, user_id AS case_id, event_id AS node_id, value AS v FROM events WHERE value IS NOT NULL), t AS (SELECT user_id AS case_id, min(event_id) AS target FROM events GROUP BY ALL)
SELECT arm, case_id, round(coalesce(max(v) FILTER (node_id = target), 0) - coalesce(max(v) FILTER (node_id <> target), 0), 6) AS margin FROM s JOIN t USING (case_id) GROUP BY ALL""")
def target_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each case's target stands before the best of the others."""
    e = table(spark, sf_dir, "events")
    s = e.where("value is not null").select(F.col("event_type").alias("arm"), F.lit(0).alias("checkpoint"), F.col("user_id").alias("case_id"), F.col("event_id").alias("node_id"), F.col("value").alias("final"))
    t = e.groupBy(F.col("user_id").alias("case_id")).agg(F.min("event_id").alias("target_id"))
    return experiments.margins(s, t).select("arm", "case_id", F.round("margin", 6).alias("margin"))


@query("SELECT 'left' AS side, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'right', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two results don't share: keys of parts and of suppliers."""
    return experiments.differences(*(table(spark, sf_dir, t).select(F.col(k).alias("key")) for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey"))))


@query("""SELECT page_id, regexp_matches(url, '^https://[^\\s/?#@]+([/?#]\\S*)?$') AS secure, regexp_matches(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') OR NOT regexp_matches(html, '\\S') OR length(html) > 8192 AS rejected,
sha256(concat(page_id, chr(0), url)) AS contribution_id FROM pages""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, texts and ids of pages."""
    return table(spark, sf_dir, "pages").select("page_id", checks.secure_url(F.col("url")).alias("secure"), (~checks.bounded_text(F.col("html"), 8192)).alias("rejected"), checks.contribution_id(F.col("page_id"), F.col("url")).alias("contribution_id"))


@query("SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q, count(*) AS n FROM conversations GROUP BY q")
def normalised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, folded in white space and case."""
    return table(spark, sf_dir, "conversations").groupBy(corpus.normalised_query(F.col("text")).alias("q")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT user_id, event_type AS edge_type FROM events) SELECT edge_type, count(*) AS evidence, greatest(1, 1000 - count(*)) AS first_mutation FROM f GROUP BY edge_type""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each edge, and how much more it needs for a quorum of a thousand."""
    n = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("edge_type")).distinct().groupBy("edge_type").agg(F.count("*").alias("evidence"))
    return n.withColumn("first_mutation", checks.first_mutation(1000, F.col("evidence")))


@query("""WITH n AS (SELECT conv_id, CASE WHEN max(turn) > 3 THEN 'superseded' ELSE 'active' END AS life FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id AS s, conv_id + 1 AS t FROM n)
SELECT 'dangling_target_id' AS reason, s || '>' || t || '>supersedes' AS id FROM r WHERE t NOT IN (SELECT conv_id FROM n)
UNION ALL SELECT 'superseded_without_successor', CAST(conv_id AS VARCHAR) FROM n WHERE life = 'superseded' AND conv_id NOT IN (SELECT t FROM r)
UNION ALL SELECT 'successor_of_unsuperseded', CAST(t AS VARCHAR) FROM r WHERE t NOT IN (SELECT conv_id FROM n WHERE life = 'superseded')""")
def judgment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation supersedes the next; long ones are superseded."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(F.max("turn") > 3, "superseded").otherwise("active").alias("lifecycle"))
    n = c.select(F.col("conv_id").cast("string").alias("judgment_id"), "lifecycle")
    r = c.select(F.col("conv_id").cast("string").alias("source_id"), (F.col("conv_id") + 1).cast("string").alias("target_id"), F.lit("supersedes").alias("relation_type"))
    return judgments.audit(n, r)


@query("""WITH a AS (SELECT doc_id AS query_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS cohort, 1 + doc_id % 7 AS a, 1 + doc_id % 5 AS b FROM labels)
SELECT CASE WHEN a > b THEN 'improved' WHEN a < b THEN 'worsened' ELSE 'equal' END AS outcome, count(*) AS n, CAST(sum(a - b) AS BIGINT) AS rank_delta FROM a GROUP BY 1""")
def rank_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: cases that rise, fall and stay."""
    x = table(spark, sf_dir, "labels")
    rank = lambda n: x.select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("cohort"), (1 + F.col("doc_id") % n).alias("rank"))
    return metrics.rank_changes(rank(7), rank(5))


@query("""WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5)
SELECT l.doc_id AS query_id, CAST(coalesce(h.rank, 6) AS INTEGER) AS rank FROM (SELECT doc_id, source FROM labels JOIN documents USING (doc_id)) l LEFT JOIN h USING (source, doc_id)""")
def expected_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: where each labelled document stands among the five longest of its source; behind them if it doesn't."""
    d = table(spark, sf_dir, "documents")
    w = metrics.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    hits = d.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(F.col("source").alias("query_id"), F.col("doc_id").alias("node_id"), "rank")
    cases = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("expected_node_id"))
    return metrics.expected_ranks(cases, hits, 5).select(F.col("expected_node_id").alias("query_id"), "rank")


@query(None)
def channel_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: what both channels show for parts' names; none of the driver's edges leads to a part, so they seldom share a node."""
    nodes, asked = part_nodes(spark, sf_dir), name_queries(spark, sf_dir)
    relation = channels.relation_channel(nodes, typed_edges(spark, sf_dir), asked, EngineConfig(), 10)
    return channels.agreement(channels.lexical_channel(nodes, asked, 10), relation)


@query(None)
def case_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a benchmark's items with the best documents of each, and whether one holds an answer."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    nodes = text_nodes(spark, sf_dir)
    scores = retrieval.bm25(nodes, asked).withColumn("score", F.round("score", 9))  # copies of a text tie, in whatever order sums are made
    best = nodes.join(F.broadcast(channels.ranking.top(scores, "score", 3)), "node_id")  # three an item: texts stay where they are
    hits = best.select(F.col("query_id").alias("case_id"), F.lit("lexical").alias("channel"), "rank", F.col("node_id").cast("string").alias("node_id"), "text")
    made = experiments.packets(asked.select(F.col("query_id").alias("case_id"), F.col("text").alias("query")), hits)
    return made.select("case_id", "packet_sha256", corpus.forbidden_keys(F.col("packet"), ["answer", "score", "expected_node_id"]).alias("holds_answer"), checks.private_content(F.col("packet")).alias("private"))
