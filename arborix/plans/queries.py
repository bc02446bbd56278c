"""Queries of the retrieval engine over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import redacted
from ..operators import dense, feedback, graph, metrics, ranking, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORDS = "the and attion anea, there and"


def query(sql: str | None):  # noqa: ANN201
    """Registers a query; without SQL, tests hold it against a plain version."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")


def asked(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(WORDS).alias("text"))


TOKENS = r"regexp_extract_all(replace(replace(lower({}),'ß','ss'),'ς','σ'),'[\p{{L}}\p{{N}}]+')"
BM25 = f"""
WITH toks AS (SELECT doc_id AS node_id, {TOKENS.format("text")} AS t FROM documents),
dl AS (SELECT node_id, len(t) AS dl, t FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TOKENS.format("'" + WORDS + "'")}) AS term) GROUP BY term),
post AS (SELECT node_id, dl, term, count(*) AS tf FROM (SELECT node_id, dl, unnest(t) AS term FROM dl) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT node_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
  FROM post JOIN df USING (term) JOIN q USING (term), stats GROUP BY node_id)
"""


@query(f"SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, term and document frequencies."""
    return retrieval.postings(text_nodes(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(BM25 + "SELECT node_id, round(score, 6) AS score, round(score / (SELECT max(score) FROM bm), 6) AS entry FROM bm")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of all documents that hold a term of the query, and max-normalised."""
    found = retrieval.bm25(text_nodes(spark, sf_dir), asked(spark))
    entry = retrieval.entry_scores(found, None, EngineConfig())
    return found.join(entry, ["query_id", "node_id"]).select("node_id", F.round("score", 6).alias("score"), F.round("entry", 6).alias("entry"))


@query(BM25 + "SELECT node_id, CAST(row_number() OVER (ORDER BY score DESC, node_id) AS INTEGER) AS rank, round(score, 6) AS score FROM bm QUALIFY rank <= 10")
def lexical_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K7: the ten best by BM25; copies of a text tie, and stand by their ids."""
    return ranking.top(retrieval.bm25(text_nodes(spark, sf_dir), asked(spark)), "score", 10, ranking.TIES).select("node_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS node_id, round(greatest(0, list_cosine_similarity(v.v, q.v)), 12) AS score FROM v, v q WHERE q.vec_id % 20 = 0)
SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by cosine of every twentieth vector: blocks of queries, matrix products, ten a task and query."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))
    found = dense.nearest(v, q, 10)
    return ranking.top(found, "score", 10).select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier and supplier -> nation."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    first = l.groupBy("l_partkey", "l_suppkey").agg((1 - F.min(F.col("l_discount").cast("double")) * 5).alias("weight"), (1 - F.min(F.col("l_tax").cast("double"))).alias("factuality"))
    first = first.select(name("part", "l_partkey").alias("source_id"), name("supplier", "l_suppkey").alias("target_id"), F.lit("supplied_by").alias("edge_type"), "weight", "factuality")
    second = table(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey").alias("source_id"), name("nation", "s_nationkey").alias("target_id"), F.lit("located_in").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit(1.0).alias("factuality"))
    return first.unionByName(second)


EDGES = """
WITH RECURSIVE edges AS (
  SELECT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'supplied_by' AS edge_type,
    1 - min(CAST(l_discount AS DOUBLE)) * 5 AS weight, 1 - min(CAST(l_tax AS DOUBLE)) AS factuality
  FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL
  SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 0.8, 1.0 FROM supplier),
seeds AS (SELECT p_partkey // 20 AS query_id, 'part:' || p_partkey AS node_id, CAST(0.5 AS DOUBLE) + (p_partkey % 2) / 2.0 AS entry FROM part),
"""
HOPS = """
h1 AS (SELECT query_id, s.node_id AS seed, e.target_id AS node_id, s.entry * weight * factuality * 0.7 AS c FROM seeds s JOIN edges e ON e.source_id = s.node_id WHERE s.entry * weight * factuality * 0.7 > 0),
h2 AS (SELECT query_id, h.seed, e.target_id AS node_id, h.c * weight * factuality * 0.7 AS c FROM h1 h JOIN edges e ON e.source_id = h.node_id WHERE e.target_id <> h.seed AND h.c * weight * factuality * 0.7 > 0),
act AS (SELECT query_id, node_id, sum(c) AS activation, count(*) AS n_paths FROM (SELECT query_id, node_id, entry AS c FROM seeds UNION ALL SELECT query_id, node_id, c FROM h1 UNION ALL SELECT query_id, node_id, c FROM h2) GROUP BY ALL)
"""


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, twenty to a query."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(p / 20).cast("long").alias("query_id"), F.concat(F.lit("part:"), p.cast("string")).alias("node_id"), (F.lit(0.5) + p % 2 / 2.0).alias("entry"))


@query(EDGES + HOPS + "SELECT query_id, node_id, round(activation, 10) AS activation, n_paths FROM act")
def additive_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: activation along all simple paths of two hops."""
    c = EngineConfig()
    found = graph.paths(part_seeds(spark, sf_dir), typed_edges(spark, sf_dir), c)
    return graph.activation(found, c).select("query_id", "node_id", F.round("activation", 10).alias("activation"), "n_paths")


@query(EDGES + """
h1 AS (SELECT query_id, s.node_id AS seed, e.target_id AS node_id, s.entry * weight * factuality * 0.7 AS c FROM seeds s JOIN edges e ON e.source_id = s.node_id WHERE s.entry * weight * factuality * 0.7 > 0),
b1 AS (SELECT query_id, seed, node_id, c * least(1.0, 1.0 / sum(c) OVER (PARTITION BY query_id)) AS c FROM h1),
h2 AS (SELECT query_id, h.seed, e.target_id AS node_id, h.c * weight * factuality * 0.7 AS c FROM b1 h JOIN edges e ON e.source_id = h.node_id WHERE e.target_id <> h.seed AND h.c * weight * factuality * 0.7 > 0),
b2 AS (SELECT query_id, seed, node_id, c * least(1.0, 1.0 / sum(c) OVER (PARTITION BY query_id)) AS c FROM h2)
SELECT query_id, node_id, round(sum(c), 6) AS activation, count(*) AS n_paths FROM (SELECT query_id, node_id, entry AS c FROM seeds UNION ALL SELECT query_id, node_id, c FROM b1 UNION ALL SELECT query_id, node_id, c FROM b2) GROUP BY ALL""")
def budget_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As G1, each hop scaled to a budget of 1."""
    c = EngineConfig(activation_strategy="finite_activation_budget")
    found = graph.paths(part_seeds(spark, sf_dir), typed_edges(spark, sf_dir), c)
    return graph.activation(found, c).select("query_id", "node_id", F.round("activation", 6).alias("activation"), "n_paths")


@query(EDGES + HOPS + """SELECT query_id, node_id, round(a, 10) AS activation FROM (SELECT query_id, node_id, activation - 0.1 * max(activation) OVER (PARTITION BY query_id) AS a FROM act) WHERE a > 0""")
def lateral_inhibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the greatest activation off all."""
    c = EngineConfig(activation_strategy="lateral_inhibition", inhibition_ratio=0.1)
    found = graph.paths(part_seeds(spark, sf_dir), typed_edges(spark, sf_dir), c)
    return graph.activation(found, c).select("query_id", "node_id", F.round("activation", 10).alias("activation"))


FUSED = EDGES + HOPS + """, both_ AS (SELECT query_id, node_id, coalesce(entry, 0) AS entry, greatest(coalesce(activation, 0), 0) AS g FROM act FULL JOIN seeds USING (query_id, node_id)),
norm AS (SELECT query_id, node_id, entry, g / max(g) OVER (PARTITION BY query_id) AS graph FROM both_)
"""


@query(FUSED + "SELECT query_id, node_id, round(entry * 0.55 + graph * 0.45, 6) AS final FROM norm")
def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3, K6: entry and max-normalised graph scores, blended."""
    c, s = EngineConfig(), part_seeds(spark, sf_dir)
    act = graph.activation(graph.paths(s, typed_edges(spark, sf_dir), c), c)
    return ranking.fused(s, act, c).select("query_id", "node_id", F.round("final", 6).alias("final"))


@query(FUSED + """, r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(entry, 9) DESC, node_id) AS re, CASE WHEN graph > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY round(graph, 9) DESC, node_id) END AS rg FROM norm)
SELECT query_id, node_id, round(0.55 / (60 + re) + 0.45 * coalesce(1.0 / (60 + rg) - 1.0 / (60 + count(rg) OVER (PARTITION BY query_id) + 1), 0), 6) AS final FROM r""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K4: reciprocal ranks, with the last graph rank worth nothing; scores are compared to 9 digits."""
    c, s = EngineConfig(final_fusion_strategy="rrf"), part_seeds(spark, sf_dir)
    act = graph.activation(graph.paths(s, typed_edges(spark, sf_dir), c), c)
    return ranking.fused(s, act, c).select("query_id", "node_id", F.round("final", 6).alias("final"))


@query("""WITH RECURSIVE t AS (SELECT max(epoch(ts)) AS now FROM events),
e AS (SELECT user_id, epoch(ts) AS z, least(1, greatest(0.1, value / 100)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, i, z, least(1.5, v) AS a FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.z, least(1.5, r.a * pow(0.5, greatest(0, e.z - r.z) / 86400.0) + e.v) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS node_id, round(arg_max(a, i) * pow(0.5, greatest(0, any_value(now) - arg_max(z, i)) / 86400.0), 6) AS activation, count(*) AS n FROM r, t GROUP BY user_id""")
def activation_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed activation of each user as of the last event, cut at each event at 1.5."""
    e = table(spark, sf_dir, "events").where("value is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = e.select(F.col("user_id").alias("node_id"), at.alias("at"), F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("value") / 100)).alias("value"))
    now = table(spark, sf_dir, "events").agg(F.max(at).alias("now"))
    out = feedback.activation_history(e.join(F.broadcast(now)), F.col("now"), 86_400.0, 1.5)
    return out.select("node_id", F.round("activation", 6).alias("activation"), "n")


@query("""WITH f AS (SELECT user_id AS trace_id, event_type AS edge_type, min(event_id) AS seq FROM events GROUP BY ALL)
SELECT trace_id, edge_type, row_number() OVER (PARTITION BY edge_type ORDER BY seq, trace_id) AS evidence_count, row_number() OVER (PARTITION BY edge_type ORDER BY seq, trace_id) >= 3 AS activated FROM f""")
def evidence_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct traces of each edge in order; the third and all later ones activate."""
    e = table(spark, sf_dir, "events").select(F.lit("s").alias("source_id"), F.lit("t").alias("target_id"), F.col("event_type").alias("edge_type"), F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"))
    return feedback.quorum(e, 3).select("trace_id", "edge_type", F.col("evidence_count").cast("long").alias("evidence_count"), "activated")


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS trace_id, user_id AS node_id, event_id // 100 AS batch, event_id AS seq, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS stage, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
k AS (SELECT trace_id, list(DISTINCT node_id) AS ks FROM e GROUP BY trace_id),
r AS (SELECT trace_id, ks, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS batch, CAST(-1 AS BIGINT) AS seq, true AS ok, false AS changed, list_transform(ks, lambda x: 0) AS kept, list_transform(ks, lambda x: 0) AS tried FROM k
  UNION ALL
  SELECT trace_id, ks, i, batch, seq, ok AND stage - tried[place] IN (0, 1), stage <> tried[place], kept, list_transform(range(1, len(ks) + 1), lambda j: CASE WHEN j = place AND ok AND stage - tried[place] IN (0, 1) THEN stage ELSE tried[j] END)
  FROM (SELECT r.trace_id, ks, e.i, e.batch, e.seq, e.stage, list_position(ks, e.node_id) AS place, e.batch <> r.batch OR r.ok AS ok,
      CASE WHEN e.batch <> r.batch AND r.ok THEN r.tried ELSE r.kept END AS kept,
      CASE WHEN e.batch = r.batch OR r.ok THEN r.tried ELSE r.kept END AS tried
    FROM r JOIN e ON e.trace_id = r.trace_id AND e.i = r.i + 1))
SELECT trace_id, seq, changed AND accepted AS changed, accepted FROM (SELECT trace_id, seq, changed, bool_and(ok) OVER (PARTITION BY trace_id, batch) AS accepted FROM r WHERE i > 0)""")
def stage_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests of a trace take allowed steps only; a refused one moves no stage."""
    t = F.col("event_type")
    stage = F.when(t == "view", 1).when(t == "click", 2).when(t == "purchase", 3).otherwise(0)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("trace_id"), F.col("user_id").cast("string").alias("node_id"), F.floor(F.col("event_id") / 100).cast("long").alias("batch"), F.col("event_id").alias("seq"), stage.alias("stage"))
    return feedback.stages(e).select("trace_id", "seq", "changed", "accepted")


@query("""WITH c AS (SELECT user_id AS source_id, event_type AS edge_type, least(1, greatest(0.1, value / 100)) AS credit FROM events WHERE value IS NOT NULL)
SELECT source_id, edge_type, round(greatest(0.5, least(2.0, 0.5 + 0.2 * sum(credit))), 6) AS new_weight, count(*) AS reinforced FROM c GROUP BY ALL""")
def immediate_reinforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after all credits, up to the maximum."""
    e = table(spark, sf_dir, "events").where("value is not null")
    credit = e.select(F.col("user_id").alias("source_id"), F.lit("t").alias("target_id"), F.col("event_type").alias("edge_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("value") / 100)).alias("credit"))
    edges = credit.select(*feedback.EDGE).distinct().withColumn("weight", F.lit(0.5))
    return feedback.reinforced(edges, credit, 0.2, 2.0).select("source_id", "edge_type", F.round("new_weight", 6).alias("new_weight"), "reinforced")


@query("""WITH r AS (SELECT l.doc_id AS query_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS cohort, 1 + l.doc_id % 7 AS rank FROM labels l)
SELECT coalesce(cohort, 'overall') AS cohort, count(*) AS n_cases, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3
FROM r GROUP BY GROUPING SETS ((cohort), ())""")
def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: MRR and hit rates of each cohort and overall."""
    r = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("cohort"), (1 + F.col("doc_id") % 7).alias("rank"))
    return metrics.cohort_metrics(r).select("cohort", "n_cases", *(F.round(c, 6).alias(c) for c in ("mrr", "hit_1", "hit_3")))


@query("""WITH v AS (SELECT conv_id AS case_id, role AS choice, count(*) AS n FROM conversations GROUP BY ALL)
SELECT case_id, CASE WHEN n * 3 >= 6 THEN choice END AS choice, n FROM v QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, choice) = 1""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of each case that has a majority of three."""
    return metrics.majority(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("role").alias("choice")))


PATTERNS = (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9a-f]{32,}", r"AKIA[A-Z0-9]{12,}")


@query(r"""WITH a AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS c1, regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[REDACTED_SECRET]', 'g') AS t1 FROM documents),
b AS (SELECT doc_id, c1, len(regexp_extract_all(t1, '[0-9a-f]{32,}')) AS c2, regexp_replace(t1, '[0-9a-f]{32,}', '[REDACTED_SECRET]', 'g') AS t2 FROM a)
SELECT doc_id, CAST(c1 + c2 + len(regexp_extract_all(t2, 'AKIA[A-Z0-9]{12,}')) AS INTEGER) AS n_redacted, sha256(regexp_replace(t2, 'AKIA[A-Z0-9]{12,}', '[REDACTED_SECRET]', 'g')) AS text_sha256 FROM b""")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted texts, by their digest, and how much was redacted."""
    text, n = redacted(F.col("text"), PATTERNS)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_redacted"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


@query("""WITH a AS (SELECT conv_id, turn, sha256(text) AS s FROM conversations), b AS (SELECT conv_id, turn - 1 AS turn, s FROM a WHERE turn > 0)
SELECT conv_id, turn, a.s AS before, b.s AS after FROM a FULL JOIN b USING (conv_id, turn) WHERE a.s IS DISTINCT FROM b.s""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots, null-safe (each turn against the next)."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("s"))
    b = a.where("turn > 0").withColumn("turn", F.col("turn") - 1)
    return metrics.edge_changes(a, b, ["conv_id", "turn"], "s")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_channel(spark, sf_dir)


