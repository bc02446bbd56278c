"""Queries of corpus checks, judgments and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..operators import corpus, judgments, metrics, payloads, snapshots
from ..sources import store
from .queries import query, table


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 AND NOT contains(text, CASE WHEN contains(text, chr(13)) THEN chr(13) || chr(10) ELSE chr(10) END) THEN 'raw_match' WHEN NOT contains(text, chr(13)) AND NOT contains(text, chr(10)) THEN 'rejected_no_newline_conversion'
WHEN contains(replace(text, chr(13) || chr(10), ''), chr(13)) THEN 'rejected_bare_cr' WHEN contains(text, chr(13)) AND contains(replace(text, chr(13) || chr(10), ''), chr(10)) THEN 'rejected_mixed_newlines'
WHEN doc_id % 3 = 1 AND contains(text, chr(13)) THEN 'newline_equivalent_crlf_to_lf' WHEN doc_id % 3 = 1 THEN 'newline_equivalent_lf_to_crlf' ELSE 'rejected_hash_mismatch' END AS decision FROM documents WHERE text IS NOT NULL""")
def hash_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against digests of themselves, of their other line ends, and of something else."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lf, crlf = F.lit("\n"), F.lit("\r\n")
    other = F.when(F.contains("text", F.lit("\r")), F.replace("text", crlf, lf)).otherwise(F.replace("text", lf, crlf))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    due = F.when(F.col("doc_id") % 3 == 0, sha(F.col("text"))).when(F.col("doc_id") % 3 == 1, sha(other)).otherwise("none")
    return d.select("doc_id", corpus.hash_decision(F.col("text"), due).alias("decision"))


@query("""SELECT page_id AS source_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS target FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit links of each page."""
    return corpus.links(table(spark, sf_dir, "pages").select(F.col("page_id").alias("node_id"), F.col("html").alias("text")), 'href="([^"]+)"')


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source), b AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT source, count(*) FROM documents GROUP BY source)
SELECT source, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (source)""")
def coverage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source, the labelled ones against all of them and the languages."""
    d = table(spark, sf_dir, "documents")
    a = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))
    b = d.groupBy(F.col("lang").alias("source")).agg(F.count("*").alias("n")).unionByName(d.groupBy("source").agg(F.count("*").alias("n")))
    return corpus.coverage_diff(a, b, ["source"], "n")


@query("SELECT source, lang, count(*) AS n_rows, count(DISTINCT nullif(text, '')) AS n_distinct FROM documents GROUP BY ALL")
def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct texts of each source and language."""
    return corpus.coverage(table(spark, sf_dir, "documents"), ["source", "lang"], "text")


@query("""WITH x AS (SELECT event_id % 3 AS side, 'user' AS kind, CAST(user_id AS VARCHAR) AS identifier FROM events UNION ALL SELECT event_id % 3, 'event', CAST(event_id AS VARCHAR) FROM events)
SELECT CAST(b.side AS VARCHAR) AS against, b.kind, count(DISTINCT CASE WHEN a.identifier IS NOT NULL THEN b.identifier END) AS overlap FROM (SELECT DISTINCT * FROM x WHERE side > 0) b LEFT JOIN (SELECT DISTINCT * FROM x WHERE side = 0) a ON a.kind = b.kind AND a.identifier = b.identifier GROUP BY ALL""")
def contamination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that a set shares with two others."""
    e = table(spark, sf_dir, "events").withColumn("against", (F.col("event_id") % 3).cast("string"))
    x = e.select("against", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("identifier")) for k, c in (("user", "user_id"), ("event", "event_id"))))).alias("i")).select("against", "i.*")
    return corpus.contamination(x.where("against = '0'").drop("against"), x.where("against <> '0'"))


@query("""WITH p AS (SELECT CAST(l_partkey AS VARCHAR) AS s, CAST(l_suppkey AS VARCHAR) AS t FROM lineitem), e AS (SELECT s, t FROM p UNION ALL SELECT t, s FROM p), n AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier)
SELECT 'duplicate_edge' AS reason, s || '>' || t || '>x' AS id, 1 AS n FROM e GROUP BY s, t HAVING count(*) > 1
UNION ALL SELECT 'dangling_source_id', s || '>' || t || '>x', count(*) FROM e WHERE s NOT IN (SELECT id FROM n) GROUP BY s, t
UNION ALL SELECT 'dangling_target_id', s || '>' || t || '>x', count(*) FROM e WHERE t NOT IN (SELECT id FROM n) GROUP BY s, t""")
def load_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated edges and edges whose ends are unknown: keys of parts and suppliers both ways, where suppliers alone are nodes."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").cast("string").alias("target_id"), F.lit("x").alias("edge_type"))
    e = e.unionByName(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type"))
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("node_id"))
    return corpus.rejected_rows(n, e).groupBy("reason", "id").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value IS NOT NULL AND event_id = m) AS value FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key in an empty table."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return store.upserted(e.drop("seq").limit(0), e, ["user_id"])


@query("SELECT conv_id AS judgment_id, CAST(count(*) AS INTEGER) AS revision, 'active' AS lifecycle, sha256(arg_max(text, turn)) AS statement_sha256 FROM conversations GROUP BY conv_id")
def judgment_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as revisions; the current one of each."""
    c = table(spark, sf_dir, "conversations")
    n = F.row_number().over(judgments.Window.partitionBy("conv_id").orderBy("turn"))
    e = c.withColumn("n", n).select(F.col("conv_id").alias("judgment_id"), F.col("turn").cast("long").alias("seq"), F.when(F.col("n") == 1, "add").otherwise("update").alias("action"), (F.col("n") - 1).cast("int").alias("expected_revision"), F.col("text").alias("statement"), F.lit("").alias("rationale"))
    return judgments.current(judgments.replayed(e)).select("judgment_id", "revision", "lifecycle", F.sha2(F.col("statement").cast("binary"), 256).alias("statement_sha256"))


HISTORIES = """WITH RECURSIVE t AS (SELECT conv_id AS c, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
e AS (SELECT c, turn, n, CASE WHEN n = 1 THEN 'add' ELSE ['update', 'archive', 'update', 'restore', 'delete', 'add', 'supersede', 'delete'][1 + (c * 5 + n * 3) % 8] END AS a, CASE WHEN (c + n) % 6 <> 0 THEN 1 + (c * 3 + n) // 2 % 2 END AS x FROM t),
s AS (SELECT DISTINCT c, 0::BIGINT AS n, '' AS a, NULL::VARCHAR AS code, 0::BIGINT AS rev, 'absent' AS life FROM t UNION ALL
  SELECT c, n, a, code, CASE WHEN code IS NOT NULL THEN rev WHEN a = 'add' THEN 1 WHEN a = 'update' THEN rev + 1 ELSE rev END,
    CASE WHEN code IS NOT NULL THEN life WHEN a IN ('add', 'restore') THEN 'active' WHEN a = 'archive' THEN 'archived' WHEN a = 'supersede' THEN 'superseded' WHEN a = 'delete' THEN 'absent' ELSE life END
  FROM (SELECT e.c, e.n, e.a, s.rev, s.life, CASE WHEN e.a = 'add' THEN CASE WHEN life <> 'absent' THEN 'already_exists' END WHEN life = 'absent' THEN 'unknown_judgment' WHEN life = 'superseded' THEN 'superseded'
    WHEN e.a IN ('update', 'supersede') AND life <> 'active' THEN 'not_active' WHEN x IS DISTINCT FROM rev THEN 'revision_conflict' WHEN e.a = 'archive' AND life <> 'active' OR e.a = 'restore' AND life <> 'archived' THEN 'no_change'
    WHEN e.a = 'delete' AND life <> 'archived' THEN 'not_archived' END AS code FROM s JOIN e ON e.c = s.c AND e.n = s.n + 1)),
d AS (SELECT s.*, e.turn FROM s JOIN e USING (c, n))
"""


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of all kinds, many of which are refused: wrong or missing revisions, and what a lifecycle forbids."""
    c, n = F.col("conv_id"), F.col("n")
    e = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(judgments.Window.partitionBy("conv_id").orderBy("turn")))
    kinds = F.array(*map(F.lit, ("update", "archive", "update", "restore", "delete", "add", "supersede", "delete")))
    action = F.when(n == 1, "add").otherwise(F.get(kinds, ((c * 5 + n * 3) % 8).cast("int")))
    expected = F.when((c + n) % 6 != 0, 1 + F.floor((c * 3 + n) / 2) % 2).cast("int")
    link = F.array(F.struct((c + n).cast("string").alias("target_id"), F.lit("supports").alias("relation_type")))
    e = e.select(c.alias("judgment_id"), F.col("turn").cast("long").alias("seq"), action.alias("action"), expected.alias("expected_revision"), F.col("text").alias("statement"), F.lit("").alias("rationale"), link.alias("relations"))
    return judgments.replayed(e)


@query(HISTORIES + "SELECT c AS judgment_id, CAST(turn AS BIGINT) AS seq, a AS action, code AS reject_code, CAST(rev AS INTEGER) AS revision, life AS lifecycle FROM d")
def judgment_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each event of a history, by the accepted ones before it."""
    return _histories(spark, sf_dir).select("judgment_id", "seq", "action", "reject_code", "revision", "lifecycle")


@query(HISTORIES + ", w AS (SELECT c, max(n) AS n FROM d WHERE code IS NULL AND a IN ('add', 'update') GROUP BY c), z AS (SELECT c, arg_max(life, n) AS life FROM d GROUP BY c) SELECT c AS source_id, CAST(c + n AS VARCHAR) AS target_id, 'supports' AS relation_type FROM w JOIN z USING (c) WHERE life <> 'absent'")
def judgment_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that the last accepted text of each judgment has, if the judgment is still there."""
    return judgments.relations(_histories(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT conv_id AS c FROM conversations), j AS (SELECT c, CASE WHEN c % 7 = 3 THEN 'C' ELSE 'c' END || c AS id, 'c' || (c + 1) AS nxt FROM n),
r AS (SELECT id, nxt AS t, 'next' AS k, CASE WHEN c % 19 = 1 THEN 2 ELSE 1 END AS n FROM j UNION ALL SELECT id, id, 'Same', 1 FROM j WHERE c % 17 = 2)
SELECT 'invalid_identity' AS reason, id FROM j WHERE c % 7 = 3 UNION ALL SELECT 'invalid_revision', id FROM j WHERE c % 5 = 0 UNION ALL SELECT 'invalid_lifecycle', id FROM j WHERE c % 11 = 4
UNION ALL SELECT 'empty_rationale', id FROM j WHERE c % 29 = 5 UNION ALL SELECT 'empty_provenance', id FROM j WHERE c % 23 = 6 UNION ALL SELECT 'unknown_successor', id FROM j WHERE c % 13 = 7 AND nxt NOT IN (SELECT id FROM j)
UNION ALL SELECT 'self_relation', id || '>' || t || '>' || k FROM r WHERE id = t UNION ALL SELECT 'duplicate_relation', id || '>' || t || '>' || k FROM r WHERE n > 1
UNION ALL SELECT 'invalid_relation_type', id || '>' || t || '>' || k FROM r WHERE k = 'Same' UNION ALL SELECT 'dangling_relation', id || '>' || t || '>' || k FROM r WHERE t NOT IN (SELECT id FROM j)""")
def judgment_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of an import, each related to the next; some have faults, which are all named."""
    c = F.col("conv_id")
    s = lambda x: x.cast("string")
    own, nxt = F.concat(F.when(c % 7 == 3, "C").otherwise("c"), s(c)), F.concat(F.lit("c"), s(c + 1))
    line = lambda t, k: F.struct(t.alias("target_id"), F.lit(k).alias("relation_type"))
    links = F.concat(F.array(line(nxt, "next")), F.when(c % 19 == 1, F.array(line(nxt, "next"))).otherwise(F.array()), F.when(c % 17 == 2, F.array(line(own, "Same"))).otherwise(F.array()))
    d = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    r = d.select(own.alias("judgment_id"), (c % 5).cast("int").alias("revision"), F.lit("said").alias("statement"), F.when(c % 29 == 5, " ").otherwise("so").alias("rationale"), F.when(c % 23 != 6, F.create_map(F.lit("from"), s(c))).alias("provenance"), F.when(c % 11 == 4, "gone").otherwise("active").alias("lifecycle"), F.when(c % 13 == 7, nxt).alias("superseded_by"), links.alias("relations"))
    return judgments.import_errors(r)


@query("SELECT conv_id || ':' || turn AS packet_id, conv_id || ':' || max(turn) OVER (PARTITION BY conv_id) AS tip FROM conversations")
def packet_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet that stands at the end of each chain of replacements."""
    w = judgments.Window.partitionBy("conv_id").orderBy("turn")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("turn").over(w))
    return judgments.chain_tips(c.select(name(F.col("turn")).alias("packet_id"), F.when(F.col("before").isNotNull(), name(F.col("before"))).alias("supersedes")))


@query("SELECT user_id AS arm, event_id AS slot, coalesce(event_id - lag(event_id) OVER w <> 1, false) AS gap, coalesce(lag(ts) OVER w >= ts, false) AS backwards FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lifecycle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped slots and times that don't rise."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("arm"), F.col("event_id").alias("slot"), F.col("ts").alias("at"))
    return judgments.sequence_gaps(e).select("arm", "slot", "gap", "backwards")


@query("""WITH r AS (SELECT source AS case_id, doc_id AS node_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS b FROM documents),
a AS (SELECT case_id, node_id, a FROM r WHERE a <= 20), b AS (SELECT case_id, node_id, b FROM r WHERE b <= 30),
z AS (SELECT case_id, max(n) + 1 AS z FROM (SELECT case_id, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT case_id, count(*) FROM b GROUP BY 1) GROUP BY 1)
SELECT case_id, node_id, coalesce(a, z) - coalesce(b, z) AS delta, CASE WHEN a IS NULL THEN 'entered' WHEN b IS NULL THEN 'left' ELSE 'retained' END AS top_k_status FROM a FULL JOIN b USING (case_id, node_id) JOIN z USING (case_id)""")
def top_k_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ranks moved between two lists, with those who entered and left."""
    d = table(spark, sf_dir, "documents")
    w = metrics.Window.partitionBy("source")
    pick = lambda order, n: d.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= n).select(F.col("source").alias("case_id"), F.col("doc_id").alias("node_id"), F.col("rank").cast("long").alias("rank"))
    out = metrics.rank_deltas(pick((F.desc("n_chars"), "doc_id"), 20), pick(("n_chars", "doc_id"), 30))
    return out.select("case_id", "node_id", "delta", "top_k_status")


@query("""WITH r AS (SELECT user_id AS case_id, event_id AS t, event_id % 5 AS rank, value FROM events WHERE value IS NOT NULL), b AS (SELECT *, first_value(rank) OVER w AS r0, first_value(t) OVER w AS a0 FROM r WINDOW w AS (PARTITION BY case_id ORDER BY t)),
g AS (SELECT case_id, min(CASE WHEN t > a0 AND rank < r0 THEN t END) AS flip, min(CASE WHEN t > a0 AND rank > r0 THEN t END) AS reg, coalesce(bool_or(CASE WHEN t > a0 THEN value > 50 END), false) AS changed FROM b GROUP BY case_id)
SELECT case_id, CASE WHEN reg IS NOT NULL THEN 'rank_regression' WHEN flip IS NOT NULL THEN 'rank_flip_threshold' WHEN changed THEN 'edge_changed_but_rank_unchanged' ELSE 'rank_stable_through_schedule' END AS classification, coalesce(flip, -1) AS rank_flip_threshold, coalesce(reg, -1) AS rank_regression_first_checkpoint FROM g""")
def rank_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a schedule of feedback did to each case."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("feedback_count"), (F.col("event_id") % 5).alias("rank"), F.lit(1.0).alias("normalised"), F.lit(1.0).alias("final"), (F.col("value") > 50).cast("int").alias("changed_edges"))
    return metrics.elasticity(e).select("case_id", "classification", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("rank_flip_threshold", "rank_regression_first_checkpoint")))


@query("""WITH p AS (SELECT event_type AS role, event_id % 4 AS checkpoint, round(avg(value), 6) AS mrr FROM events GROUP BY ALL), s AS (SELECT *, mrr - lag(mrr) OVER (PARTITION BY role ORDER BY checkpoint) AS d FROM p)
SELECT role, coalesce(min(d) >= 0, true) AS non_decreasing, round(arg_max(mrr, checkpoint) - arg_min(mrr, checkpoint), 6) AS gain FROM s GROUP BY role""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a measure rises over checkpoints."""
    p = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role"), (F.col("event_id") % 4).alias("checkpoint")).agg(F.round(F.avg("value"), 6).alias("mrr"))
    return metrics.trajectory(p.withColumn("arm", F.lit("a"))).select("role", "non_decreasing", F.round("gain", 6).alias("gain"))


@query("""WITH v AS (SELECT s_suppkey AS variant_id, s_suppkey % 7 / 7.0 AS a, s_suppkey % 11 / 11.0 AS b FROM supplier WHERE s_acctbal > 0)
SELECT variant_id FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.a >= v.a AND o.b >= v.b AND (o.a > v.a OR o.b > v.b)) ORDER BY least(a, b) DESC, variant_id LIMIT 1""")
def pareto_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant to keep."""
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("variant_id"), (F.col("s_acctbal") > 0).alias("passed"), (k % 7 / 7.0).alias("relation_mrr"), (k % 11 / 11.0).alias("negative_mrr"), F.lit(0).alias("expansions"), F.lit(0).alias("complexity"))
    return metrics.selected(v.withColumn("worst_mrr", F.least("relation_mrr", "negative_mrr"))).select("variant_id")


@query("""WITH r AS (SELECT CASE WHEN quality = 1 THEN 'lexical' ELSE 'relation' END AS i, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS l, CASE WHEN doc_id % 5 > 1 THEN doc_id % 5 END AS r FROM labels)
SELECT round(avg(coalesce(1.0 / CASE WHEN i = 'lexical' THEN l ELSE r END, 0)), 6) AS intended_mrr, round(avg(CASE WHEN i = 'relation' THEN coalesce(1.0 / l, 0) END), 6) AS relation_cases_lexical_mrr, round(avg(CASE WHEN i = 'relation' THEN coalesce(1.0 / r, 0) END), 6) AS relation_cases_relation_mrr, round(avg(CASE WHEN l IS NOT NULL OR r IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS union_coverage FROM r""")
def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels against what each case intends."""
    d = F.col("doc_id")
    r = table(spark, sf_dir, "labels").select(d.alias("query_id"), F.when(F.col("quality") == 1, "lexical").otherwise("relation").alias("intended"), F.when(d % 3 > 0, d % 3).alias("lexical"), F.when(d % 5 > 1, d % 5).alias("relation"))
    return metrics.channel_metrics(r).select(*(F.round(c, 6).alias(c) for c in ("intended_mrr", "relation_cases_lexical_mrr", "relation_cases_relation_mrr", "union_coverage")))


@query("""SELECT CAST(n_nationkey AS INTEGER) AS position, n_name AS name, CASE WHEN n_nationkey >= 3 THEN 'unknown' WHEN n_nationkey = 1 THEN 'out_of_order' WHEN n_nationkey % 2 = 0 THEN 'failed' END AS reason FROM nation WHERE n_nationkey <> 0""")
def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates against the list that is expected."""
    n = table(spark, sf_dir, "nation")
    first = [r.n_name for r in n.where("n_nationkey in (0, 2)").orderBy("n_nationkey").collect()]
    g = n.select(F.col("n_nationkey").cast("int").alias("position"), F.col("n_name").alias("name"), ((F.col("n_nationkey") % 2 == 1) | (F.col("n_nationkey") == 0)).alias("passed"))
    return metrics.failed_gates(g, [first[0], "x", first[1]])


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS node_id, value / 100 AS e, CAST(event_id % 10 AS DOUBLE) / 10 AS g FROM events WHERE value IS NOT NULL),
f AS (SELECT *, e * 0.55 + g * 0.45 + CASE WHEN node_id % 197 = 5 THEN 0.001 ELSE 0 END AS final FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, node_id) AS turn FROM f),
s AS (SELECT *, turn + CASE WHEN node_id % 211 = 7 THEN 1 ELSE 0 END AS rank FROM k)
SELECT query_id, bool_and(abs(final - (e * 0.55 + g * 0.45)) <= 1e-12 AND rank = turn) AS holds FROM s GROUP BY query_id""")
def formula_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fusions recomputed; some stored finals and some stored ranks are wrong."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("node_id"), (F.col("value") / 100).alias("entry"), (F.col("event_id") % 10 / 10).alias("graph"))
    e = e.withColumn("final", F.col("entry") * 0.55 + F.col("graph") * 0.45 + F.when(F.col("node_id") % 197 == 5, 0.001).otherwise(0.0))
    w = metrics.Window.partitionBy("query_id").orderBy(F.desc("final"), "node_id")
    e = e.withColumn("rank", F.row_number().over(w) + F.when(F.col("node_id") % 211 == 7, 1).otherwise(0))
    return metrics.formula_audit(e, 0.55, 0.45)


SNAPSHOTS = """WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 500 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM a WHERE o_orderkey % 1000 <> 3 UNION ALL SELECT * FROM a WHERE o_orderkey % 1000 = 11)
"""


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a version of them in which some lost their status, some are gone and some stand twice."""
    a, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    b = a.where(k % 1000 != 3).withColumn("o_orderstatus", F.when(k % 500 != 7, F.col("o_orderstatus")))
    return a, b.unionByName(a.where(k % 1000 == 11))


@query(SNAPSHOTS + """, x AS (SELECT *, 0 AS v FROM a UNION ALL SELECT *, 1 FROM b),
t AS (SELECT v, CAST(CAST('0x' || substr(sha256(strlen(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 15) AS BIGINT) % 256 AS INTEGER) AS in_bucket,
  sha256(array_to_string([coalesce(strlen(c) || ':' || c, '-') FOR c IN [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]], ',')) AS h FROM x),
d AS (SELECT v, in_bucket, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) || ':' || sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) || ':' || sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS digest FROM t GROUP BY v, in_bucket)
SELECT in_bucket, n, digest, v = 1 AS changed FROM d""")
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two versions of the orders, by bucket."""
    a, b = (snapshots.digests(x, ["o_orderkey"], 256).withColumn("changed", F.lit(c)) for x, c in zip(_orders(spark, sf_dir), (False, True), strict=True))
    return a.unionByName(b)


@query(SNAPSHOTS + "SELECT 'before' AS side, *, 1 AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'after', *, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders in which two versions differ, found in the buckets whose digests do."""
    return snapshots.located(*_orders(spark, sf_dir), ["o_orderkey"], 256)


PAYLOADS = """WITH t AS (SELECT conv_id, turn, ['Answer', 'note', 'raw_score'][turn % 3 + 1] AS word, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, '{"role":' || to_json(role) || ',"body":{"parts":[{"text":' || to_json(text) || ',"meta":{"' || word || '":["answer",' || turn || ']}}]}}' AS payload FROM t)
"""


@query(PAYLOADS + """SELECT conv_id, turn, (SELECT count(*) FROM json_tree(payload)) AS n_values, (SELECT count(*) FROM json_tree(payload) j WHERE type = 'VARCHAR') AS n_strings,
  (SELECT count(*) FROM json_tree(payload) j WHERE try_cast(key AS INTEGER) IS NULL AND (lower(key) = 'answer' OR contains(lower(key), 'score'))) AS n_forbidden, CASE word WHEN 'note' THEN NULL ELSE 5 END AS depth,
  CAST(len(regexp_extract_all(text, 'e[a-z]+ ')) AS BIGINT) AS n_redacted,
  sha256('{"body":{"parts":[{"meta":{"' || word || '":["answer",' || turn || ']},"text":' || to_json(regexp_replace(text, 'e[a-z]+ ', '[REDACTED_SECRET]', 'g')) || '}]},"role":' || to_json(role) || '}') AS payload_sha256 FROM p""")
def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as nested payloads: forbidden keys (and how deep), which as values are allowed, and
    strings redacted wherever they stand, with the payload written anew."""
    t = table(spark, sf_dir, "conversations")
    word = F.element_at(F.array(*map(F.lit, ("Answer", "note", "raw_score"))), (F.col("turn") % 3 + 1).cast("int"))
    say = lambda c: payloads.quoted(F.coalesce(F.col(c), F.lit("")))
    payload = F.concat(F.lit('{"role":'), say("role"), F.lit(',"body":{"parts":[{"text":'), say("text"), F.lit(',"meta":{"'), word, F.lit('":["answer",'), F.col("turn").cast("string"), F.lit("]}}]}}"))
    found = payloads.levels(t.select(F.struct("conv_id", "turn").alias("id"), payload.alias("payload")))
    counts = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.count("*").alias("n_values"), F.count_if(F.col("kind") == "string").alias("n_strings"))
    bad = payloads.forbidden_keys(found, ["answer"], ["score"]).groupBy("id").agg(F.count("*").alias("n_forbidden"), F.max("depth").alias("depth"))
    clean = payloads.changed_strings(found, lambda c: redacted(c, ("e[a-z]+ ",))).select("id", F.col("n").alias("n_redacted"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))
    return counts.join(bad, "id", "left").join(clean, "id").fillna(0, ["n_forbidden"]).select("id.conv_id", "id.turn", "n_values", "n_strings", "n_forbidden", "depth", "n_redacted", "payload_sha256")
