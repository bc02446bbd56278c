"""Queries of propagation, searches and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.encode import encoded, letters
from ..functions.text import tokens
from ..operators import channels, dynamics, feedback, graph, ledger
from .queries import EDGES, TOKENS, part_seeds, query, table, text_nodes, typed_edges

ASKED = "supplied located supplier nation 3"


#: Expansions, steps and inhibition of the queries over the mesh.
ROOM, STEPS, RATIO = 1_000, 3, 0.1


def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed_edges with ways back and a hub: nations lead to their suppliers, parts to a market, and the market to each
    part once for each status and month of its shipments. So walks come back to where they were, and the market has a third of all
    edges or more."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    row = lambda df, a, b, kind, w: df.select(a.alias("source_id"), b.alias("target_id"), kind.alias("edge_type"), w.alias("weight"), F.lit(0.9).alias("factuality"))
    market = F.lit("market:0")
    how = F.concat_ws(" ", F.lit("ships"), "l_linestatus", F.month("l_shipdate").cast("string")).alias("how")
    shipped = l.groupBy("l_partkey", how).agg((1 - F.min(F.col("l_discount").cast("double")) * 5).alias("w"))
    ways = row(shipped, market, name("part", "l_partkey"), F.col("how"), F.col("w"))
    listed = row(table(spark, sf_dir, "part"), name("part", "p_partkey"), market, F.lit("listed_on"), F.lit(0.7))
    home = row(table(spark, sf_dir, "supplier"), name("nation", "s_nationkey"), name("supplier", "s_suppkey"), F.lit("home_of"), F.lit(0.6))
    return typed_edges(spark, sf_dir).unionByName(ways).unionByName(listed).unionByName(home)


def spreading(spark: SparkSession, sf_dir: str, strategy: str) -> dynamics.Propagation:
    c = EngineConfig(activation_strategy=strategy, inhibition_ratio=RATIO, recurrent_steps=STEPS, max_propagation_expansions=ROOM)
    q = part_seeds(spark, sf_dir).select("query_id").distinct().withColumn("query_tokens", F.split(F.lit(ASKED), " "))
    named = part_nodes(spark, sf_dir).select(F.col("node_id").alias("target_id"), tokens(F.col("text")).alias("target_tokens"))
    return dynamics.propagate(part_seeds(spark, sf_dir), mesh_edges(spark, sf_dir), c, q, named)


def spread(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """Three steps of a strategy from the parts over the mesh; gates see the edges' types and the names of nodes."""
    return spreading(spark, sf_dir, strategy).activation.select("query_id", "node_id", F.round("activation", 6).alias("activation"))


MESH = EDGES.split("seeds AS")[0].replace("edges AS (", "known AS (") + """ways AS (
  SELECT * FROM known UNION ALL
  SELECT 'market:0', 'part:' || l_partkey, 'ships ' || l_linestatus || ' ' || month(l_shipdate), 1 - min(CAST(l_discount AS DOUBLE)) * 5, 0.9 FROM lineitem GROUP BY l_partkey, l_linestatus, month(l_shipdate) UNION ALL
  SELECT 'part:' || p_partkey, 'market:0', 'listed_on', 0.7, 0.9 FROM part UNION ALL
  SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'home_of', 0.6, 0.9 FROM supplier),
"""
NAMES = f"""names AS (SELECT 'part:' || p_partkey AS target_id, p_name AS text FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation),
met AS (SELECT ways.*, list_distinct(list_concat(coalesce({TOKENS.format("text")}, []), {TOKENS.format("edge_type")})) AS t FROM ways LEFT JOIN names USING (target_id)),
"""
PART_SEEDS = "seeds AS (" + EDGES.split("seeds AS (")[1]


def steps_sql(gated: bool = False, by_path: bool = False, anchored: bool = False, overall: bool = False, ways: str = MESH, seeds: str = PART_SEEDS, ratio: float = RATIO, room: int = ROOM, end: str | None = None) -> str:
    """Three steps in SQL, walk by walk: paths exclude their nodes, expansions end at room in the order of the walk, states
    of a query that has none left stay as they are."""
    gate = f"0.4 + 0.6 * len(list_intersect(t, string_split('{ASKED}', ' '))) / sqrt({len(ASKED.split())} * len(t))" if gated else "1.0"
    sql = ways + (NAMES if gated else "") + seeds + f"""links AS (SELECT source_id, target_id, edge_type, weight, factuality, {gate} AS gate FROM {"met" if gated else "ways"}),
s0 AS (SELECT query_id, node_id, CAST(entry AS DOUBLE) AS a, node_id AS path, node_id AS seed, 1 AS copy, '' AS hist FROM seeds),
z0 AS (SELECT query_id, CAST(0 AS BIGINT) AS spent, 0 AS steps, false AS done FROM seeds GROUP BY query_id),
"""
    order = "-a, node_id, path, copy, t, edge_type" if by_path else "node_id, t, edge_type"
    for i in range(1, STEPS + 1):
        s, z, key = f"s{i - 1}", f"z{i - 1}", "query_id, node_id, copy"
        sql += f"""p{i} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS turn FROM (
    SELECT query_id, s.node_id, s.a, s.path, s.seed, s.copy, s.hist, e.target_id AS t, edge_type, z.spent, s.a * weight * factuality * 0.7 * gate AS c
    FROM {s} s JOIN {z} z USING (query_id) JOIN links e ON e.source_id = s.node_id WHERE NOT z.done AND NOT list_contains(string_split(s.path, '>'), e.target_id)) WHERE c > 0)
  WHERE turn <= {room} - spent),
"""
        if overall:
            sql += f"m{i} AS (SELECT *, round(c * CASE WHEN sum(c) OVER (PARTITION BY query_id) > 1.0 THEN 1.0 / sum(c) OVER (PARTITION BY query_id) ELSE 1 END, 12) AS v FROM p{i}),\n"
        else:
            sql += f"i{i} AS (SELECT *, c - CASE WHEN count(*) OVER (PARTITION BY {key}) > 1 THEN {ratio} * max(c) OVER (PARTITION BY {key}) ELSE 0 END AS d FROM p{i}),\n"
            sql += f"m{i} AS (SELECT *, round(d * least(1.0, 1.0 * a / sum(d) OVER (PARTITION BY {key})), 12) AS v FROM i{i} WHERE d > 0),\n"
        rows = f"""SELECT query_id, node_id, round(a * 0.5, 12) AS v, path, seed, false AS fresh, '' AS n, '' AS kind, hist FROM {s} JOIN {z} USING (query_id) WHERE NOT done
    UNION ALL SELECT query_id, t, v, path || '>' || t, seed, true, node_id, edge_type, hist || edge_type || chr(34) FROM m{i}"""
        if by_path:
            now = f"SELECT query_id, node_id, v AS a, path, seed, row_number() OVER (PARTITION BY query_id, node_id ORDER BY v DESC, path, hist) AS copy, hist FROM ({rows}) WHERE v > 0 QUALIFY copy <= 4"
        else:
            best = "seed" if overall else "path"
            now = f"""SELECT query_id, node_id, round(sum(v) OVER (PARTITION BY query_id, node_id), 12) AS a, path, seed, 1 AS copy, '' AS hist FROM ({rows})
    QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY fresh DESC, v DESC, {best} DESC, n, kind) = 1"""
            less = f"- {ratio} * max(a) OVER (PARTITION BY query_id)" if overall else ""
            now = f"SELECT * FROM (SELECT query_id, node_id, a {less} AS a, path, seed, copy, hist FROM ({now})) WHERE a > 0"
        sql += f"s{i} AS ({now} UNION ALL SELECT s.* FROM {s} s JOIN {z} USING (query_id) WHERE done),\n"
        sql += f"z{i} AS (SELECT query_id, spent + coalesce(n, 0) AS spent, CASE WHEN done THEN steps ELSE {i} END AS steps, done OR spent + coalesce(n, 0) >= {room} AS done FROM {z} LEFT JOIN (SELECT query_id, count(*) AS n FROM p{i} GROUP BY query_id) USING (query_id)),\n"
    sql += f"f AS (SELECT query_id, node_id, sum(a) AS a FROM s{STEPS} GROUP BY ALL)"
    if anchored:
        sql += f",\nleft_ AS (SELECT query_id, node_id, round(a - coalesce(entry * pow(0.5, steps), 0), 12) AS a, entry IS NULL AS fresh FROM f JOIN z{STEPS} USING (query_id) LEFT JOIN seeds USING (query_id, node_id)),\ng AS (SELECT query_id, node_id, a FROM left_ WHERE fresh OR a > 0)"
    return sql + (end or f"\nSELECT query_id, node_id, round(a, 6) AS activation FROM {'g' if anchored else 'f'}")


@query(steps_sql(gated=True, overall=True))
def recurrent_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return spread(spark, sf_dir, "recurrent_competition")


@query(steps_sql())
def local_neighbor_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return spread(spark, sf_dir, "local_neighbor_competition")


@query(steps_sql(gated=True))
def local_neighbor_query_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return spread(spark, sf_dir, "local_neighbor_query_competition")


@query(steps_sql(by_path=True))
def local_neighbor_path_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return spread(spark, sf_dir, "local_neighbor_path_competition")


@query(steps_sql(gated=True, by_path=True))
def local_neighbor_query_path_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return spread(spark, sf_dir, "local_neighbor_query_path_competition")


@query(steps_sql(anchored=True))
def anchored_local_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return spread(spark, sf_dir, "anchored_local_competition")


@query(steps_sql(gated=True, anchored=True))
def anchored_local_query_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    return spread(spark, sf_dir, "anchored_local_query_competition")


GATED = EDGES + f"""names AS (SELECT 'supplier:' || s_suppkey AS target_id, s_name AS text FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation),
met AS (SELECT edges.*, list_distinct(list_concat(coalesce({TOKENS.format("text")}, []), {TOKENS.format("edge_type")})) AS t FROM edges LEFT JOIN names USING (target_id)),
gated AS (SELECT source_id, target_id, edge_type, weight, factuality, 0.4 + 0.6 * len(list_intersect(t, string_split('{ASKED}', ' '))) / sqrt({len(ASKED.split())} * len(t)) AS gate FROM met),
"""


@query(GATED + """h1 AS (SELECT query_id, e.target_id AS node_id, s.entry * weight * factuality * 0.7 * gate AS c FROM seeds s JOIN gated e ON e.source_id = s.node_id),
h2 AS (SELECT query_id, e.target_id AS node_id, h.c * weight * factuality * 0.7 * gate AS c FROM h1 h JOIN gated e ON e.source_id = h.node_id WHERE h.c > 0)
SELECT query_id, node_id, round(sum(c), 6) AS activation FROM (SELECT query_id, node_id, entry AS c FROM seeds UNION ALL SELECT * FROM h1 WHERE c > 0 UNION ALL SELECT * FROM h2 WHERE c > 0) GROUP BY query_id, node_id""")
def query_conditioned_transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, P6."""
    c = EngineConfig(activation_strategy="query_conditioned_transmission")
    q = part_seeds(spark, sf_dir).select("query_id").distinct().withColumn("query_tokens", F.split(F.lit(ASKED), " "))
    named = part_nodes(spark, sf_dir).select(F.col("node_id").alias("target_id"), tokens(F.col("text")).alias("target_tokens"))
    found = dynamics.propagate(part_seeds(spark, sf_dir), typed_edges(spark, sf_dir), c, q, named).activation
    return found.select("query_id", "node_id", F.round("activation", 6).alias("activation"))


@query(EDGES + """h1 AS (SELECT query_id, e.target_id AS t FROM seeds s JOIN edges e ON e.source_id = s.node_id WHERE weight * factuality > 0),
n AS (SELECT query_id, 1 AS hop FROM h1 UNION ALL SELECT query_id, 2 FROM h1 JOIN edges e ON e.source_id = t)
SELECT query_id, max(hop) AS steps, count(*) AS expansions, CASE WHEN max(hop) = 2 THEN 'max_hops' ELSE 'frontier_exhausted' END AS stop_reason FROM n GROUP BY query_id""")
def propagation_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    return dynamics.propagate(part_seeds(spark, sf_dir), typed_edges(spark, sf_dir), EngineConfig()).diagnostics.select("query_id", "steps", "expansions", "stop_reason")


@query(steps_sql(end=f" SELECT query_id, CAST(steps AS INTEGER) AS steps, spent AS expansions, CASE WHEN spent >= {ROOM} THEN 'max_expansions' ELSE 'recurrent_step_limit' END AS stop_reason FROM z{STEPS}"))
def recurrent_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, expansions and why each query ended, of local competition over the mesh."""
    return spreading(spark, sf_dir, "local_neighbor_competition").diagnostics.select("query_id", "steps", "expansions", "stop_reason")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, k, n, kind: table(spark, sf_dir, t).select(F.concat(F.lit(kind + ":"), F.col(k).cast("string")).alias("node_id"), F.col(n).alias("text"))
    return name("part", "p_partkey", "p_name", "part").unionByName(name("supplier", "s_suppkey", "s_name", "supplier")).unionByName(name("nation", "n_nationkey", "n_name", "nation"))


SEARCH = EDGES.split("seeds AS")[0] + f"""
nodes AS (SELECT 'part:' || p_partkey AS node_id, p_name AS text FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation),
dl AS (SELECT node_id, {TOKENS.format("text")} AS t FROM nodes), stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dl),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT p_name AS query_id, unnest({TOKENS.format("p_name")}) AS term FROM (SELECT DISTINCT p_name FROM part)) GROUP BY ALL),
post AS (SELECT node_id, term, dl, count(*) AS tf FROM (SELECT node_id, len(t) AS dl, unnest(t) AS term FROM dl) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, node_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS s FROM post JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
entry AS (SELECT query_id, node_id, s / max(s) OVER (PARTITION BY query_id) AS entry FROM bm),
seeds AS (SELECT query_id, node_id, entry FROM entry QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(entry, 9) DESC, node_id) <= 3),
"""


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a part, as a query."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()


SPREAD = """h1 AS (SELECT query_id, e.target_id AS node_id, s.entry * weight * factuality * 0.7 AS c FROM seeds s JOIN edges e ON e.source_id = s.node_id),
h2 AS (SELECT query_id, e.target_id AS node_id, h.c * weight * factuality * 0.7 AS c FROM h1 h JOIN edges e ON e.source_id = h.node_id WHERE h.c > 0),
act AS (SELECT query_id, node_id, round(sum(c), 12) AS activation FROM (SELECT query_id, node_id, entry AS c FROM seeds UNION ALL SELECT * FROM h1 WHERE c > 0 UNION ALL SELECT * FROM h2 WHERE c > 0) GROUP BY ALL),
every AS (SELECT query_id, node_id, coalesce(entry, 0) AS entry, coalesce(activation, 0) AS activation, coalesce(activation / max(activation) OVER (PARTITION BY query_id), 0) AS graph
  FROM (SELECT DISTINCT p_name AS query_id FROM part) CROSS JOIN nodes LEFT JOIN entry USING (query_id, node_id) LEFT JOIN act USING (query_id, node_id)),
"""
LINEAR = """final AS (SELECT *, entry * 0.55 + graph * 0.45 AS final FROM every)
"""
RECIPROCAL = """ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(entry, 12) DESC, node_id) AS re,
  CASE WHEN activation > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, node_id) END AS rg FROM every),
final AS (SELECT *, 0.55 / (60 + re) + 0.45 * coalesce(1.0 / (60 + rg) - 1.0 / (60 + count(rg) OVER (PARTITION BY query_id) + 1), 0) AS final FROM ranks)
"""
PLACED = "SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final, 12) DESC, node_id) AS INTEGER) AS rank, {} round(final, 6) AS final FROM final QUALIFY rank <= {}"


def sparse_only(**more: object) -> EngineConfig:
    return EngineConfig(use_dense_retrieval=False, dense_weight=0, **more)


@query(SEARCH + SPREAD + LINEAR + PLACED.format("", 10))
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names, without dense retrieval: BM25, seeds, two hops, linear fusion, the ten best of all nodes."""
    found = channels.search(part_nodes(spark, sf_dir), typed_edges(spark, sf_dir), name_queries(spark, sf_dir), sparse_only(), 10)
    return found.select("query_id", "node_id", "rank", F.round("final", 6).alias("final"))


@query(SEARCH + SPREAD + RECIPROCAL + PLACED.format("re, rg,", 500))
def reciprocal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K4, K6: as combined_search, by reciprocal ranks among all nodes: the 500 best, so that for most queries those
    that no term and no edge leads to stand there as well, with the ranks that their ids give them."""
    c = sparse_only(final_fusion_strategy="rrf")
    found = channels.search(part_nodes(spark, sf_dir), typed_edges(spark, sf_dir), name_queries(spark, sf_dir), c, 500)
    return found.select("query_id", "node_id", "rank", "re", "rg", F.round("final", 6).alias("final"))


LETTERS = "list_transform(range(97, 123), lambda i: CAST(len({0}) - len(replace({0}, chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"
BLENDED = SEARCH.split("entry AS (SELECT")[0] + f"""vectors AS (SELECT node_id, {LETTERS.format("array_to_string(t, '')")} AS v FROM dl),
asked AS (SELECT DISTINCT p_name AS query_id, {LETTERS.format(f"array_to_string({TOKENS.format('p_name')}, '')")} AS q FROM part),
lanes AS (SELECT query_id, node_id, coalesce(s, 0) AS s, round(greatest(0, coalesce(list_cosine_similarity(v, q), 0)), 12) AS d FROM asked CROSS JOIN vectors LEFT JOIN bm USING (query_id, node_id)),
entry AS (SELECT query_id, node_id, round(0.55 * s / max(s) OVER (PARTITION BY query_id) + 0.45 * d / max(d) OVER (PARTITION BY query_id), 12) AS entry FROM lanes),
seeds AS (SELECT query_id, node_id, entry FROM entry QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(entry, 9) DESC, node_id) <= 3),
"""


@query(BLENDED + SPREAD + LINEAR + PLACED.format("round(entry, 6) AS entry,", 10))
def blended_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes, with an encoder that SQL can follow: candidates from blocked products, linear fusion."""
    found = channels.search(part_nodes(spark, sf_dir), typed_edges(spark, sf_dir), name_queries(spark, sf_dir), EngineConfig(), 10, letters)
    return found.select("query_id", "node_id", "rank", F.round("entry", 6).alias("entry"), F.round("final", 6).alias("final"))


@query(BLENDED + SPREAD + RECIPROCAL + PLACED.format("re, rg,", 10))
def blended_reciprocal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K4, I8: as blended_search, by reciprocal ranks; those of reached nodes are counted over all nodes."""
    c = EngineConfig(final_fusion_strategy="rrf")
    found = channels.search(part_nodes(spark, sf_dir), typed_edges(spark, sf_dir), name_queries(spark, sf_dir), c, 10, letters)
    return found.select("query_id", "node_id", "rank", "re", "rg", F.round("final", 6).alias("final"))


@query(None)
def relation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation channel for parts' names, with the paths that explain it."""
    found = channels.relation_channel(part_nodes(spark, sf_dir), typed_edges(spark, sf_dir), name_queries(spark, sf_dir), EngineConfig(), 10)
    return found.select("query_id", "node_id", "rank", F.round("score", 6).alias("score"), F.to_json("paths").alias("paths"))


@query(None)
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors of all documents."""
    return text_nodes(spark, sf_dir).select("node_id", encoded(F.col("text")).alias("vector"))


@query("SELECT 'supplier:' || s_suppkey AS node_id, min('supplier:' || s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that hang together over their nations."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_id")
    e = s.select(name.alias("source_id"), F.concat(F.lit("z:"), F.col("s_nationkey").cast("string")).alias("target_id"))
    n = s.select(name).unionByName(e.select(F.col("target_id").alias("node_id")).distinct())
    return graph.components(e, n).where("node_id like 'supplier:%'")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.lit("t").alias("target_id"), F.col("event_type").alias("edge_type"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("trace_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("value") / 100)).alias("credit"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, 0.2 * least(1, greatest(0.1, value / 100)) AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
k AS (SELECT user_id, list(DISTINCT event_type) AS ks FROM e GROUP BY user_id),
r AS (SELECT user_id, ks, list_transform(ks, lambda x: CAST(0.5 AS DOUBLE)) AS w, CAST(0 AS BIGINT) AS i FROM k
  UNION ALL
  SELECT r.user_id, ks, list_transform(range(1, len(ks) + 1), lambda j: CASE WHEN ks[j] = event_type THEN greatest(w[j], least(2.0, w[j] + up))
    ELSE greatest(0.0, w[j] - (greatest(w[list_position(ks, event_type)], least(2.0, w[list_position(ks, event_type)] + up)) - w[list_position(ks, event_type)]) * 0.5 / greatest(1, len(ks) - 1)) END), e.i
  FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1)
SELECT user_id AS source_id, unnest(ks) AS edge_type, round(unnest(w), 9) AS weight FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, ks, w FROM r QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY i DESC) = 1)""")
def sibling_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes in order; what an edge gains is taken, by half, off its siblings."""
    e = event_edges(spark, sf_dir)
    edges = e.select(*feedback.EDGE).distinct().withColumns({"weight": F.lit(0.5), "reinforced_count": F.lit(0)})
    out = ledger.weights(ledger.fold(edges, e.withColumn("kind", F.lit("success")), EngineConfig(sibling_feedback_normalization=0.5)))
    return out.select("source_id", "edge_type", F.round("weight", 9).alias("weight"))


@query(None)
def soft_start_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses, confirmations, corrections and supersessions, as a journal."""
    t = F.col("event_id") % 4
    kind = F.when(t == 0, "used").when(t == 1, "confirmed").when(t == 2, "corrected").otherwise("superseded")
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id").withColumn("kind", kind)
    e = event_edges(spark, sf_dir).join(e, F.col("seq") == F.col("event_id")).drop("event_id")
    e = e.withColumn("trace_id", (F.col("seq") % 3).cast("string"))
    edges = e.select(*feedback.EDGE).distinct().withColumns({"weight": F.lit(0.5), "reinforced_count": F.lit(0)})
    c = EngineConfig(soft_start_feedback_reinforcement=True, soft_start_feedback_ratio=0.25, confirmation_decay_ratio=0.5, outcome_driven_feedback_deactivation=True, sibling_feedback_normalization=0.5)
    return ledger.fold(edges, e, c)


@query("""WITH e AS (SELECT event_type AS edge_type, user_id AS trace_id, min(event_id) AS seq, arg_min(value / 1000, event_id) AS inc FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT edge_type, count(*) AS n, round(greatest(0.5, least(2.0, 0.5 + arg_min(inc, seq) * (1 - pow(0.5, count(*))) / 0.5)), 6) AS new_weight FROM e GROUP BY edge_type""")
def confirmation_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric confirmations by distinct traces."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.lit("s").alias("source_id"), F.lit("t").alias("target_id"), F.col("event_type").alias("edge_type"), F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), (F.col("value") / 1000).alias("increment"), F.lit(0.5).alias("weight"))
    return feedback.confirmations(e, 0.5, 2.0).select("edge_type", "n", F.round("new_weight", 6).alias("new_weight"))


@query("""WITH e AS (SELECT user_id AS edge_type, value / 100 - 0.5 AS delta, event_type <> 'error' AS active FROM events WHERE value IS NOT NULL)
SELECT edge_type, round(greatest(0, least(2.0, 0.5 + sum(CASE WHEN active THEN delta ELSE 0 END))), 6) AS new_weight FROM e GROUP BY edge_type""")
def exact_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights rebuilt from the deltas that are still active."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.lit("s").alias("source_id"), F.lit("t").alias("target_id"), F.col("user_id").alias("edge_type"), F.lit(0.5).alias("baseline"), F.lit(2.0).alias("maximum"), (F.col("value") / 100 - 0.5).alias("delta"), (F.col("event_type") != "error").alias("active"))
    return feedback.reversed_weights(e).select("edge_type", F.round("new_weight", 6).alias("new_weight"))


@query("""SELECT event_id AS seq, CASE WHEN row_number() OVER w = 1 THEN 'run' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'idempotency_conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("idempotency_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload_hash"))
    return feedback.replays(e).select("seq", "outcome")
