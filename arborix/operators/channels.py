"""Searches: the combined one, and the lexical and relation channels side by side, for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.encode import encoded, hashed
from ..functions.text import share, tokens, weighted
from ..sources.lineage import cut
from . import dynamics, ranking, retrieval
from .dense import Encoder, Lanes


def blended(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows(query_id, sparse, dense) with entry: each lane as a share of the query's greatest, blended. The greatest, a row
    for each query, go to the rows: Spark takes rows that come out of Arrow for few, and would send those to all tasks."""
    top = rows.groupBy("query_id").agg(F.max("sparse").alias("ms"), F.max("dense").alias("md"))
    entry = weighted(share(F.col("sparse"), F.col("ms")), share(F.col("dense"), F.col("md")), config.sparse_weight, config.dense_weight)
    return rows.join(F.broadcast(top), "query_id").withColumn("entry", F.round(entry, ranking.DIGITS))


def entries(nodes: DataFrame, queries: DataFrame, config: EngineConfig, k: int, encoder: Encoder = hashed) -> tuple[DataFrame, Lanes | None]:
    """query_id, node_id, sparse, dense, entry of the nodes among which the k best of each query are: all that share a term
    with it, and with dense retrieval the k nearest of the others. The lanes, if there is a dense one."""
    if config.use_dense_retrieval:
        lanes = Lanes(nodes, queries, encoder)
        return cut(blended(lanes.candidates(k), config)), lanes
    sparse = retrieval.bm25(nodes, queries).select("query_id", "node_id", F.col("score").alias("sparse"), F.lit(0.0).alias("dense"))
    return blended(sparse, replace(config, sparse_weight=1.0)), None


def seeds(entry: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller node; those without a score then go."""
    return retrieval.seeds(entry.select("query_id", "node_id", "entry"), k).select("query_id", "node_id", "entry")


def _terms(nodes: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.select("query_id", tokens(F.col("text")).alias("query_tokens")), nodes.select(F.col("node_id").alias("target_id"), tokens(F.col("text")).alias("target_tokens"))


@dataclass(frozen=True)
class Scored:
    """What a combined search knows before it fuses: candidates by entry, and what spreads from the seeds."""

    entry: DataFrame
    found: dynamics.Propagation
    nodes: DataFrame
    queries: DataFrame
    lanes: Lanes | None
    limit: int


def scored(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: EngineConfig, limit: int, encoder: Encoder = hashed) -> Scored:
    """Entry scores of a combined search, and what spreads from its seeds."""
    entry, lanes = entries(nodes, queries, config, max(limit, config.seed_count), encoder)
    found = dynamics.propagate(seeds(entry, config.seed_count), edges, config, *_terms(nodes, queries))
    return Scored(entry, found, nodes, queries, lanes, limit)


def _with_dense(s: Scored, config: EngineConfig, encoder: Encoder) -> DataFrame:
    """Standings with dense retrieval: of the best by entry, and of all that the graph reaches, whose cosines are looked up."""
    live = s.found.activation.select("query_id", "node_id", F.round("activation", ranking.DIGITS).alias("activation")).where("activation > 0")
    live = cut(live.join(s.nodes.select("node_id"), "node_id", "left_semi"))
    key, first = ["query_id", "node_id"], ranking.top(s.entry, "entry", s.limit).select("query_id", "node_id", "entry")
    known = s.entry.join(live.select(*key), key, "left_semi").select("query_id", "node_id", "entry")
    rest = live.select(*key).join(s.entry.select(*key).hint("merge"), key, "left_anti")  # all candidates: not to be sent to all tasks
    text = lambda t, c: t.select(c, encoded(F.col("text"), encoder).alias("v" if c == "node_id" else "q"))
    top = s.entry.select("query_id", "ms", "md").distinct()
    met = rest.join(text(s.nodes.join(rest.select("node_id").distinct(), "node_id", "left_semi"), "node_id"), "node_id").join(text(s.queries, "query_id"), "query_id").join(top, "query_id")
    near = F.round(retrieval.cosine(F.col("v"), F.col("q")), ranking.DIGITS)
    met = met.select("query_id", "node_id", F.round(weighted(F.lit(0.0), share(near, F.col("md")), config.sparse_weight, config.dense_weight), ranking.DIGITS).alias("entry"))
    rows = cut(first.unionByName(known).unionByName(met).distinct().join(live, key, "left").fillna(0.0, ["activation"]))
    rows = ranking.graph_normalised(rows, config.graph_normalization)
    last = live.groupBy("query_id").agg(F.count("*").alias("last"))
    if config.final_fusion_strategy != "linear":
        ranks = s.lanes.among_all(rows.select("query_id", "node_id", "entry"), top, config.sparse_weight, config.dense_weight)
        rows = ranking.ranked(rows, "activation", "rg", True).join(ranks, key)
    return ranking.fusion(rows, config, last)


def best(s: Scored, config: EngineConfig, encoder: Encoder = hashed) -> DataFrame:
    """query_id, node_id, rank, entry, graph, activation, final, entry_part, graph_part, paths: the best of each query among
    all nodes by the fused score; nodes without any score stand last, by id. With reciprocal ranks, re and rg as well."""
    if s.lanes is not None:
        all_ = _with_dense(s, config, encoder)
    else:
        all_ = ranking.standings(s.entry, s.found.activation, s.queries.select("query_id"), ranking.node_index(s.nodes), config, s.limit)
    first = ranking.top(all_, "final", s.limit)
    why = dynamics.explained(s.found.paths, config.max_paths_per_node)
    ranks = ["re", "rg"] if config.final_fusion_strategy != "linear" else []
    return first.select("query_id", "node_id", "rank", "entry", "graph", "activation", "final", "entry_part", "graph_part", *ranks).join(why, ["query_id", "node_id"], "left")


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: EngineConfig, limit: int, encoder: Encoder = hashed) -> DataFrame:
    return best(scored(nodes, edges, queries, config, limit, encoder), config, encoder)


def lexical_channel(nodes: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """By raw BM25; nodes without any term of the query follow, with 0, up to the limit."""
    some = cut(ranking.top(retrieval.bm25(nodes, queries), "score", limit, ranking.TIES))  # a few rows of each query, read twice
    zero = queries.select("query_id").join(nodes.select("node_id").orderBy("node_id").limit(2 * limit))
    zero = zero.join(some.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").select("query_id", "node_id", F.lit(0.0).alias("score"))
    return ranking.top(some.select("query_id", "node_id", "score").unionByName(zero), "score", limit, ranking.TIES).withColumn("channel", F.lit("lexical"))


def relation_channel(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: EngineConfig, limit: int, encoder: Encoder = hashed) -> DataFrame:
    """By anchored local competition from blended seeds, whatever strategy is set; nodes that an edge leads to."""
    c = replace(config, activation_strategy="anchored_local_competition", use_graph_propagation=True)
    found = dynamics.propagate(seeds(entries(nodes, queries, c, c.seed_count, encoder)[0], c.seed_count), edges, c)
    why = dynamics.explained(found.paths, c.max_paths_per_node)
    live = found.activation.where("activation > 0").join(why, ["query_id", "node_id"])
    return ranking.top(live.withColumnRenamed("activation", "score"), "score", limit).withColumn("channel", F.lit("relation"))


def agreement(lexical: DataFrame, relation: DataFrame) -> DataFrame:
    """query_id, node_ids: what both channels show, in order; an empty list for a query on which they share nothing."""
    shown = lexical.select("query_id", "node_id", F.lit("l").alias("by")).unionByName(relation.select("query_id", "node_id", F.lit("r").alias("by")))
    both = shown.groupBy("query_id", "node_id").agg((F.min("by") != F.max("by")).alias("both"))
    return both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("both"), F.col("node_id")))).alias("node_ids"))


def credited_paths(hits: DataFrame, used: DataFrame) -> DataFrame:
    """trace_id, contribution, steps of used(query_id, node_id): the best stored path of each used node, ties to the largest
    seed; a node whose best path has no edge earns nothing."""
    p = hits.join(used, ["query_id", "node_id"], "left_semi").select("query_id", "node_id", F.explode("paths").alias("p"))
    best = p.groupBy("query_id", "node_id").agg(F.max_by("p", F.struct("p.contribution", "p.seed_id", -F.col("p.r"))).alias("p"))
    return best.where(F.size("p.steps") > 0).select(F.col("query_id").alias("trace_id"), "p.contribution", "p.steps")
