"""Spreading activation over typed edges, for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import set_gate, tokens

HOP_BY_HOP = ("current_positive_additive", "finite_activation_budget", "query_conditioned_transmission", "lateral_inhibition")
#: Of the greatest activation, what sums of the same parts in another order may differ by.
LAST_BITS = 1e-14


def visible_edges(edges: DataFrame, inactive: DataFrame | None = None, dormant: DataFrame | None = None) -> DataFrame:
    """Edges that traversal may take: not dormant, and with an active target."""
    if dormant is not None:
        edges = edges.join(dormant, ["source_id", "target_id", "edge_type"], "left_anti")
    if inactive is not None:
        edges = edges.join(inactive.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return edges


def first_rows(df: DataFrame, order: Sequence[str], n: int, turn: str) -> DataFrame:
    """The first n rows of each query. Each task cuts its rows of a query to n before the one shuffle; that Spark does so up to
    n, the session is told here."""
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    df.sparkSession.conf.set(limit, str(max(int(df.sparkSession.conf.get(limit, "1000")), n)))
    return df.withColumn(turn, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(turn) <= n)


def paths(seeds: DataFrame, edges: DataFrame, config: EngineConfig, query_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None) -> DataFrame:
    """query_id, node_id, seed_id, contribution, steps, step, generation, path, types of all simple paths from the seeds: one
    join for each hop.

    A finite budget scales the proposals of a hop, for each query, to its sum; a gate weighs each step by how the
    query's tokens meet those of the target and the edge's type. Expansions of a query end at their maximum, in the order
    in which a breadth-first walk from the best seed on meets them. Edges may have weights, a map: what they weigh to queries
    whose query_id, a struct, has that version. Of such edges, which are wide, only those whose source an edge leads to count
    after the first hop: they may be few enough to go to all tasks, so that few nodes of many paths need no shuffle."""
    kind = "array<struct<source_id:string,target_id:string,edge_type:string,weight:double,factuality:double>>"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("entry"), "node_id"))
    at = seeds.select("query_id", "node_id", F.col("entry").cast("double").alias("contribution"), F.array().cast(kind).alias("steps"), F.lit(0).alias("step"), F.array(F.lpad(rank.cast("string"), 9, "0"), F.col("node_id").cast("string")).alias("walk"), F.lit(0).cast("long").alias("before"))
    out = _told(at)
    gated, none = config.activation_strategy == "query_conditioned_transmission", F.array().cast("array<string>")
    if gated:  # by edge, not by step: of a node that many paths lead to, the tokens are joined and made a set a few times
        asked = query_tokens.select("query_id", F.array_distinct("query_tokens").alias("query_tokens"))
        edges = edges.withColumn("seen", tokens(F.col("edge_type"))).join(target_tokens, "target_id", "left")
        edges = edges.withColumn("seen", F.array_distinct(F.concat(F.coalesce("target_tokens", none), "seen"))).drop("target_tokens")
    inner = edges
    if "weights" in edges.columns:
        inner = edges.join(edges.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi")
    for hop in range(1, config.max_hops + 1 if config.use_graph_propagation else 1):
        step = at.join((edges if hop == 1 else inner).withColumnRenamed("source_id", "node_id"), "node_id").where(~F.array_contains(F.filter("walk", lambda x, i: (i == 1) | ((i > 0) & (i % 2 == 0))), F.col("target_id")))
        if "weights" in edges.columns:
            step = step.withColumn("weight", F.coalesce(F.try_element_at("weights", F.col("query_id.version")), F.col("weight")))
        c = F.col("contribution") * F.col("weight") * F.col("factuality") * config.hop_decay
        if gated:
            step = step.join(asked, "query_id", "left")
            c = c * set_gate(F.coalesce("query_tokens", none), F.col("seen"), config.query_transmission_floor, config.query_transmission_power)
        line = F.struct(F.col("node_id").alias("source_id"), "target_id", "edge_type", F.col("weight").cast("double").alias("weight"), F.col("factuality").cast("double").alias("factuality"))
        step = step.withColumn("contribution", c).where("contribution > 0")
        step = step.withColumn("walk", F.concat("walk", F.array("target_id", "edge_type"))).withColumn("steps", F.concat("steps", F.array(line)))
        step = first_rows(step, ("walk",), config.max_propagation_expansions, "turn").where(F.col("before") + F.col("turn") <= config.max_propagation_expansions)
        if config.activation_strategy == "finite_activation_budget":
            total = F.sum("contribution").over(Window.partitionBy("query_id"))
            step = step.withColumn("contribution", F.col("contribution") * F.least(F.lit(1.0), config.activation_budget / total))
        made = F.max(F.col("before") + F.col("turn")).over(Window.partitionBy("query_id"))
        at = step.select("query_id", F.col("target_id").alias("node_id"), "contribution", "steps", F.lit(hop).alias("step"), "walk", made.alias("before"))
        out = out.unionByName(_told(at))
    return out


def _told(at: DataFrame) -> DataFrame:
    """Rows of a hop as paths says them. All but contributions and steps stands in walk (rank and seed, then targets and types),
    so a hop that is read twice, for its rows and for the next hop, is one shuffle."""
    first = F.slice("walk", 1, 1)
    made = F.array_join(F.concat(first, F.slice("walk", F.lit(3), F.size("walk"))), "\0")
    nodes = F.filter("walk", lambda x, i: (i == 1) | ((i > 0) & (i % 2 == 0)))
    types = F.filter("walk", lambda x, i: (i > 2) & (i % 2 == 1))
    return at.select("query_id", "node_id", F.col("walk")[1].alias("seed_id"), "contribution", "steps", "step", made.alias("generation"), nodes.alias("path"), types.alias("types"))


def reduced(sums: DataFrame, config: EngineConfig) -> DataFrame:
    """A share of the greatest activation of a query, top, off all; null for what then has none, and for all but the strongest few, if so set.
    What equals the share has none, also where the order in which its parts were summed leaves something of it in the last
    bits."""
    left = F.col("activation") - config.inhibition_ratio * F.col("top")
    sums = sums.withColumn("activation", F.when(left > LAST_BITS * F.col("top"), left)).drop("top")
    if config.inhibition_top_k:
        w = Window.partitionBy("query_id").orderBy(F.desc("activation"), "node_id")
        sums = sums.withColumn("activation", F.when(F.row_number().over(w) <= config.inhibition_top_k, F.col("activation")))
    return sums


def inhibited(sums: DataFrame, config: EngineConfig) -> DataFrame:
    """Those that have some activation left."""
    top = sums.groupBy("query_id").agg(F.max("activation").alias("top"))
    return reduced(sums.join(top, "query_id"), config).where("activation is not null")


def activation(found: DataFrame, config: EngineConfig) -> DataFrame:
    """query_id, node_id, activation, n_paths: sums over paths; lateral inhibition takes a share of the greatest off."""
    sums = found.groupBy("query_id", "node_id").agg(F.sum("contribution").alias("activation"), F.count("*").alias("n_paths"))
    return inhibited(sums, config) if config.activation_strategy == "lateral_inhibition" else sums


def diagnostics(found: DataFrame, act: DataFrame, config: EngineConfig) -> DataFrame:
    """Hops, expansions, total and why each query ended."""
    n = found.groupBy("query_id").agg(F.max("step").alias("steps"), F.sum((F.col("step") > 0).cast("long")).alias("expansions"), F.count("*").alias("active_path_count"))
    total = act.groupBy("query_id").agg(F.sum("activation").alias("activation_total"))
    why = F.when(F.col("expansions") >= config.max_propagation_expansions, "max_expansions").when(F.col("steps") >= config.max_hops, "max_hops").otherwise("frontier_exhausted")
    return n.join(total, "query_id").select("query_id", "steps", "expansions", "activation_total", F.lit(True).alias("converged"), why.alias("stop_reason"), "active_path_count")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, component: the least node that edges reach in either direction, by labels that jump along labels."""
    from ..sources.lineage import cut

    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = new.select(F.col("node_id").alias("next"), F.col("next").alias("far"))
        new = cut(new.join(jump, "next", "left").select("node_id", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = new.select("node_id", F.col("next").alias("component"))
        if new.where("component <> next").isEmpty():
            return labels
