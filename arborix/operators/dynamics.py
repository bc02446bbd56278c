"""Recurrent spreading of activation: global and local competition, anchored or not, for many queries at once.

The limit of expansions bounds what a step may cost, and it is used before rows are made: of a source's edges only the
first targets can ever be walked, and of a query's states only those that the limit reaches in the order of the walk. Edges
are dealt once, by source and by slices of a bounded size, so a hub with a third of them lies in many tasks, and states come
to them. What competes (the proposals of one state, or of one query) is bounded by the limit as well. A step shuffles the states
that walk, to their edges, and what they propose, to its query; its messages and its states are written in buckets of queries and
stay there, beside a small table with a row for each query. Queries stop one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import set_gate, tokens
from ..sources.lineage import cut, dealt
from . import graph

STEP = "struct<source_id:string,target_id:string,edge_type:string,weight:double,factuality:double>"
GATED = ("recurrent_competition", "local_neighbor_query_competition", "local_neighbor_query_path_competition", "anchored_local_query_competition")
BY_PATH = ("local_neighbor_path_competition", "local_neighbor_query_path_competition")
ANCHORED = ("anchored_local_competition", "anchored_local_query_competition")


@dataclass(frozen=True)
class Propagation:
    """activation(query_id, node_id, activation), paths(query_id, node_id, seed_id, contribution, steps, step, generation)
    and diagnostics(query_id, steps, expansions, activation_total, converged, stop_reason, active_path_count)."""

    activation: DataFrame
    paths: DataFrame
    diagnostics: DataFrame


#: Edges of a slice of a source, few, as the states of all queries that come to a hub meet them; digits to which activations and messages count, so equal ones tie whatever was summed first.
SLICE, DIGITS = 16, 12


def _last(field: str) -> Column:
    """Of the last step of a path; null for a seed's."""
    return F.try_element_at("steps", F.lit(-1))[field]


@dataclass(frozen=True)
class Sliced:
    """edges(node_id, slice, target_id, edge_type, weight, factuality, out, seen), in buckets of node_id and slice, with
    what is known of the edges of their targets; sources(node_id, out: targets, all edges, the most edges to one target, slices). bounded: no source has more edges than walks can take."""

    edges: DataFrame
    sources: DataFrame
    bounded: bool


def sliced(edges: DataFrame, config: EngineConfig, target_tokens: DataFrame | None = None) -> Sliced:
    """The edges that walks can take. Within a state, expansions go by target and type, and a path excludes its own targets
    only; so of a source the first max_propagation_expansions edges, and as many as lead to the targets of a path, are all
    that count. Each task cuts the targets of a source before they are shuffled, so a hub is not sorted as a whole."""
    number = lambda c: F.col(c).cast("double").alias(c)
    e = edges.select(F.col("source_id").alias("node_id"), "target_id", "edge_type", number("weight"), number("factuality"))
    gated, spark, limit = config.activation_strategy in GATED, edges.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold"
    bounded = not (gated and config.query_transmission_floor <= 0)  # else a query's gate can be 0, and its edges not count
    if bounded:
        e = e.where(F.col("weight") * F.col("factuality") * config.hop_decay > 0)
        most = config.max_propagation_expansions + config.recurrent_steps + 1
        source, pair = Window.partitionBy("node_id"), Window.partitionBy("node_id", "target_id")
        e = e.withColumn("turn", F.dense_rank().over(source.orderBy("target_id"))).where(F.col("turn") <= most)
        e = e.withColumn("wide", F.count("*").over(pair)).withColumn("wide", F.max("wide").over(source))
        e = e.withColumn("row", F.row_number().over(source.orderBy("target_id", "edge_type")))
        e = e.where(F.col("row") <= config.max_propagation_expansions + (config.recurrent_steps + 1) * F.col("wide")).drop("wide", "row")
        e = e.withColumns({"targets": F.max("turn").over(source), "all": F.count("*").over(source), "widest": F.count("*").over(pair)})
        e = e.withColumn("widest", F.max("widest").over(source)).drop("turn")
        before = spark.conf.get(limit, "1000")
        spark.conf.set(limit, str(max(int(before), most)))  # up to this, tasks cut ranks before the shuffle
        try:
            e = cut(e)
        finally:
            spark.conf.set(limit, before)
        n = e.select("node_id", "targets", "all", "widest").distinct()
        e = e.drop("targets", "all", "widest")
    else:
        e = cut(e)
        n = e.groupBy("node_id", "target_id").agg(F.count("*").alias("n"))
        n = n.groupBy("node_id").agg(F.count("*").alias("targets"), F.sum("n").alias("all"), F.max("n").alias("widest"))
    n = cut(n.select("node_id", F.struct("targets", "all", "widest", F.ceil(F.col("all") / SLICE).alias("slices")).alias("out")))
    if gated:
        none = F.array().cast("array<string>")
        e = e.join(target_tokens, "target_id", "left").withColumn("seen", F.array_distinct(F.concat(F.coalesce("target_tokens", none), tokens(F.col("edge_type"))))).drop("target_tokens")
    e = e.join(n.withColumnsRenamed({"node_id": "target_id"}), "target_id", "left")
    hubs = n.where("out.slices > 1").select("node_id", "out.slices")
    e = e.join(hubs, "node_id", "left").withColumn("slice", F.pmod(F.xxhash64("target_id", "edge_type"), F.coalesce("slices", F.lit(1)))).drop("slices")
    return Sliced(dealt(("node_id", "slice"), e.repartition("node_id", "slice"))[0], n, bounded)


def _order(config: EngineConfig) -> tuple[str, ...]:
    """How a query's walk meets its states, before the targets and types of each."""
    return ("negative", "node_id", "from", "copy") if config.activation_strategy in BY_PATH else ("node_id",)


def _walked(state: DataFrame, config: EngineConfig) -> DataFrame:
    """The states (with left, the expansions that their query has) that a walk in order comes to, one row for each slice of
    their edges. A state gives as many expansions as its source has edges, less those to targets on its path, or more; so those
    after which nothing is left are known without a look at edges."""
    s = state.where("activation > 0 and out is not null").withColumn("negative", -F.col("activation"))
    before = Window.partitionBy("query_id").orderBy(*_order(config)).rowsBetween(Window.unboundedPreceding, -1)
    held = F.size("steps") + 1
    gives = F.greatest(F.col("out.targets") - held, F.col("out.all") - held * F.col("out.widest"), F.lit(0))
    s = s.withColumn("gone", F.coalesce(F.sum(gives).over(before), F.lit(0))).where("gone < left")
    return s.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out.slices") - 1))).drop("out", "old", "gone")


def _proposals(walked: DataFrame, at: Sliced, config: EngineConfig) -> DataFrame:
    """What each active state offers to targets that are not on its path, as far as its query's expansions go. A gate is as much
    work as all the rest, and made once: what is above 0 at its floor is so without a look at it."""
    p = walked.join(at.edges.hint("merge"), ["node_id", "slice"])  # small as files, not in memory: not to be sent to all tasks
    p = p.where((F.col("target_id") != F.col("seed_id")) & ~F.array_contains(F.col("steps.target_id"), F.col("target_id")))
    c, sure = F.col("activation") * F.col("weight") * F.col("factuality") * config.hop_decay, F.lit(False)
    if config.activation_strategy in GATED:
        sure = c * config.query_transmission_floor > 0
        c = c * set_gate(F.coalesce("query_tokens", F.array().cast("array<string>")), F.col("seen"), config.query_transmission_floor, config.query_transmission_power)
    p = p.withColumn("contribution", c).where(sure | (F.col("contribution") > 0))
    order = (*_order(config), "target_id", "edge_type")
    if at.bounded:  # by then a query has not many more than it may take, and one sort of them is enough
        p = p.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    else:
        p = graph.first_rows(p, order, config.max_propagation_expansions, "turn")
    return p.where(F.col("turn") <= F.col("left"))


def _messages(p: DataFrame, config: EngineConfig) -> DataFrame:
    """What arrives of the proposals, as rows; those that lose in the competition have no value. Those of one query, or one
    state, compete; the limit of expansions bounds them."""
    c = F.col("contribution")
    if config.activation_strategy == "recurrent_competition":
        total = F.sum(c).over(Window.partitionBy("query_id"))
        value = c * F.when(total > config.activation_budget, config.activation_budget / total).otherwise(1.0)
    else:
        w = Window.partitionBy("query_id", *_order(config))  # a state, in the order of the walk: sorted so already
        p = p.withColumn("rest", c - F.when(F.count("*").over(w) > 1, config.inhibition_ratio * F.max(c).over(w)).otherwise(0.0))
        rest = F.when(F.col("rest") > 0, F.col("rest"))
        value = rest * F.least(F.lit(1.0), config.activation_budget * F.col("activation") / F.sum(rest).over(w))
    step = F.struct(F.col("node_id").alias("source_id"), "target_id", "edge_type", "weight", "factuality")
    p = p.withColumn("value", F.round(value, DIGITS)).withColumn("steps", F.concat("steps", F.array(step)))  # a path grows after the shuffle
    return p.select("query_id", F.col("target_id").alias("node_id"), "seed_id", "value", "steps", F.concat_ws(">", "from", "target_id").alias("from"), F.lit(True).alias("fresh"), "out", F.lit(0.0).alias("old"))


def _as_rows(state: DataFrame, config: EngineConfig, ends: bool) -> DataFrame:
    """What is left of states, in the form of messages, and what they were; without their paths, if no query walks on."""
    left = F.round(F.col("activation") * config.recurrent_decay, DIGITS)
    way = {c: F.lit(None).cast(state.schema[c].dataType).alias(c) if ends else F.col(c) for c in ("seed_id", "steps", "from", "out")}
    return state.select("query_id", "node_id", left.alias("value"), *way.values(), F.lit(False).alias("fresh"), F.col("activation").alias("old"))


def _all_end(told: DataFrame, running: DataFrame) -> bool:
    """Whether the messages of a step use up the expansions of all queries that were running."""
    spent = told.groupBy("query_id").agg(F.count("*").alias("n"))
    return running.join(spent, "query_id", "left").where(F.coalesce("n", F.lit(0)) < F.col("left")).isEmpty()


def _end_states(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """As _node_states and _path_states, where no query walks on: activations alone, for which no paths need be compared."""
    if config.activation_strategy in BY_PATH:
        copy = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.desc("value")))
        live = F.when((F.col("value") > 0) & (copy <= config.max_active_paths_per_node), F.col("value"))
        return rows.select("query_id", "node_id", live.alias("activation"), "old").where("activation is not null or old > 0")
    out = rows.groupBy("query_id", "node_id").agg(F.round(F.sum("value"), DIGITS).alias("activation"), F.sum("old").alias("old"))
    return _live(out, config)


def _live(nodes: DataFrame, config: EngineConfig) -> DataFrame:
    if config.activation_strategy == "recurrent_competition":  # the limit of expansions bounds a query's nodes
        return graph.reduced(nodes.withColumn("top", F.max("activation").over(Window.partitionBy("query_id"))), config)
    return nodes.withColumn("activation", F.when(F.col("activation") > 0, F.col("activation")))


def _node_states(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """One state a node: the sum of what is left of the last one and of all messages; its path is that of the best message of
    this step, even if an earlier one was better. Nodes that have nothing left stay, without activation, with what they had."""
    overall, node = config.activation_strategy == "recurrent_competition", Window.partitionBy("query_id", "node_id")
    best = node.orderBy(F.desc("fresh"), F.desc("value"), F.desc("seed_id" if overall else "from"), _last("source_id"), _last("edge_type"))
    out = rows.withColumn("turn", F.row_number().over(best))  # one sort, for the sums and for the greatest of a query as well
    out = out.withColumns({"activation": F.sum("value").over(node), "old": F.sum("old").over(node)}).where("turn = 1")
    out = out.select("query_id", "node_id", F.round("activation", DIGITS).alias("activation"), "seed_id", "steps", "from", F.lit(1).alias("copy"), "out", "old")
    return _live(out, config)


def _path_states(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """A state for each arrival by a path, of each node the strongest ones; a path that is walked anew is one more state. Those
    that are no more stay, without activation, with what they had."""
    types = F.concat(F.array_join("steps.edge_type", '"'), F.lit('"'))
    w = Window.partitionBy("query_id", "node_id").orderBy(F.desc("value"), "from", types, "steps")
    out = rows.withColumn("copy", F.row_number().over(w))
    live = F.when((F.col("value") > 0) & (F.col("copy") <= config.max_active_paths_per_node), F.col("value"))
    out = out.select("query_id", "node_id", live.alias("activation"), "seed_id", "steps", "from", "copy", "out", "old")
    return out.where("activation is not null or old > 0")


def _sums(state: DataFrame) -> DataFrame:
    return state.groupBy("query_id", "node_id").agg(F.sum("activation").alias("activation"))


def recurrent(seeds: DataFrame, edges: DataFrame, config: EngineConfig, query_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None) -> Propagation:
    """Spreads seeds(query_id, node_id, entry) for recurrent_steps or until nothing moves by more than the tolerance."""
    strategy, by_path = config.activation_strategy, config.activation_strategy in BY_PATH
    at = sliced(edges, config, target_tokens)
    start = seeds.select("query_id", "node_id", F.col("entry").cast("double").alias("activation"), F.col("node_id").alias("seed_id"), F.array().cast(f"array<{STEP}>").alias("steps"), F.col("node_id").alias("from"), F.lit(1).alias("copy"))
    start = start.join(at.sources, "node_id", "left").select("query_id", "node_id", "activation", "seed_id", "steps", "from", "copy", "out", F.lit(0.0).alias("old"))
    state, start = dealt(["query_id"], start.repartition("query_id"))
    status = start.groupBy("query_id").agg(F.lit(0).alias("steps"), F.lit(0).cast("long").alias("expansions"), F.lit(False).alias("converged"), F.lit(False).alias("done"), F.lit("recurrent_step_limit").alias("stop_reason"))
    status = cut(status)
    paths = [start.select("query_id", "node_id", "seed_id", F.col("activation").alias("contribution"), "steps", F.lit(0).alias("step"), F.lit("").alias("generation"))]
    states = []
    if strategy in GATED:  # sets once for each query, as those of edges: not for each proposal
        asked = query_tokens.select("query_id", F.array_distinct("query_tokens").alias("query_tokens"))
    for step in range(1, config.recurrent_steps + 1):
        running = status.where("not done").select("query_id", (config.max_propagation_expansions - F.col("expansions")).alias("left"))
        active = state.join(running, "query_id")
        sent = _walked(active, config)
        sent = sent.join(asked, "query_id", "left") if strategy in GATED else sent
        ends = []

        def kept(told: DataFrame) -> DataFrame:
            ends.append(step == config.recurrent_steps or _all_end(told, running))
            return _as_rows(active, config, ends[0])

        rows, m = dealt(["query_id"], _messages(_proposals(sent, at, config), config), kept)
        m = m.where("fresh")
        now = _end_states if ends[0] else _path_states if by_path else _node_states
        state, new = dealt(["query_id"], now(rows.where("value is not null"), config))
        moved = state.groupBy("query_id", "node_id").agg((F.coalesce(F.sum("activation"), F.lit(0.0)) - F.sum("old")).alias("moved"))
        moved = moved.groupBy("query_id").agg(F.max(F.abs("moved")).alias("delta"))
        state = state.where("activation is not null")
        states.append(new.where("activation is not null").select("query_id", "node_id", "activation"))
        paths.append(m.where("value is not null").select("query_id", "node_id", "seed_id", F.col("value").alias("contribution"), "steps", F.lit(step).alias("step"), F.concat_ws("\0", _last("source_id"), "node_id", _last("edge_type")).alias("generation")))
        spent = rows.where("fresh").groupBy("query_id").agg(F.count("*").alias("n"))
        s = status.join(moved, "query_id", "left").join(spent, "query_id", "left")
        total = F.col("expansions") + F.coalesce("n", F.lit(0))
        full, still, go = total >= config.max_propagation_expansions, F.coalesce("delta", F.lit(0.0)) <= config.convergence_tolerance, ~F.col("done")
        why = F.when(go & still, "converged").when(go & full, "max_expansions").otherwise(F.col("stop_reason"))
        status = cut(s.select("query_id", F.when(go, step).otherwise(F.col("steps")).alias("steps"), F.when(go, total).otherwise(F.col("expansions")).alias("expansions"), (F.col("converged") | (go & still)).alias("converged"), (F.col("done") | still | full).alias("done"), why.alias("stop_reason")))
        if status.where("not done").isEmpty():
            break
    found = paths[0]
    for more in paths[1:]:
        found = found.unionByName(more)
    ended = status.select("query_id", F.col("steps").alias("last"))
    last = None
    for i, x in enumerate(states, 1):  # a query's states are those of the step at which it ended
        x = x.join(ended.where(F.col("last") == i).select("query_id"), "query_id", "left_semi")
        last = x if last is None else last.unionByName(x)
    act = _sums(last)
    if strategy in ANCHORED:
        residual = start.join(status.select("query_id", F.col("steps").alias("n")), "query_id")
        residual = residual.select("query_id", "node_id", (F.col("activation") * F.pow(F.lit(config.recurrent_decay), F.col("n"))).alias("anchor"))
        left = F.round(F.col("activation") - F.coalesce("anchor", F.lit(0.0)), DIGITS)
        act = act.join(residual, ["query_id", "node_id"], "left").where(F.col("anchor").isNull() | (left > 0)).select("query_id", "node_id", left.alias("activation"))
        found = found.where("step > 0")
    live = found.groupBy("query_id").agg(F.count("*").alias("all_paths"), F.countDistinct("node_id").alias("nodes"))
    total = act.groupBy("query_id").agg(F.sum("activation").alias("activation_total"))
    d = status.join(total, "query_id", "left").join(live, "query_id", "left")
    if by_path:
        d = d.join(last.groupBy("query_id").agg(F.count("*").alias("states")), "query_id", "left")
    n = F.col("all_paths" if strategy in ANCHORED else "states" if by_path else "nodes")
    d = d.select("query_id", "steps", "expansions", F.coalesce("activation_total", F.lit(0.0)).alias("activation_total"), "converged", "stop_reason", F.coalesce(n, F.lit(0)).alias("active_path_count"))
    return Propagation(act, found, d)


def propagate(seeds: DataFrame, edges: DataFrame, config: EngineConfig, query_tokens: DataFrame | None = None, target_tokens: DataFrame | None = None) -> Propagation:
    """Any of the eleven strategies. The four that go hop by hop stay lazy; the others run their steps."""
    if not config.use_graph_propagation:
        none = seeds.select("query_id").distinct().select("query_id", F.lit(0).alias("steps"), F.lit(0).cast("long").alias("expansions"), F.lit(0.0).alias("activation_total"), F.lit(True).alias("converged"), F.lit("graph_disabled").alias("stop_reason"), F.lit(0).cast("long").alias("active_path_count"))
        found = graph.paths(seeds, edges, config).where("false")
        return Propagation(graph.activation(found, config), found, none)
    if config.activation_strategy not in graph.HOP_BY_HOP:
        return recurrent(seeds, edges, config, query_tokens, target_tokens)
    found = graph.paths(seeds, edges, config, query_tokens, target_tokens)
    act = graph.activation(found, config)
    found = found.join(act.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi")
    return Propagation(act, found, graph.diagnostics(found, act, config))


def explained(found: DataFrame, limit: int) -> DataFrame:
    """query_id, node_id, paths: the strongest few paths to each node, ties by seed and then as they came to be."""
    w = Window.partitionBy("query_id", "node_id").orderBy(F.desc("contribution"), "seed_id", "step", "generation")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    one = F.struct("r", "seed_id", "contribution", "steps", F.when(F.size("steps") > 0, "graph").otherwise("entry_zero_hop").alias("kind"))
    return best.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(one)).alias("paths"))
