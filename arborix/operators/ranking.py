"""Normalisation, ranks and fusion of entry and graph scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import share
from ..sources.lineage import cut, dealt


#: Digits to which scores count in ranks: sums of the same parts in another order then tie.
DIGITS = 12
#: Digits to which raw sums of terms count where they choose: copies of a text then tie, in whatever order sums are made.
TIES = 9


def graph_normalised(df: DataFrame, kind: str) -> DataFrame:
    """df(query_id, activation) with graph: without what is below 0, as a share of the query's greatest or of its sum."""
    x = F.greatest(F.col("activation"), F.lit(0.0))
    if kind == "none":
        return df.withColumn("graph", x)
    total = df.groupBy("query_id").agg((F.max(x) if kind == "max" else F.sum(x)).alias("total"))
    return df.join(total, "query_id").withColumn("graph", share(x, F.col("total"))).drop("total")


def placed(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with the place of each row in its query, from 1.

    One query may rank all nodes of a corpus, so no task sorts a whole query: rows are sorted by range over all tasks,
    numbered in their task, and moved on by how many rows of the query lie in the tasks before. The numbered rows are
    written to the shared folder, so both steps see the same ranges."""
    order = ("query_id", *order)
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("numbered", F.monotonically_increasing_id()).withColumn("task", F.spark_partition_id()))
    parts = at.groupBy("query_id", "task").agg(F.min("numbered").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("first", F.col("first") - F.coalesce(before, F.lit(0)) - 1).drop("n")
    return at.join(parts, ["query_id", "task"]).withColumn(name, F.col("numbered") - F.col("first")).drop("numbered", "task", "first")


def ranked(df: DataFrame, score: str, name: str, positive: bool) -> DataFrame:
    """df with the rank of each row in its query, ties to the smaller node_id; without a rank, if so wanted, for no score."""
    at = placed(df, (F.desc(score), "node_id"), name)
    return at.withColumn(name, F.when(F.col(score) > 0, F.col(name))) if positive else at


def node_index(nodes: DataFrame) -> DataFrame:
    """node_id, pos of each node: its place, from 0, in the order of ids. With it, the rank of a node that has no score
    follows from counts: no row is made for it."""
    at = placed(nodes.select(F.lit(0).alias("query_id"), "node_id"), ("node_id",), "pos")
    return at.select("node_id", (F.col("pos") - 1).alias("pos"))


def fusion(rows: DataFrame, config: EngineConfig, last: DataFrame | None = None) -> DataFrame:
    """rows(entry, graph; re, rg under reciprocal ranks) with entry_part, graph_part and final. last: how many nodes of each
    query the graph ranks, if rows have it not; the last of them is worth nothing."""
    we, wg = (w / (config.entry_weight + config.graph_weight) for w in (config.entry_weight, config.graph_weight))
    if config.final_fusion_strategy == "linear":
        rows = rows.withColumns({"entry_part": F.col("entry") * we, "graph_part": F.col("graph") * wg})
    else:
        rows = rows if last is None else rows.join(last, "query_id", "left")
        gain = F.when(F.col("rg").isNotNull(), 1 / (config.rrf_k + F.col("rg")) - 1 / (config.rrf_k + F.col("last") + 1)).otherwise(0.0)
        rows = rows.withColumns({"entry_part": we / (config.rrf_k + F.col("re")), "graph_part": wg * gain}).drop("last")
    return rows.withColumn("final", F.round(F.col("entry_part") + F.col("graph_part"), DIGITS))


#: Rows of a query up to which one task ranks it; those of larger ones are sorted by range over all tasks.
LARGE = 1 << 20


def _ranks_of_small(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows, dealt by query, with graph, re, rg and last: nothing is shuffled for them."""
    q, x = Window.partitionBy("query_id"), F.greatest(F.col("activation"), F.lit(0.0))
    total = (F.max(x) if config.graph_normalization == "max" else F.sum(x)).over(q)
    rows = rows.withColumn("graph", x if config.graph_normalization == "none" else share(x, total))
    rows = rows.withColumn("re", F.row_number().over(q.orderBy(*_by("entry"))))
    rows = rows.withColumn("rg", F.when(F.col("graph") > 0, F.row_number().over(q.orderBy(*_by("graph")))))
    return rows.withColumn("last", F.count("rg").over(q))


def _ranks_of_large(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """As _ranks_of_small, with no query as one task's."""
    rows = placed(placed(graph_normalised(rows, config.graph_normalization), _by("entry"), "re"), _by("graph"), "rg")
    rows = rows.withColumn("rg", F.when(F.col("graph") > 0, F.col("rg")))
    return rows.join(rows.groupBy("query_id").agg(F.count("rg").alias("last")), "query_id")


def _by(score: str) -> tuple[Column, str]:
    return F.round(score, TIES).desc(), "node_id"


def fused(entry: DataFrame, graph: DataFrame, config: EngineConfig) -> DataFrame:
    """query_id, node_id, entry, graph, final of the rows of both sides: linear, or by reciprocal ranks among those rows.

    For ranks, rows are shuffled once, by query, and written so: both orders, and what is counted of a query, are found there."""
    both = entry.select("query_id", "node_id", "entry").join(graph.select("query_id", "node_id", "activation"), ["query_id", "node_id"], "full").fillna(0.0, ["entry", "activation"])
    if config.final_fusion_strategy == "linear":
        return fusion(graph_normalised(both, config.graph_normalization), config)
    both, _ = dealt(["query_id"], both.repartition("query_id"))
    large = both.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("query_id")
    if large.isEmpty():
        return fusion(_ranks_of_small(both, config), config).drop("last")
    large = cut(large)
    small, many = both.join(large, "query_id", "left_anti"), both.join(large, "query_id", "left_semi")
    return fusion(_ranks_of_small(small, config).unionByName(_ranks_of_large(many, config)), config).drop("last")


#: Places of the node index to a bucket: a query's rows of one bucket are counted by one task.
BUCKET = 1 << 16


def _counted(rows: DataFrame) -> DataFrame:
    """rows(query_id, pos, scored) with before and scored_before: how many rows of the query, and scored ones, have a smaller
    pos. Places are dense, so a bucket of them is a range of bounded size, and no sample is needed to cut ranges."""
    key = ["query_id", "bucket"]
    rows = rows.withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    here = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("query_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    one, hit = F.lit(1).cast("long"), F.col("scored").cast("long")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(hit).alias("s"))
    sizes = sizes.select(*key, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s"))
    at = rows.withColumns({"before": F.coalesce(F.sum(one).over(here), F.lit(0)), "scored_before": F.coalesce(F.sum(hit).over(here), F.lit(0))})
    at = at.join(sizes, key).withColumns({"before": F.col("before") + F.col("n"), "scored_before": F.col("scored_before") + F.col("s")})
    return at.drop("bucket", "n", "s")


def _unmet(rows: DataFrame, queries: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """query_id, node_id, pos, scored_before of the first limit nodes that a query has no row for, in the order of ids.

    The m-th of them lies at m plus the rows before it, and those are the rows with at most m missing places before
    them. So a table of limit numbers for each query says where they are."""
    gaps = rows.withColumn("m", F.col("pos") - F.col("before")).where(F.col("m") < limit).groupBy("query_id", "m").agg(F.count("*").alias("n"), F.sum(F.col("scored").cast("long")).alias("s"))
    each = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long"))).alias("m")).join(gaps, ["query_id", "m"], "left")
    upto = Window.partitionBy("query_id").orderBy("m")
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    return each.select("query_id", (F.col("m") + total("n")).alias("pos"), total("s").alias("scored_before")).join(index, "pos")


def standings(entry: DataFrame, graph: DataFrame, queries: DataFrame, index: DataFrame, config: EngineConfig, limit: int) -> DataFrame:
    """query_id, node_id, entry, activation, graph, re, rg, entry_part, graph_part, final of all nodes that a query scores
    or reaches, and of the first limit others: the best limit of all nodes are among them.

    entry(query_id, node_id, entry): the nodes whose entry score is positive; all others of the index have 0. re is the
    rank by entry among all nodes of the index, rg that by activation among those that have some. The others have no rows:
    their rank is the number of scored nodes, and their place in the index less the scored ones before it."""
    e = entry.where("entry > 0").select("query_id", "node_id", "entry")
    g = graph.select("query_id", "node_id", F.round("activation", DIGITS).alias("activation")).where("activation > 0")
    both = e.join(g, ["query_id", "node_id"], "full").withColumn("scored", F.col("entry").isNotNull()).fillna(0.0, ["entry", "activation"])
    both = _counted(cut(both.join(index, "node_id")))
    if config.final_fusion_strategy != "linear":
        both = placed(both, (F.desc("entry"), "node_id"), "re")  # right for scored nodes
        both = ranked(both, "activation", "rg", True)
    both = cut(both)
    found = both.unionByName(_unmet(both, queries, index, limit).withColumns({"entry": F.lit(0.0), "activation": F.lit(0.0), "scored": F.lit(False)}), allowMissingColumns=True)
    x = F.col("activation")
    total = both.groupBy("query_id").agg((F.max(x) if config.graph_normalization == "max" else F.sum(x)).alias("total"), F.sum(F.col("scored").cast("long")).alias("n_scored"), F.sum((x > 0).cast("long")).alias("last"))
    found = found.join(total.select("query_id", "total", "n_scored"), "query_id", "left")
    found = found.withColumn("graph", x if config.graph_normalization == "none" else share(x, F.coalesce("total", F.lit(0.0))))
    if config.final_fusion_strategy != "linear":
        found = found.withColumn("re", F.when(F.col("scored"), F.col("re")).otherwise(F.coalesce("n_scored", F.lit(0)) + 1 + F.col("pos") - F.col("scored_before")))
    return fusion(found.drop("total", "n_scored", "pos", "before", "scored_before", "scored"), config, total.select("query_id", "last"))


def top(df: DataFrame, score: str, limit: int, digits: int | None = None) -> DataFrame:
    """The limit best rows of each query, ties to the smaller node_id; scores as they are, or compared to so many digits."""
    by = F.col(score) if digits is None else F.round(score, digits)
    w = Window.partitionBy("query_id").orderBy(by.desc(), "node_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
