"""Entry retrieval: BM25, cosine, blended entry scores and seeds, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import share, tokens, weighted
from ..sources.lineage import cut

K1, B = 1.5, 0.75


def postings(nodes: DataFrame) -> DataFrame:
    """node_id, term, tf of nodes(node_id, text): counted by each task before the shuffle."""
    return nodes.select("node_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of queries(query_id, text); terms that repeat count again."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_weights(nodes: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of all terms that are asked for, by node; and query_id, term, weight, mean: what a term weighs in each
    query, a small table.

    Texts are read and split once: only the terms that are asked for leave the scan, counted by node, and with them an
    empty term for each node, which corpus statistics come from. The counts are written once, and read by all that needs them."""
    asked = query_terms(queries)
    wanted = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term")))
    base = nodes.select("node_id", tokens(F.col("text")).alias("terms"))
    base = base.select("node_id", F.size("terms").alias("dl"), F.explode(F.concat(F.coalesce("terms", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    posts = cut(base.join(wanted, "term", "left_semi").groupBy("node_id", "dl", "term").agg(F.count("*").alias("tf")))
    stats = posts.where("term = ''").agg(F.count("*").alias("n"), F.avg(F.when(F.col("dl") >= 0, F.col("dl"))).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(document_frequencies(posts.where("term <> ''")), "term").join(F.broadcast(stats))  # stats: one row
    return posts, weights.select("query_id", "term", (F.col("qtf") * idf).alias("weight"), F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"))


def bm25(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id, score of the nodes that hold a term of the query.

    A node's few counts become a row for each query that they meet, many times more than they are: so counts are dealt by node over all
    partitions of the session, which Spark, seeing how small they are, would else put together, and scores are summed where they arise."""
    posts, weights = term_weights(nodes, queries)
    posts = posts.repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node_id")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return posts.join(F.broadcast(weights), "term").groupBy("query_id", "node_id").agg(F.sum(part).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, no less than 0; 0 if one is all zeros. Vectors of different sizes are an error."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x)))
    unlike = F.size(a) != F.size(b)
    return F.when(unlike, F.raise_error(F.lit("vectors of different sizes")).cast("double")).when(size > 0, F.greatest(F.lit(0.0), dot / size)).otherwise(0.0)


def entry_scores(sparse: DataFrame, dense: DataFrame | None, config: EngineConfig) -> DataFrame:
    """query_id, node_id, entry: max-normalised BM25 and cosine, blended; without dense retrieval, BM25 alone."""
    both = sparse.select("query_id", "node_id", F.col("score").alias("s"))
    if dense is None or not config.use_dense_retrieval:
        both = both.withColumn("d", F.lit(0.0))
        blend = lambda s, d: s
    else:
        both = both.join(dense.select("query_id", "node_id", F.col("score").alias("d")), ["query_id", "node_id"], "full").fillna(0.0, ["s", "d"])
        blend = lambda s, d: weighted(s, d, config.sparse_weight, config.dense_weight)
    top = both.groupBy("query_id").agg(F.max("s").alias("ms"), F.max("d").alias("md"))
    return both.join(top, "query_id").select("query_id", "node_id", blend(share(F.col("s"), F.col("ms")), share(F.col("d"), F.col("md"))).alias("entry"))


def seeds(entry: DataFrame, k: int) -> DataFrame:
    """The k best of each query, then without those that have nothing."""
    w = Window.partitionBy("query_id").orderBy(F.desc("entry"), "node_id")
    return entry.withColumn("seed_rank", F.row_number().over(w)).where((F.col("seed_rank") <= k) & (F.col("entry") > 0))
