"""Scores of a stated set of queries against all nodes, by blocks: products of matrices, of which only candidates leave.

Queries come in blocks of a bounded size, whose vectors and weights of terms are sent to all tasks. A task reads nodes in
batches, multiplies them with the block, and keeps the best k of each query; so no row is made for a node and a query, except
for those that share a term."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.encode import hashed
from ..functions.text import tokens
from ..sources.lineage import cut
from . import retrieval
from .ranking import DIGITS

#: Queries of a block; rows of nodes that are multiplied at once.
QUERIES, ROWS = 512, 2_048
Encoder = Callable[[list[str]], np.ndarray]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of unit rows, no less than 0; to so many digits that equal texts tie, whatever else is multiplied with them."""
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors of different sizes")
    return np.maximum(0.0, np.round(x @ q.T, DIGITS)) + 0.0


class Best:
    """The k best (score, id) of each of n queries, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.found, self.floor = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def add(self, ids: list, scores: np.ndarray) -> None:
        near = scores >= self.floor
        for j in np.flatnonzero(near.any(0)).tolist():
            at = np.flatnonzero(near[:, j])
            if len(at) > 4 * self.k:  # those below the k-th of this batch can't stay
                s = scores[at, j]
                at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
            rows = self.found[j] + [(-float(scores[i, j]), ids[i]) for i in at.tolist()]
            self.found[j] = sorted(rows)[: self.k]
            if len(self.found[j]) == self.k:
                self.floor[j] = -self.found[j][-1][0]


def _blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """queries in blocks of about QUERIES rows."""
    n = max(1, -(-queries.count() // QUERIES))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else queries


def _schema(queries: DataFrame, nodes: DataFrame, *columns: str) -> StructType:
    ids = [StructField("query_id", queries.schema["query_id"].dataType), StructField("node_id", nodes.schema["node_id"].dataType)]
    return StructType([*ids, *(StructField(c, DoubleType()) for c in columns)])


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, node_id, score: the k greatest cosines of vectors(node_id, v) for each of queries(query_id, q), ties to the
    smaller node_id. Vectors of different sizes are an error."""
    schema, out = _schema(queries, vectors, "score"), []
    for block in _blocks(queries):
        rows = block.select("query_id", "q").collect()
        ids, q = [r[0] for r in rows], unit(np.array([r[1] for r in rows], float)) if rows else np.zeros((0, 0))

        def work(batches: Iterator[pa.RecordBatch], ids: list = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for b in batches:
                for i in range(0, b.num_rows if ids else 0, ROWS):
                    part = b.slice(i, ROWS)
                    best.add(part.column(0).to_pylist(), cosines(unit(np.array(part.column(1).to_pylist(), float)), q))
            yield _batch([(ids[j], n, -s) for j, f in enumerate(best.found) for s, n in f], schema)

        out.append(vectors.select("node_id", "v").mapInArrow(work, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return _joined(out).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


@dataclass(frozen=True)
class Block:
    """Queries with their unit vectors, and for each term the queries that hold it and its weight there."""

    ids: list
    q: np.ndarray
    terms: dict[str, list[tuple[int, float]]]
    mean: float
    encoder: Encoder

    def scores(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """BM25 and cosine of texts, a row for each and a column for each query."""
        sparse = np.zeros((len(words), len(self.ids)))
        for i, w in enumerate(words):
            length = retrieval.K1 * (1 - retrieval.B + retrieval.B * len(w) / self.mean)
            for term, tf in sorted(Counter(x for x in w if x in self.terms).items()):
                gain = tf * (retrieval.K1 + 1) / (tf + length)
                for j, weight in self.terms[term]:
                    sparse[i, j] += weight * gain
        x = np.array([self.encoder(w) for w in words], float).reshape(len(words), -1)
        return sparse, cosines(unit(x), self.q)


class Lanes:
    """Both lanes of entry retrieval for nodes(node_id, text) and a stated set of queries(query_id, text)."""

    def __init__(self, nodes: DataFrame, queries: DataFrame, encoder: Encoder = hashed) -> None:
        parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short texts are small files, which few tasks would read
        self.nodes, self.encoder = nodes.select("node_id", "text").repartition(parts, "node_id").select("node_id", tokens(F.col("text")).alias("words")), encoder
        self.queries = queries.select("query_id", tokens(F.col("text")).alias("words"))
        self.weights = cut(retrieval.term_weights(nodes, queries)[1])

    def blocks(self) -> Iterator[Block]:
        for part in _blocks(self.queries):
            ids, words = zip(*((r["query_id"], r["words"] or []) for r in part.collect()), strict=True) if not part.isEmpty() else ((), ())
            at, terms, mean = {x: i for i, x in enumerate(ids)}, defaultdict(list), 1.0
            for r in self.weights.join(part.select("query_id"), "query_id", "left_semi").collect():
                terms[r["term"]].append((at[r["query_id"]], r["weight"]))
                mean = r["mean"]
            yield Block(list(ids), unit(np.array([self.encoder(w) for w in words], float)) if ids else np.zeros((0, 0)), dict(terms), mean, self.encoder)

    def _over(self, work: Callable[[Iterator[tuple[list, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], block: Block, schema: StructType) -> DataFrame:
        held = self.nodes.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
                for b in batches:
                    for i in range(0, b.num_rows if held.value.ids else 0, ROWS):
                        part = b.slice(i, ROWS)
                        yield part.column(0).to_pylist(), *held.value.scores([w or [] for w in part.column(1).to_pylist()])

            yield from work(parts())

        return self.nodes.mapInArrow(run, schema)

    def candidates(self, k: int) -> DataFrame:
        """query_id, node_id, sparse, dense of all nodes that share a term with a query, and of the k nearest of the others.

        Whatever the blend of the two lanes, each as a share of the query's greatest, its k best nodes are among them:
        a node that isn't has no sparse score, and k others are as near."""
        schema, out = _schema(self.queries, self.nodes, "sparse", "dense"), []
        for block in self.blocks():

            def work(parts: Iterator, ids: list = block.ids) -> Iterator[pa.RecordBatch]:
                best = Best(len(ids), k)
                for nodes, sparse, dense in parts:
                    rows, columns = np.nonzero(sparse)
                    yield _batch([(ids[j], nodes[i], float(sparse[i, j]), float(dense[i, j])) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)], schema)
                    best.add(nodes, np.where(sparse > 0, -1.0, dense))
                yield _batch([(ids[j], n, 0.0, -s) for j, f in enumerate(best.found) for s, n in f if s <= 0], schema)

            out.append(self._over(work, block, schema))
        found = _joined(out)
        w = Window.partitionBy("query_id", F.col("sparse") > 0).orderBy(F.desc("dense"), "node_id")
        return found.withColumn("r", F.when(F.col("sparse") > 0, 0).otherwise(F.row_number().over(w))).where(F.col("r") <= k).drop("r")

    def among_all(self, rows: DataFrame, maxima: DataFrame, sparse_weight: float, dense_weight: float) -> DataFrame:
        """query_id, node_id, re: the rank of rows(query_id, node_id, entry) by entry among all nodes, ties to the smaller
        node_id. maxima(query_id, ms, md): the query's greatest scores. A task counts how many of its nodes lie between
        two of the rows; rows are those that the limit of expansions lets a query reach, so they are few for a query."""
        schema = StructType([StructField("query_id", self.queries.schema["query_id"].dataType), StructField("i", LongType()), StructField("n", LongType())])
        total, out = sparse_weight + dense_weight, []
        w = Window.partitionBy("query_id").orderBy(F.desc("entry"), "node_id")
        rows = cut(rows.withColumn("i", F.row_number().over(w).cast("long") - 1))
        for block in self.blocks():
            asked = rows.sparkSession.createDataFrame([(x,) for x in block.ids], StructType([schema[0]])) if block.ids else rows.select("query_id").limit(0)
            at, most = {x: j for j, x in enumerate(block.ids)}, {r["query_id"]: (r["ms"], r["md"]) for r in maxima.join(F.broadcast(asked), "query_id").collect()}
            marks: list[list[tuple[float, object]]] = [[] for _ in block.ids]
            for r in rows.join(F.broadcast(asked), "query_id").orderBy("i").collect():
                marks[at[r["query_id"]]].append((r["entry"], r["node_id"]))
            held = rows.sparkSession.sparkContext.broadcast((marks, [most.get(x, (0.0, 0.0)) for x in block.ids]))

            def work(parts: Iterator, ids: list = block.ids, held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                marks, most = held.value
                levels, names = [-np.array([e for e, _ in m]) for m in marks], [[n for _, n in m] for m in marks]
                counts = [np.zeros(len(m) + 1, np.int64) for m in marks]
                for nodes, sparse, dense in parts:
                    for j, (ms, md) in enumerate(most):
                        s, d = (sparse[:, j] / ms if ms > 0 else sparse[:, j] * 0), (dense[:, j] / md if md > 0 else dense[:, j] * 0)
                        e = np.round((s * sparse_weight + d * dense_weight) / total, DIGITS)
                        low, high = (np.searchsorted(levels[j], -e, side) for side in ("left", "right"))
                        for i in np.flatnonzero(low < high).tolist():
                            low[i] = bisect_right(names[j], nodes[i], low[i], high[i])
                        counts[j] += np.bincount(low, minlength=len(counts[j]))
                yield _batch([(ids[j], i, int(n)) for j, c in enumerate(counts) for i, n in enumerate(c[:-1].tolist())], schema)

            out.append(self._over(work, block, schema))
        met = _joined(out).groupBy("query_id", "i").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("query_id").orderBy("i")
        return rows.join(met, ["query_id", "i"]).select("query_id", "node_id", (F.sum("n").over(upto) + 1).alias("re"))
