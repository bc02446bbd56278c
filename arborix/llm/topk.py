"""Exact top-k search by inner product.

Candidates lie in blocks of descending length; a cell is a row of CELL_BLOCKS such blocks. Queries lie in blocks too. The
block of the longest vectors gives each query a floor, its k-th best score there. A query then goes only to the cells
whose longest vector could still reach its floor, and a cell's blocks only to the query blocks that come there: pairs are
pruned by length before anything is moved. Inside, sums over rotated leading dimensions and residual lengths prune."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K, SCALE = 10, 1024
#: Vectors of a block of candidates, and of a block of queries; blocks of a cell; ranges of length.
BLOCK, QUERY_BLOCK, CELL_BLOCKS, RANGES = 8_192, 4_096, 8, 64
#: Candidates that one step of a block works on: steps go by descending length, so a step can end the block.
STEP = 1_024
#: Exact sums of float64 end here.
EXACT = float(2**53)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (floor(scale * x) of each component, as double) and norm2; vectors that are null, empty or hold a
    null or non-finite component (or one that no double holds once it is scaled) are left out. From 2 ** 53 on all doubles are whole."""
    x = F.col("embedding")
    scaled = lambda v: v.cast("double") * scale
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(scaled(v)) < float("inf")))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull()).where(ok)
    found = found.select("vec_id", F.transform("embedding", lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("vec"))
    return found.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).withColumn("dims", F.size("vec"))


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the right singular vectors of all vectors, from their summed outer products:
    a task sends one d x d matrix, and the driver decomposes the sum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            flat, ends = b.column("vec").flatten().to_numpy(), np.cumsum(b.column("dims").to_numpy())
            for d in np.unique(b.column("dims").to_numpy()):
                at = ends[b.column("dims").to_numpy() == d]
                x = flat[(at[:, None] - d) + np.arange(d)]
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["dims", "m"])

    parts = vectors.select("vec", "dims").mapInArrow(work, "dims int, m array<double>")
    cells = parts.select("dims", F.posexplode("m").alias("at", "m")).groupBy("dims", "at").agg(F.sum("m").alias("m"))
    sums: dict[int, np.ndarray] = {}
    for d, at, m in cells.collect():
        sums.setdefault(d, np.zeros(d * d))[at] = m
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in sums.items()}


def _packed(df: DataFrame) -> DataFrame:
    """A row for each block: ids and components as bytes, by descending length, then vec_id."""

    def work(keys, t):  # noqa: ANN001, ANN202
        order = np.lexsort((t["vec_id"].to_numpy(), -t["norm2"].to_numpy()))
        d = t["dims"][0].as_py()
        x = t["vec"].combine_chunks().flatten().to_numpy().reshape(-1, d)[order]
        return pa.table([[keys[0]], pa.array([d], pa.int32()), [t["vec_id"].to_numpy()[order].tobytes()], [x.tobytes()]], names=["block", "dims", "ids", "data"])

    return df.select("block", "dims", "vec_id", "norm2", "vec").groupBy("block").applyInArrow(work, "block long, dims int, ids binary, data binary")


class Best:
    """The k best candidates of each query, from its floor on."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, floors: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.qids, self.q, self.floors, self.turn, self.k = qids, q, floors, turn, k
        self.level = floors.astype(np.float64)
        self.found: list[list[tuple[float, int]]] = [[] for _ in qids]
        self.length, self.lead = np.sqrt((q * q).sum(1)), max(1, q.shape[1] // 4)
        turned = q @ turn
        self.head, self.rest = turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        """One block, by descending length. Each step rotates the vectors, sums the leading dimensions, and bounds the rest by
        the product of the residual lengths (Cauchy-Schwarz); only pairs whose bound reaches the query's k-th best score
        so far are summed exactly. A query leaves once its length times the next one can't reach that."""
        length = np.sqrt((x * x).sum(1))
        exact = length.max(initial=0) * self.length.max(initial=0) < EXACT
        for a in range(0, len(ids), STEP):
            live = np.flatnonzero(self.length * length[a] * (1 + 1e-9) + 1 >= self.level)
            if not len(live):
                break
            part, pid = x[a : a + STEP], ids[a : a + STEP]
            y = part @ self.turn
            rest = np.sqrt((y[:, self.lead :] ** 2).sum(1))
            bound = self.head[live] @ y[:, : self.lead].T
            bound += self.rest[live, None] * rest
            bound += 1 + 1e-9 * self.length[live, None] * length[a]
            near = bound >= self.level[live, None]
            near &= pid[None, :] != self.qids[live, None]
            for i in np.flatnonzero(near.any(1)):
                row, c = live[i], np.flatnonzero(near[i])
                if exact:
                    score = part[c] @ self.q[row]
                    if len(c) > self.k:  # those below the k-th best of this step alone can't stay
                        top = score >= np.partition(score, len(c) - self.k)[len(c) - self.k]
                        c, score = c[top], score[top]
                    score = score.tolist()
                else:
                    score = [sum(int(u) * int(v) for u, v in zip(part[j], self.q[row], strict=True)) for j in c]
                merged = sorted(self.found[row] + [(-s, int(pid[j])) for s, j in zip(score, c, strict=True) if s >= self.floors[row]])[: self.k]
                self.found[row] = merged
                if len(merged) == self.k:
                    self.level[row] = max(self.level[row], float(-merged[-1][0]))

    def rows(self) -> pa.Table:
        out = [(int(self.qids[i]), v, int(-s)) for i, b in enumerate(self.found) for s, v in b]
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _search(blocks: DataFrame, queries: DataFrame, turns, k: int) -> DataFrame:  # noqa: ANN001
    """blocks(qblock, cell, block, dims, ids, data) against queries(qblock, cell, vec_id, vec, floor), cell by cell."""

    def work(b, q):  # noqa: ANN001, ANN202
        if not b.num_rows or not q.num_rows:
            return Best(np.empty(0), np.empty((0, 1)), np.empty(0), np.eye(1), k).rows()
        d = b["dims"][0].as_py()
        best = Best(q["vec_id"].to_numpy(), q["vec"].combine_chunks().flatten().to_numpy().reshape(-1, d), q["floor"].to_numpy(), turns.value[d], k)
        for i in np.argsort(b["block"].to_numpy()).tolist():
            best.search(np.frombuffer(b["ids"][i].as_py(), np.int64), np.frombuffer(b["data"][i].as_py(), np.float64).reshape(-1, d))
        return best.rows()

    keys = ("qblock", "cell")
    left, right = blocks.select(*keys, "block", "dims", "ids", "data"), queries.select(*keys, "vec_id", "vec", "floor")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: Spark keeps k rows of a query in each task before it shuffles them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _placed(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """rows with their block, numbered by descending length (within one number of dimensions), and for each number of
    dimensions its levels: (top: greatest length, last: the last cell), longest first. A level is a range of lengths; there
    are RANGES for each number of dimensions, whatever the size of the table, and as many blocks in each as it needs.

    A row's block follows from its values alone, so a task that is run again deals its rows as before, whatever their
    order: the cuts of lengths are fixed first (an approximate percentile depends on the order in which it meets rows), and
    rows that are equal in id and vector are counted, and stand k times at most, as no query can show more of them."""
    spark = rows.sparkSession
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = rows.groupBy("dims").agg(F.percentile_approx("norm2", shares, F.lit(10_000)).alias("cuts"))
    cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
    placed = rows.join(cuts, "dims").withColumn("level", F.size(F.filter(F.array_distinct("cuts"), lambda c: F.col("norm2") < c))).drop("cuts")
    found = placed.groupBy("dims", "level").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).orderBy("dims", "level").collect()
    sizes, levels, at = [], {}, 0
    for r in found:
        if r["dims"] not in levels and at % CELL_BLOCKS:
            at += CELL_BLOCKS - at % CELL_BLOCKS  # cells of one number of dimensions only
        parts = -(-r["n"] // BLOCK)
        levels.setdefault(r["dims"], (at // CELL_BLOCKS, []))[1].append((r["top"] ** 0.5, (at + parts - 1) // CELL_BLOCKS))
        sizes.append((r["dims"], r["level"], at, parts))
        at += parts
    number = spark.createDataFrame(sizes, "dims int, level int, first long, parts long")
    table = spark.createDataFrame([(d, first, x) for d, (first, x) in levels.items()], "dims int, first_cell long, levels array<struct<top:double,last:long>>")
    # Equal lengths can fill many blocks, and one id many rows: a hash of the row's values, and of which copy it is, deals them out.
    copies = placed.groupBy("dims", "level", "vec_id", "norm2", "vec").agg(F.count("*").alias("n"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long")))))
    part = F.pmod(F.xxhash64("vec_id", "vec", "copy"), F.col("parts"))
    return copies.join(F.broadcast(number), ["dims", "level"]).withColumn("block", F.col("first") + part).drop("first", "parts", "level", "n", "copy"), table


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the greatest integer inner product with each query (a vector
    whose id is divisible by every), itself left out; equal scores go by vec_id.

    Null vectors, empty ones and those with a null, NaN or infinite component take no part; nor do rows without id.
    A query is held against vectors of as many dimensions only. Of rows that share an id, each is a candidate; a query
    skips all rows of its own id, and rows of a query that repeat count once (the longest). No vectors or no queries
    give no rows; other columns are not read. A score among the best that no long holds fails the job.

    No step depends on the order of rows, so the input may come out of a shuffle. Two tables come to the driver: RANGES
    numbers, and one matrix, for each number of dimensions."""
    spark = vectors.sparkSession
    found = whole_vectors(vectors, scale)
    turns = spark.sparkContext.broadcast(rotation(found))
    keyed, levels = _placed(found, k)
    blocks = staged(_packed(keyed), "candidates").withColumn("cell", F.floor(F.col("block") / CELL_BLOCKS))
    asked = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("norm2", "vec", "dims")).alias("x")).select("vec_id", "x.*")
    n_asked = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.join(F.broadcast(levels), "dims").withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(n_asked)))
    # The first block of the first cell holds some of the longest vectors: each query's floor.
    head = asked.withColumns({"cell": F.col("first_cell"), "floor": F.lit(-float("inf"))})
    every_q = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))).alias("qblock")
    first_block = F.broadcast(levels.select((F.col("first_cell") * CELL_BLOCKS).alias("block")))
    first = _best(_search(blocks.join(first_block, "block").select(every_q, "cell", "block", "dims", "ids", "data"), head, turns, k), k)
    first = staged(first.select("query_id", "rank", "vec_id", "score"), "head")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reached"))
    raised = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("reached", F.lit(-float("inf"))))
    last = F.array_max(F.transform(F.filter("levels", lambda x: F.sqrt("norm2") * x["top"] * (1 + 1e-9) + 1 >= F.col("floor")), lambda x: x["last"]))
    raised = raised.withColumn("last", last).where(F.col("last").isNotNull())
    reach = raised.groupBy("dims", "qblock").agg(F.max("last").alias("last"))
    there = blocks.select("block", "cell", "dims").join(reach, "dims").where(F.col("cell") <= F.col("last")).groupBy("block").agg(F.collect_list("qblock").alias("qblocks"))
    rest = blocks.join(first_block, "block", "left_anti").join(there, "block").select(F.explode("qblocks").alias("qblock"), "cell", "block", "dims", "ids", "data")
    asking = raised.select("qblock", F.explode(F.sequence("first_cell", "last")).alias("cell"), "vec_id", "vec", "floor")
    out = first.select("query_id", "vec_id", "score").unionByName(_search(rest, asking, turns, k))
    return _best(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
