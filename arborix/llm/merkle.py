"""Merkle manifest of a dataset: a digest for each row, a tree for each source, and a tree over the sources.

Leaves are numbered within their source by one sort over ranges. FANOUT ** LEVELS consecutive leaves are an aligned block,
whose digests lie in one contiguous matrix of numpy; a level is hashed row by row of the matrix reshaped by the fanout, and
the siblings of a node are its row's other digests, found by its index alone. The blocks' nodes are the leaves of the
next, smaller round; the paths of the blocks then come down again, round by round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, staged

FANOUT, LEVELS, HEX = 16, 3, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block as one row: its ids, the digests of its leaves end to end, tampered ones (blanks where there is none), its node.
PACKED = "tree string, block long, ids array<long>, leaves binary, tampered binary, node string"
#: What comes down to a node: its tree's root, and what stands before and after it and each node above it, in turn.
PATHS = "tree string, pos long, subroot string, path array<string>"


def _item(c: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(_item(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _item(text)), 256)


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """id (doc_id), tree (source), leaf, and tampered: the leaf of the tampered row, null for rows left as they are."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    hit = F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), every) == 0)
    return found.select(F.col("doc_id").alias("id"), F.col("source").alias("tree"), _leaf(F.col("text")).alias("leaf"), F.when(hit, _leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with pos, their place within their tree by order, from 0. Rows are sorted over ranges, so a tree
    can fill many of them; what stands before a range is the sum of its tree's rows in earlier ranges. That sum is
    needed for the first tree of a range only, so the table of sums has a row for each range at most."""
    kept = nodes.columns
    fixed = staged(nodes.withColumn("turn", F.monotonically_increasing_id()), "nodes")  # tells equal rows apart
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "turn")]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = fixed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*kept, F.spark_partition_id().alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, first = None, -1, True
        for b in batches:
            places, firsts = [], []
            for tree in b.column("tree").to_pylist():
                if at >= 0 and tree == last:
                    at += 1
                else:
                    first, last, at = at < 0, tree, 0
                places.append(at)
                firsts.append(first)
            columns = [*b.columns, pa.array(places, pa.int64()), pa.array(firsts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "at", "first"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    placed = staged(ranged.mapInArrow(count, f"{fields}, at long, first boolean"), "numbered")
    sizes = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.withColumn("before", before).where("first AND before > 0").select("part", "first", "before")
    return placed.join(F.broadcast(carried), ["part", "first"], "left").select(*kept, (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"))


def hashed(row: bytes) -> bytes:
    return hashlib.sha256(row).hexdigest().encode()


def levels(flat: bytes, up: int) -> list[np.ndarray]:
    """The levels of a block, each a matrix of HEX bytes a node, from its leaves to the nodes ``up`` levels above."""
    found = [np.frombuffer(flat, np.uint8).reshape(-1, HEX)]
    for _ in range(up):
        below = found[-1]
        whole = len(below) // FANOUT * FANOUT
        runs = [*below[:whole].reshape(-1, FANOUT * HEX), *([below[whole:].ravel()] if whole < len(below) else [])]
        found.append(np.frombuffer(b"".join(hashed(r.tobytes()) for r in runs), np.uint8).reshape(-1, HEX))
    return found


def height(n: int, block: int, most: int = LEVELS) -> int:
    """Levels above the leaves of a block of n: most, unless it is the only one of its tree, which ends at one node."""
    return next(k for k in range(most + 1) if k == most or (block == 0 and FANOUT**k >= n))


def siblings(found: list[bytes], at: int) -> list[bytes]:
    """What stands before and after the node over leaf ``at`` on each level but the top one."""
    out = []
    for flat in found[:-1]:
        run, here = at // FANOUT * FANOUT * HEX, at * HEX
        out += [flat[run:here], flat[here + HEX : run + FANOUT * HEX]]
        at //= FANOUT
    return out


def fold(node: bytes, path: list[bytes]) -> bytes:
    for before, after in zip(path[::2], path[1::2], strict=True):
        node = hashed(before + node + after)
    return node


def _packed(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, id, leaf, tampered), a row for each block."""
    most = LEVELS

    def work(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        flat = lambda c: "".join(x or " " * HEX for x in t[c].to_pylist()).encode()
        leaf, block = flat("leaf"), keys[1].as_py()
        node = levels(leaf, height(t.num_rows, block, most))[-1].tobytes().decode()
        columns = [pa.array([keys[0].as_py()], pa.string()), pa.array([block], pa.int64()), pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), pa.array([leaf]), pa.array([flat("tampered")]), pa.array([node])]
        return pa.table(columns, names=["tree", "block", "ids", "leaves", "tampered", "node"])

    dealt = nodes.select("tree", F.floor(F.col("pos") / FANOUT**most).alias("block"), "pos", "id", "leaf", "tampered")
    return staged(dealt.groupBy("tree", "block").applyInArrow(work, PACKED), "blocks")


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round; in the last one each tree has one block, whose node is its root."""
    rounds = [_packed(nodes)]
    while not rounds[-1].where("block > 0").isEmpty():
        above = F.lit(None)
        rounds.append(_packed(rounds[-1].select("tree", F.col("block").alias("pos"), above.cast("long").alias("id"), F.col("node").alias("leaf"), above.cast("string").alias("tampered"))))
    return rounds


def _met(packed: DataFrame, paths: DataFrame) -> DataFrame:
    """Each block with the path of its node; a null tree is a tree as well."""
    p = paths.select(F.col("tree").alias("of"), F.col("pos").alias("at"), "subroot", "path")
    return packed.join(p, packed["tree"].eqNullSafe(p["of"]) & (packed["block"] == p["at"])).drop("of", "at")


def _each_block(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict, list[list[bytes]]]]:
    """Each block that met its path, with the whole paths of its leaves."""
    for b in batches:
        for i in range(b.num_rows):
            row = {name: c[i].as_py() for name, c in zip(b.schema.names, b.columns, strict=True)}
            n, above = len(row["leaves"]) // HEX, [x.encode() for x in row["path"]]
            found = [x.tobytes() for x in levels(row["leaves"], height(n, row["block"], most))]
            yield row, [siblings(found, k) + above for k in range(n)]


def _down(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the first round's blocks, from those of the trees' roots."""
    most = LEVELS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, each in _each_block(batches, most):
            n = len(each)
            places = [row["block"] * FANOUT**most + k for k in range(n)]
            columns = [pa.array([row["tree"]] * n, pa.string()), pa.array(places, pa.int64()), pa.array([row["subroot"]] * n), pa.array([[x.decode() for x in p] for p in each], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "subroot", "path"])

    for packed in reversed(rounds[1:]):
        paths = staged(_met(packed, paths).mapInArrow(work, PATHS), "paths")
    return paths


def _opened(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents' blocks with the paths of their nodes to the root, and the root."""
    rounds = _climbed(numbered(leaves(docs), ["id", "leaf"]))
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("node").alias("leaf"))
    tops = staged(numbered(tops, ["source"]), "subroots")
    above = _climbed(tops.select("tree", "pos", F.lit(None).cast("long").alias("id"), "leaf", F.lit(None).cast("string").alias("tampered")))
    root = next((r["node"] for r in above[-1].select("node").take(1)), "")
    start = above[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), F.array().cast("array<string>").alias("path"))
    of_sources = _down([tops, *above], start).select("pos", "path")
    paths = tops.join(of_sources, "pos").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("leaf").alias("subroot"), "path")
    return _met(rounds[0], _down(rounds, paths)), root


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path, the digests before and after each node from the leaf to the root:
    two strings a level. ``fold`` takes a leaf up its path."""
    most, (met, root) = LEVELS, _opened(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, each in _each_block(batches, most):
            n = len(each)
            leaf = [row["leaves"][k : k + HEX].decode() for k in range(0, n * HEX, HEX)]
            columns = [pa.array(row["ids"], pa.int64()), pa.array([row["tree"]] * n, pa.string()), pa.array(leaf), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array([[x.decode() for x in p] for p in each], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "leaf", "subroot", "root", "path"])

    return met.mapInArrow(work, "doc_id long, source string, leaf string, subroot string, root string, path array<string>")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs (doc_id, source, lang, n_chars,
    text; others are not read).

    Nulls are part of a leaf. Within a source, leaves go by doc_id (null first), those that share one by their digest;
    equal rows are equal leaves, each with a place of its own. A source of one row is its own subroot; the proof of the only
    row of the only source is the digest of nothing. A row without doc_id is never tampered with. An empty table gives no
    rows. One digest, the root, comes to the driver."""
    most, (met, root) = LEVELS, _opened(docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, each in _each_block(batches, most):
            leaf, proof, folded = [], [], []
            for k, path in enumerate(each):
                own, other = (row[c][k * HEX : (k + 1) * HEX] for c in ("leaves", "tampered"))
                leaf.append(own.decode())
                proof.append(hashed(b"".join(path)).decode())
                folded.append(fold(own if other.isspace() else other, path).decode())
            n = len(each)
            columns = [pa.array(row["ids"], pa.int64()), pa.array(leaf), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(work, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
