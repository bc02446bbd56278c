"""Similarity join of documents by the Jaccard index of their word shingles, over R-trees of count vectors.

A document is the set of its hashed shingles. Its count vector has the number of its shingles in each group of hashes
(GROUPS groups at least, and one for each eight shingles, as larger groups of larger sets would bound nothing); two
sets have no more in common than the summed coordinate-wise minima of their vectors, the longer one folded. An R-tree of count
vectors holds the coordinate-wise maxima of each node, which bound all below it; pairs that pass are verified.

An R-tree of the whole corpus can't be dealt out: in so many dimensions the boxes of any partition meet nearly all
queries. So the sets are first brought together by the shingles that linked sets must share (the least ones of each,
in one order for all sets that puts frequent shingles last); a tree is built for each such cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_batch, documents, staged
from .components import components
from .suffixes import mixed

WORDS, SHARE = 5, 80
#: Least groups of the count vectors; points of a leaf and children of a node.
GROUPS, FAN = 64, 32
#: Shingles that are counted together; a shingle is frequent from this share of the documents on, and this many.
COUNTED, FREQUENT, LEAST = 2_000_000, 2_000, 30
#: Sets of a cell that one task holds: cells of more are dealt to pairs of parts.
CELL = 8_192
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ENTRY = np.dtype([("key", "<u8"), ("node", "<i8")])


class _Hashes(dict):
    """64-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return x


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of texts; words are hashed once."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.memo = words, _Hashes()

    def of(self, text: str) -> np.ndarray:
        """Bytes lower-cases A-Z and splits at the six white-space characters of ASCII, no more."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h, k = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<u8"), self.words
        with np.errstate(over="ignore"):
            if len(h) < k:
                out = np.array([len(h)], np.uint64)
                for x in h:
                    out = out * MULTIPLIER + x
                return mixed(out)
            out = h[: len(h) - k + 1]
            for i in range(1, k):
                out = out * MULTIPLIER + h[i : len(h) - k + 1 + i]
            return np.unique(mixed(out))


def groups_of(size: int) -> int:
    """Groups of a set of that size: a power of two, so that a vector can be folded to the half."""
    return max(GROUPS, 1 << (max(1, -(-size // 8)) - 1).bit_length())


def counts(shingles: np.ndarray) -> np.ndarray:
    """The count vector of a set."""
    g = groups_of(len(shingles))
    return np.bincount((shingles % np.uint64(g)).astype(np.int64), minlength=g).astype(np.uint32)


def needed(a, b, share: int = SHARE):  # noqa: ANN001, ANN201
    """The least overlap of linked sets of sizes a and b: 100 * i >= share * (a + b - i)."""
    return -(-share * (a + b) // (100 + share))


class CountTree:
    """A packed R-tree of count vectors of one length. Points are sorted by size, then in slabs by their widest
    coordinate; a node holds the maxima of its points' coordinates and their least size."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray) -> None:
        wide = int(vectors.astype(np.float64).var(0).argmax())
        slab = np.argsort(np.argsort(sizes, kind="stable")) // (FAN * FAN)
        self.order = np.lexsort((vectors[:, wide], slab))
        self.levels = [(vectors[self.order], sizes[self.order].astype(np.int64))]  # points first, the root's children last
        while len(self.levels[-1][0]) > FAN:
            top, least = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))

    def search(self, size: int, vector: np.ndarray, share: int = SHARE) -> np.ndarray:
        """Points (by their original index) whose overlap with the query can reach what is needed."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            at = at[size * 100 >= share * least[at]]
            at = at[np.minimum(top[at], vector).sum(1, dtype=np.int64) >= needed(size, least[at], share)]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


class Points:
    """Sets by size and count vector. Linked sets differ by less than two in size, so their vectors are of one length
    or one is to be folded once: for each length, the vectors of that length and folded ones of the next."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.sizes, self.length = sizes.astype(np.int64), np.array([len(v) for v in vectors])
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in np.unique(self.length).tolist():
            own, more = np.flatnonzero(self.length == g), np.flatnonzero(self.length == 2 * g)
            row = np.full(len(sizes), -1)
            row[own], row[more] = np.arange(len(own)), len(own) + np.arange(len(more))
            stack = [np.stack([vectors[i] for i in own])]
            if len(more):
                folded = np.stack([vectors[i] for i in more])
                stack.append(folded[:, :g] + folded[:, g:])
            self.rows[g] = np.concatenate(stack), row

    def possible(self, a: np.ndarray, b: np.ndarray, share: int = SHARE) -> np.ndarray:
        """Whether the bound leaves each pair."""
        out = np.zeros(len(a), bool)
        for g, (v, row) in self.rows.items():
            at = np.flatnonzero((np.minimum(self.length[a], self.length[b]) == g) & (row[a] >= 0) & (row[b] >= 0))
            for i in range(0, len(at), 20_000):
                k = at[i : i + 20_000]
                x, y = a[k], b[k]
                out[k] = np.minimum(v[row[x]], v[row[y]]).sum(1, dtype=np.int64) >= needed(self.sizes[x], self.sizes[y], share)
        return out

    def partners(self, members: np.ndarray, share: int = SHARE) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with those that the trees leave; a pair comes up with one of its two members at least."""
        for g in np.unique(self.length[members]).tolist():
            v, row = self.rows[g]
            inside = members[row[members] >= 0]
            tree = CountTree(self.sizes[inside], v[row[inside]])
            for i in inside[self.length[inside] == g].tolist():
                yield i, inside[tree.search(int(self.sizes[i]), v[row[i]], share)]


class Union:
    """Sets of numbered points, as labels that are rewritten for the smaller set."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: list[list[int]] = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(sets: list[np.ndarray], share: int = SHARE) -> np.ndarray:
    """Labels of the components that links make: pairs that the trees can't rule out are verified, unless they are in
    one component already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    union = Union(len(sets))
    for i, near in Points(sizes, [counts(s) for s in sets]).partners(np.arange(len(sets)), share):
        for j in near[union.label[near] != union.label[i]].tolist():
            if union.label[j] != union.label[i] and 100 * (o := overlap(sets[i], sets[j])) >= share * (sizes[i] + sizes[j] - o):
                union.join(i, j)
    return union.label


def node_of(s: np.ndarray) -> int | None:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0]) if len(s) else None


def signatures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of the same pass. doc_id, n_shingles, node (64 bits of a digest of the set; null: no shingles) and
    counts of each document; and how often tasks saw the shingles that are frequent among their documents."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        shingles, held, size, docs_held = Shingles(), [], 0, 0
        names = ("kind", "doc_id", "n", "node", "counts")

        def seen() -> dict:
            nonlocal size, docs_held
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = n >= max(3, docs_held // FREQUENT)
            held.clear()
            size = docs_held = 0
            k = int(often.sum())
            return dict(zip(names, ([1] * k, [None] * k, n[often].astype(np.int64), keys[often].view(np.int64), [None] * k), strict=True))

        for part in parts:
            rows: dict[str, list] = {n: [] for n in names}
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                s = shingles.of(text)
                for name, x in zip(names, (0, doc, len(s), node_of(s), counts(s).tobytes() if len(s) else None), strict=True):
                    rows[name].append(x)
                held.append(s)
                size, docs_held = size + len(s), docs_held + 1
            yield rows
            if size > COUNTED:
                yield seen()
        yield seen()

    table = staged(by_batch(documents(docs), "kind int, doc_id long, n long, node long, counts binary", work), "signatures")
    return table.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", "counts"), table.where("kind = 1").select(F.col("node").alias("shingle"), "n")


def _cells(docs: DataFrame, frequent, n_buckets: int, share: int) -> DataFrame:  # noqa: ANN001
    """Rows (bucket, blob): the least shingles of each set, so many that linked sets share one."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        shingles, hot = Shingles(), frequent.value
        held: list[np.ndarray] = []
        done: set[int] = set()
        size = 0

        def flush() -> dict:
            nonlocal size
            x = np.concatenate(held) if held else np.empty(0, ENTRY)
            held.clear()
            size = 0
            if not len(x):
                return {"bucket": [], "blob": []}
            bucket = (x["key"] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            x, bucket = x[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            return {"bucket": bucket[at], "blob": [x[a:b].tobytes() for a, b in zip(at, [*at[1:], len(x)], strict=True)]}

        for part in parts:
            for text in part["text"]:
                s = shingles.of(text)
                if not len(s):
                    continue
                node = int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])
                if node in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(node)
                k = len(s) - (share * len(s) + 99) // 100 + 1
                if len(hot):
                    at = np.searchsorted(hot, s)
                    at[at == len(hot)] = 0
                    often = hot[at] == s
                    first = np.concatenate([s[~often], s[often]])[:k]
                else:
                    first = s[:k]
                x = np.empty(k, ENTRY)
                x["key"], x["node"] = first, node
                held.append(x)
                size += k
            if size > 400_000:
                yield flush()
        yield flush()

    return by_batch(documents(docs).select("text"), "bucket long, blob binary", work)


def _shared(t):  # noqa: ANN001, ANN202
    """Bucket side: the sets that share a key, as packed sorted nodes."""
    x = np.frombuffer(b"".join(t["blob"].to_pylist()), ENTRY)
    x = x[np.lexsort((x["node"], x["key"]))]
    new = np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["node"][1:] != x["node"][:-1])]) if len(x) else np.empty(0, bool)
    x = x[new]
    at = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]])) if len(x) else np.empty(0, np.int64)
    ends = np.concatenate([at[1:], [len(x)]]) if len(x) else at
    node = np.ascontiguousarray(x["node"])
    out: set[bytes] = set()
    for a, b in zip(at[ends - at > 1].tolist(), ends[ends - at > 1].tolist(), strict=True):
        m = node[a:b]
        if len(m) <= CELL:
            out.add(m.tobytes())
        else:
            parts = [m[i : i + CELL // 2] for i in range(0, len(m), CELL // 2)]
            out |= {np.sort(np.concatenate([p, q])).tobytes() for i, p in enumerate(parts) for q in parts[i + 1 :]}
    return pa.table([pa.array(sorted(out), pa.binary())], names=["nodes"])


def _bounded(share: int):  # noqa: ANN202
    """Cells with the sets' sizes and count vectors: forests of the pairs that the bound leaves."""

    def run(t):  # noqa: ANN001, ANN202
        node, where = np.unique(t["node"].to_numpy(), return_inverse=True)
        first = np.unique(where, return_index=True)[1]
        points = Points(t["n_shingles"].to_numpy()[first], [np.frombuffer(v, "<u4") for v in t["counts"].take(pa.array(first)).to_pylist()])
        cell = np.unique(t["cell"].to_numpy(), return_inverse=True)[1]
        order = np.lexsort((where, cell))
        cell, where = cell[order], where[order]
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        length = np.diff(np.append(at, len(cell)))
        union = Union(len(node))
        for k in range(2, 9):  # small cells of one length at once
            own = at[length == k]
            if len(own):
                m = where[own[:, None] + np.arange(k)]
                i, j = np.triu_indices(k, 1)
                pairs = np.unique(np.stack([m[:, i].ravel(), m[:, j].ravel()], axis=1), axis=0)
                ok = points.possible(pairs[:, 0], pairs[:, 1], share)
                for x, y in pairs[ok].tolist():
                    union.join(x, y)
        for a, n in zip(at[length > 8].tolist(), length[length > 8].tolist(), strict=True):
            m = where[a : a + n]
            if (union.label[m] == union.label[m[0]]).all():
                continue
            for x, near in points.partners(m, share):
                for y in near[union.label[near] != union.label[x]].tolist():
                    union.join(x, y)
        root = node[union.label]
        ok = root != node
        return pa.table([pa.array(node[ok]), pa.array(root[ok])], names=["a", "b"])

    return run


def _verified(share: int):  # noqa: ANN202
    """Cells of sets that may be linked, with a text for each: each set's label in the cell."""

    def run(t):  # noqa: ANN001, ANN202
        shingles = Shingles()
        cells: dict[int, dict[int, np.ndarray]] = {}
        for cell, node, text in zip(*(t[c].to_pylist() for c in ("cell", "node", "text")), strict=True):
            s = shingles.of(text)
            if len(s) and node_of(s) == node:
                cells.setdefault(cell, {})[node] = s
        a, b = [], []
        for _, members in sorted(cells.items()):
            node = np.array(sorted(members))
            label = linked([members[i] for i in node.tolist()], share)
            root = node[label]
            a += node[root != node].tolist()
            b += root[root != node].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _node_column():  # noqa: ANN202
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def node(texts):  # noqa: ANN001, ANN202
        shingles = Shingles()
        return pd.Series([None if t is None else node_of(shingles.of(t)) for t in texts], dtype="Int64")

    return node("text")


def similar(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: the smallest doc_id that links lead to. Documents link if
    the Jaccard index of their sets of WORDS-word shingles is share per cent or more.

    A text with fewer words is one shingle; null texts and those without words have none and are alone. Copies have
    the same set and are worked on once. Rows that repeat give a row each; a null doc_id is no component's smallest
    unless it is alone. An empty table gives no rows; other columns are not read.

    Sets are known by 64 bits of a digest and shingles by 64-bit hashes. The frequent shingles are broadcast; there
    are FREQUENT times the mean set at most, as each stands in one of FREQUENT documents or more."""
    return _similar(docs, share).drop("node")


def _similar(docs: DataFrame, share: int) -> DataFrame:
    """What similar returns, and the node of each document."""
    spark = docs.sparkSession
    sets, often = signatures(docs)
    rows = sets.count()
    n_buckets = blocks(spark, rows, 1_000)
    least = max(LEAST, rows // FREQUENT)
    hot = often.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("shingle").toArrow()["shingle"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"))
    nodes = staged(nodes, "nodes")
    lists = _cells(docs, frequent, n_buckets, share).groupBy("bucket").applyInArrow(_shared, "nodes binary").groupBy("nodes").agg(F.count("*").alias("c"))
    members = lists.select(F.xxhash64("nodes").alias("cell"), "nodes").mapInArrow(_unpacked, "cell long, node long")
    inside = members.join(nodes.select("node", "n_shingles", "counts"), "node").withColumn("bucket", F.pmod("cell", F.lit(n_buckets)))
    near = inside.groupBy("bucket").applyInArrow(_bounded(share), "a long, b long")
    groups = staged(components(near), "candidates")
    big = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    big = staged(big.withColumn("parts", F.ceil(F.col("n") / (CELL // 2)).cast("int")).select("component", "parts"), "big")
    placed = groups.join(big, "component", "left").withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    pair = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda i: F.xxhash64("component", F.least(i, F.coalesce("own", F.lit(0))), F.greatest(i, F.coalesce("own", F.lit(0)))))
    placed = placed.select("node", F.explode(pair).alias("cell"))
    known = placed.join(nodes.select("node", "least"), "node").select(F.col("least").alias("doc_id"), "node", "cell")
    texts = documents(docs).join(known, "doc_id").select("node", "cell", "text")
    if nodes.where("least IS NULL").limit(1).count():  # sets of rows without doc_id only: their texts are found by the set
        unnamed = documents(docs).where("doc_id IS NULL").select("text", _node_column().alias("node")).groupBy("node").agg(F.min("text").alias("text"))
        texts = texts.unionByName(known.where("doc_id IS NULL").drop("doc_id").join(unnamed, "node").select("node", "cell", "text"))
    texts = texts.withColumn("bucket", F.pmod("cell", F.lit(blocks(spark, rows, 500))))
    links = texts.groupBy("bucket").applyInArrow(_verified(share), "a long, b long")
    links = staged(links, "verified")
    found = components(links) if big.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    owned = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    final = owned.join(smallest, "component").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells, lists = b["cell"].to_numpy(), b["nodes"].to_pylist()
        for i in range(0, len(lists), 1_000):
            nodes = [np.frombuffer(x, "<i8") for x in lists[i : i + 1_000]]
            flat = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(np.repeat(cells[i : i + 1_000], [len(x) for x in nodes])), pa.array(flat)], names=["cell", "node"])


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all columns. Of rows that share doc_id and
    text one stays. Rows without doc_id go if a document with one is linked to them, and stay otherwise."""
    found = _similar(docs, share)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    named = docs.join(kept, docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    unnamed = docs.where(F.col("doc_id").cast("long").isNull())
    if not unnamed.limit(1).count():
        return named
    gone = found.where("doc_id IS NULL AND component_id IS NOT NULL").select(F.col("node").alias("gone_node")).distinct()
    own = "own" + "_" * max(map(len, docs.columns))  # no column of docs has such a name
    unnamed = unnamed.withColumn(own, _node_column())
    return named.unionByName(unnamed.join(gone, unnamed[own] == gone["gone_node"], "left_anti").drop(own))
