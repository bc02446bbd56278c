"""Compression of vectors to codes: a codebook for each part of a vector, trained by Lloyd's rule over distinct parts.

Vectors are cut into equal parts of integers. Equal parts of a position become one row with a weight, so training and the
last assignment work on distinct parts only; codes and errors are then joined back to the vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, staged

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Up to here float64 holds every whole number, so sums of squares below it are exact.
EXACT = 2**53
#: Codebooks by number of dimensions, then position: (entries, components of a part).
Books = dict[int, list[np.ndarray]]


def whole_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """row (a number of its own), vec_id, label, dims and vec, the integers floor(scale * x), of the vectors that take part."""
    x = F.col("embedding")
    ok = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding")).where(ok)
    return found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("embedding").alias("dims"), F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def _value(part: np.ndarray) -> bytes:
    """The integers of a part in the fewest bytes that hold each of them: equal parts have equal values."""
    top = max(int(part.max()), -int(part.min()) - 1)
    return part.astype(next(k for k in ("<i1", "<i2", "<i4", "<i8") if top <= np.iinfo(k).max)).tobytes()


def _components(values: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i] = np.frombuffer(v, f"<i{len(v) // width}")
    return out


def cut(found: DataFrame, parts: int) -> DataFrame:
    """row, dims, part, value for each part of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, dims = b.column("row").to_numpy(), b.column("dims").to_numpy()
            flat, ends = b.column("vec").flatten().to_numpy(), np.cumsum(dims)
            values = [_value(p) for e, d in zip(ends, dims, strict=True) for p in flat[e - d : e].reshape(parts, -1)]
            columns = [pa.array(np.repeat(rows, parts)), pa.array(np.repeat(dims, parts)), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(rows))), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "dims", "part", "value"])

    return found.select("row", "dims", "vec").mapInArrow(work, "row long, dims int, part int, value binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, the lower one of equals, and the squared distance, both exact."""
    most = int(max(abs(int(x.min())), abs(int(x.max())), abs(int(book.min())), abs(int(book.max()))))
    if 4 * x.shape[1] * most * most < EXACT:
        a, c = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:  # Python's integers
        d = np.stack([((x.astype(object) - e) ** 2).sum(1) for e in book.astype(object)], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _by_part(b: pa.RecordBatch, parts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a batch of distinct parts: dims, position, and the rows' indexes."""
    dims, part = b.column("dims").to_numpy(), b.column("part").to_numpy()
    for d in np.unique(dims):
        for p in range(parts):
            at = np.flatnonzero((dims == d) & (part == p))
            if len(at):
                yield int(d), p, at


def _seeds(found: DataFrame, entries: int, parts: int) -> Books:
    """The parts of the vectors with the least vec_ids, for each number of dimensions."""
    books: Books = {}
    for (dims,) in found.select("dims").distinct().collect():
        least = found.where(F.col("dims") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
        books[dims] = list(np.array([r["vec"] for r in least], np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2))
    return books


def _trained(distinct: DataFrame, books: Books, parts: int) -> Books:
    """One round of Lloyd's rule over the distinct parts and their weights. A task sends one row for each entry."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list[int]] = {}
        for b in batches:
            values, weights = b.column("value"), b.column("weight").to_numpy()
            for d, p, at in _by_part(b, parts):
                x, w = _components(values.take(pa.array(at)).to_pylist(), d // parts), weights[at]
                code, _ = nearest(x, held.value[d][p])
                safe = int(np.abs(x).max()) * int(w.sum()) < 2**62
                weighed = np.c_[x * w[:, None], w] if safe else np.c_[x.astype(object) * w[:, None], w]
                for k in np.unique(code):
                    add = weighed[code == k].sum(0).tolist()
                    old = sums.get((d, p, int(k)), [0] * len(add))
                    sums[d, p, int(k)] = [u + v for u, v in zip(old, add, strict=True)]
        keys = list(zip(*sums, strict=True)) if sums else [()] * 3
        columns = [pa.array(k, pa.int32()) for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["dims", "part", "entry", "sums"])

    found = distinct.mapInArrow(work, "dims int, part int, entry int, sums array<long>")
    cells = found.select("dims", "part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("dims", "part", "entry", "at").agg(F.sum("v").alias("v"))
    out, sums = {d: [p.copy() for p in b] for d, b in books.items()}, {}
    for r in cells.collect():  # a row for each component of the codebooks, and each weight
        sums.setdefault((r["dims"], r["part"], r["entry"]), {})[r["at"]] = r["v"]
    for (d, p, k), x in sums.items():
        n = x[d // parts]
        out[d][p][k] = [x[i] // n for i in range(d // parts)]
    return out


def _coded(distinct: DataFrame, books: Books, parts: int) -> DataFrame:
    """The distinct parts with the index of their entry and their squared distance from it."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, object)
            for d, p, at in _by_part(b, parts):
                code, error = nearest(_components(b.column("value").take(pa.array(at)).to_pylist(), d // parts), held.value[d][p])
                codes[at], errors[at] = code, [int(e) for e in error]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes), pa.array(errors.tolist(), pa.int64())], names=[*b.schema.names, "code", "error"])

    return distinct.mapInArrow(work, "dims int, part int, value binary, weight long, code int, error long")


def books_digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


class Codec:
    """Codebooks fitted on a table of vectors, and the codes of that table."""

    def __init__(self, vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> None:
        self.scale, self.parts = scale, parts
        self.vectors = staged(whole_vectors(vectors, scale, parts), "vectors")  # row numbers stay as written
        self.cuts = staged(cut(self.vectors, parts), "parts")
        distinct = staged(self.cuts.groupBy("dims", "part", "value").agg(F.count("*").alias("weight")), "distinct")
        self.books = _seeds(self.vectors, entries, parts)
        for _ in range(rounds):
            self.books = _trained(distinct, self.books, parts)
        self.distinct = staged(_coded(distinct, self.books, parts), "coded")

    def coded(self) -> DataFrame:
        """row, vec_id, label, dims, codes (an index for each part) and error of each vector."""
        met = joined(self.cuts, self.distinct, ["dims", "part", "value"], "weight")
        whole = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "code"))).alias("codes"), F.sum("error").alias("error"))
        return self.vectors.select("row", "vec_id", "label", "dims").join(whole.select("row", F.col("codes")["code"].alias("codes"), "error"), "row")

    def decoded(self, coded: DataFrame) -> DataFrame:
        """coded with embedding, the middles of the cells that the entries of its codes stand for."""
        held, scale = coded.sparkSession.sparkContext.broadcast(self.books), self.scale

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [np.concatenate([held.value[d][p][k] for p, k in enumerate(c)]) for d, c in zip(b.column("dims").to_pylist(), b.column("codes").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([((v + 0.5) / scale).tolist() for v in x], pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

        return coded.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema) + ", embedding array<double>")


def _digest_of(books: Books) -> Column:
    pairs = [F.lit(x) for d, b in sorted(books.items()) for x in (d, books_digest(b))]
    return F.create_map(*pairs)[F.col("dims")] if pairs else F.lit(None).cast("string")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each vector (vec_id, embedding, label; others are not
    read).

    Left out: vectors that are null, empty, or hold a null, NaN or infinite component, and those that can't be cut into
    PARTS equal parts. Vectors of different numbers of dimensions have codebooks of their own. Rows without vec_id take
    part and stand last among those that a codebook begins with; of rows that share a vec_id, the smaller vector stands
    first. With under 64 vectors the codebooks have as many entries; an entry that no part is nearest to stays. No vectors
    give no rows. A component beyond the longs counts as the last one; a sum of squares that no long holds fails the job.

    The codebooks (64 times the dimensions) are all that the driver sees."""
    codec = Codec(vectors)
    coded = staged(codec.coded(), "codes").withColumns({"named": F.col("label").isNotNull(), "of": F.coalesce("label", F.lit(0))})
    labels = staged(coded.groupBy("named", "of").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    out = joined(coded, labels, ["named", "of"], "n")
    code = F.concat_ws("", F.transform("codes", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))))
    return out.select("vec_id", code.alias("code"), "error", "label_error", _digest_of(codec.books).alias("codebooks_sha256"))
