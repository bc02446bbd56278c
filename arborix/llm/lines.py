"""Line dedup: lines that stand in many documents are dropped, but for the last document that holds them.

A line's key is known by a digest of 128 bits. Filters over all lines of a large corpus fit into no task, so they are cut
by the digest into shards of a bounded size, and digests, not lines, travel to their shard. There two Bloom filters, of
what was seen once and of what was seen again, tell the suspects; only those are shuffled by key, for the exact count of
their documents and the choice of the one that keeps them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_batch, joined, staged

#: Code points that a key needs, and documents that must hold it.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
WHITE = b" \t\n\x0b\x0c\r"
#: Digests that a task gathers before it looks for repeats among them; digests of a shard.
PACK, SHARD = 1 << 18, 1 << 18
#: Bits of a filter for each digest, and hashes of a digest: at most about one digest in 400 is suspected wrongly.
BITS, HASHES = 16, 4
#: Stands for a null doc_id: such rows count as one document, which comes before all others.
NO_ID = -(2**63)


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased; None if it has under least code points."""
    k = line.strip(WHITE)
    if len(k) < least or len(k) < 4 * least and len(k.decode()) < least:
        return None
    return k.lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _place() -> list:
    """What a row is looked up by: its doc_id and a hash of its text. Rows that share both share what they lose."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_place(), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _held(texts: DataFrame, least: int) -> DataFrame:
    """digest, doc, hash for each key of each row. Of the rows of one digest that a pack of a task holds, the first has
    late = false (and many, if there are others), so a line of all documents sends a row for each pack to its shard."""
    size = PACK

    def pack(digests: list, docs: list, hashes: list) -> dict:
        flat = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        same = np.r_[False, (flat[order[1:]] == flat[order[:-1]]).all(1)]
        late, many = np.empty(len(flat), bool), np.empty(len(flat), bool)
        late[order], many[order] = same, np.r_[same[1:], False]
        return {"digest": pa.array(digests, pa.binary()), "doc": docs, "hash": hashes, "late": pa.array(late), "many": pa.array(many & ~late)}

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        digests, docs, hashes = [], [], []
        for b in parts:
            for doc, h, text in zip(b["doc"], b["hash"], b["text"], strict=True):
                keys = {k for line in text.split(b"\n") if (k := key_of(line, least)) is not None}
                digests += map(_digest, keys)
                docs += [doc] * len(keys)
                hashes += [h] * len(keys)
                if len(digests) >= size:
                    yield pack(digests, docs, hashes)
                    digests, docs, hashes = [], [], []
        if digests:
            yield pack(digests, docs, hashes)

    return by_batch(texts.select("doc", "hash", "text"), "digest binary,doc long,hash long,late boolean,many boolean", work)


class Bloom:
    """A Bloom filter of digests, with room for n of them."""

    def __init__(self, n: int) -> None:
        self.bits = max(64, BITS * n)
        self.data = np.zeros(-(-self.bits // 8), np.uint8)

    def _at(self, digests: np.ndarray) -> np.ndarray:
        """The places of each digest's bits: the sums of its first half and multiples of its second."""
        return (digests[:, :1] + np.arange(HASHES, dtype=np.uint64) * (digests[:, 1:] | np.uint64(1))) % np.uint64(self.bits)

    def add(self, digests: np.ndarray) -> None:
        at = self._at(digests).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def holds(self, digests: np.ndarray) -> np.ndarray:
        at = self._at(digests)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def suspects(digests: np.ndarray, many: np.ndarray, step: int = 4_096) -> np.ndarray:
    """Of digests (n x 2 words), those that occur again, or have many: each such one, and a few others."""
    once, twice = Bloom(len(digests)), Bloom(len(digests))
    for i in range(0, len(digests), step):
        part = digests[i : i + step]
        _, first, back = np.unique(part, axis=0, return_index=True, return_inverse=True)
        again = once.holds(part) | many[i : i + step] | (first[back.ravel()] != np.arange(len(part)))
        twice.add(part[again])
        once.add(part)
    return twice.holds(digests)


def _suspected(held: DataFrame) -> DataFrame:
    """digest, doc, hash of all rows whose digest may stand in two of them."""

    def work(t: pa.Table) -> pa.Table:
        flat = np.frombuffer(b"".join(t["digest"].to_pylist()), "<u8").reshape(-1, 2)
        found = suspects(flat, t["many"].to_numpy(zero_copy_only=False))
        return t.select(["digest", "doc", "hash"]).filter(pa.array(found))

    shards = blocks(held.sparkSession, held.where(~F.col("late")).count(), SHARD)
    first = held.where(~F.col("late")).select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "doc", "hash", "many")
    first = first.groupBy("shard").applyInArrow(lambda t: work(t), "digest binary, doc long, hash long")
    return first.unionByName(held.where("late").select("digest", "doc", "hash"))


def _losses(texts: DataFrame, least: int, documents: int) -> DataFrame:
    """doc, hash, digests: the keys that a row loses."""
    found = staged(_suspected(staged(_held(texts, least), "lines")), "suspects")
    each = found.groupBy("digest", "doc").agg(F.count("*").alias("n"))  # spreads a line that many documents hold
    counted = staged(each.groupBy("digest").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.max("doc").alias("last")).where(F.col("documents") >= documents), "repeated")
    lost = joined(found, counted.select("digest", "n", "last"), ["digest"], "n").where(F.col("doc") < F.col("last"))
    return lost.groupBy("doc", "hash").agg(F.collect_set("digest").alias("digests"))


def cut_lines(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines (before), n_dropped for each row of docs.

    A key of at least ``least`` code points that ``documents`` documents or more hold loses all its lines, except in
    the greatest doc_id that holds it. Documents are told apart by doc_id, so rows that share one count as one document;
    all rows without doc_id count as one, which comes before the others. A null text is the empty one, which has one
    empty line. Texts that lose all lines are empty. An empty table gives no rows; other columns are not read.

    Keys are equal if their digests of 128 bits are. No table goes to the driver; a row's keys are the only list."""
    texts = _texts(docs)
    lost = _losses(texts, least, documents)

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        for b in parts:
            texts, n, dropped = [], [], []
            for text, digests in zip(b["text"], b["digests"], strict=True):
                lines = text.split(b"\n")
                kept = lines
                if digests:
                    gone = set(digests)
                    kept = [x for x in lines if (k := key_of(x, least)) is None or _digest(k) not in gone]
                texts.append(b"\n".join(kept).decode())
                n.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield {"doc_id": b["doc_id"], "text": texts, "n_lines": n, "n_dropped": dropped}

    met = texts.join(lost, ["doc", "hash"], "left").select("doc_id", "text", "digests")
    return by_batch(met, "doc_id long,text string,n_lines long,n_dropped long", work)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of cut_lines with its defaults."""
    return cut_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
