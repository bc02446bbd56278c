"""Packing of token ids into windows by the sum-of-squares rule."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, documents

#: Ids of a window, the id behind each document, and the vocabulary (its ranks and special strings).
WINDOW, END = 1024, 0
RANKS, SPECIAL = public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}
#: Documents of a packer, and packers of the first round for one of the second.
EACH, ROUND = 16_384, 4
#: Windows that one task numbers at most.
TASK_WINDOWS = 1 << 40


@lru_cache(maxsize=2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


class Packer:
    """Online packing of pieces, one at a time, into windows. levels[f] is the number of open windows filled to f.

    A piece of length s goes to the level f (0: a new window) for which the sum of the squared counts is least
    afterwards: moving a window from f to f + s changes it by 2 * (levels[f + s] - levels[f]) + 2, opening one by
    2 * levels[s] + 1, closing one by 1 - 2 * levels[f]. Equal sums: the fullest window."""

    def __init__(self, size: int = WINDOW) -> None:
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, piece: tuple, length: int) -> list | None:
        """The pieces of the window if it is full now."""
        size, levels = self.size, self.levels
        f = np.flatnonzero(levels[: size - length + 1])
        after = np.where(f + length == size, 0, levels[f + length])
        cost = np.where(f + length == size, 1 - 2 * levels[f], 2 * (after - levels[f]) + 2)
        new = 1 + 2 * levels[length] if length < size else 0
        if len(f) and (best := int(cost.min())) <= new:
            at = int(f[np.flatnonzero(cost == best)[-1]])
            window = self.open[at].pop()
            levels[at] -= 1
        else:
            at, window = 0, []
        window.append(piece)
        if at + length == size:
            return window
        self.open[at + length].append(window)
        levels[at + length] += 1
        return None

    def rest(self) -> Iterator[tuple]:
        """Pieces of the windows that are still open, fullest first."""
        for f in range(self.size - 1, 0, -1):
            for window in self.open[f]:
                yield from window


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECE = pa.schema([*((c, pa.int64()) for c in COLUMNS), ("laid", pa.bool_()), ("ids", pa.binary())])
DDL = ", ".join(f"{c} long" for c in COLUMNS) + ", laid boolean, ids binary"


def _pieces(docs: DataFrame, ranks: str, size: int, end: int) -> DataFrame:
    """Each document (its ids and the end id) as full windows and, with its ids, what is left of it."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        encoding = _encoding(ranks)
        for part in batches:
            rows: list[tuple] = []
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                ids = encoding.encode_to_numpy(text, allowed_special="all") if text else np.array([], np.uint32)
                data = np.append(ids, end).astype("<u4").tobytes()
                total = len(data) // 4
                for start in range(0, total, size):
                    x = data[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(x) // 4, zlib.crc32(x), total, None if len(x) == 4 * size else x))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"), columns, strict=True))

    return by_batch(documents(docs), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary", work)


def _round(pieces: DataFrame, packers: int, order: tuple, first: int, size: int, last: bool) -> DataFrame:
    """pieces with sequence_id and offset where a window is full; the last round leaves none out. Pieces are dealt to packers
    and sorted, so a packer that is run again sees them in the same order and numbers its windows alike, from first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(size), first + TaskContext.get().partitionId() * TASK_WINDOWS
        rows: list[tuple] = []

        def emit(window: list[tuple], laid: bool = False) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, at, laid, None))
                at += len(ids) // 4
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(PIECE)
            rows.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)

        for b in batches:
            tail = pc.is_valid(b["ids"])
            whole = b.filter(pc.invert(tail))
            if whole.num_rows:  # full windows, and pieces that an earlier round has placed
                new = pc.is_null(whole["sequence_id"]).to_numpy(zero_copy_only=False)
                own = np.where(new, number + np.cumsum(new) - 1, whole["sequence_id"].fill_null(0).to_numpy())
                number += int(new.sum())
                columns = {n: whole[n] for n in PIECE.names} | {"sequence_id": pa.array(own, pa.int64()), "offset": whole["offset"].fill_null(0), "laid": whole["laid"].fill_null(False)}
                yield pa.record_batch([columns[n] for n in PIECE.names], schema=PIECE)
            t = b.filter(tail)
            for doc, start, ids, total in zip(*(t[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                if window := packer.place((doc, start, ids, total), len(ids) // 4):
                    emit(window)
                if len(rows) > 20_000:
                    yield out()
        if not last:
            rows += [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, None, ids) for doc, start, ids, total in packer.rest()]
        else:
            window, room = [], size
            for doc, start, ids, total in packer.rest():
                while ids:
                    take = ids[: 4 * room]
                    window.append((doc, start, take, total))
                    ids, start, room = ids[len(take) :], start + len(take) // 4, room - len(take) // 4
                    if not room:
                        emit(window, True)
                        window, room = [], size
            if window:
                emit(window, True)
        yield out()

    dealt = pieces.repartition(packers, "doc_id", "start", "ids_crc32").sortWithinPartitions(*order, "doc_id", "start", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return dealt.mapInArrow(run, DDL)


def packed(docs: DataFrame, ranks: str = RANKS, size: int = WINDOW, end: int = END, each: int = EACH) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, laid.

    Of a document (its ids and the end id), full windows are cut off first; what is left of it is placed whole, by Packer.
    A packer gets about each documents, whatever the table's partitions are: the more it gets, the fewer windows are
    still open at its end, as open windows grow with the root of the pieces at most. The pieces of open windows go to a second
    round of ROUND times fewer packers, longest first. What that leaves open is laid end to end and cut at each window's end
    (laid is true there), so one window of a packer of the second round at most is padded.

    A packer holds its open windows, whose number does not grow with the table; what moves are ids of one window at most for
    each document. Rows that repeat are packed each, by one packer; null texts are empty: one piece with the end id alone; a
    null doc_id stays null; an empty table gives no rows; other columns are not read."""
    packers = max(1, -(-docs.count() // each))
    pieces = _pieces(docs, ranks, size, end).select("*", *(F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset")), F.lit(None).cast("boolean").alias("laid"))
    once = _round(pieces, packers, (), 0, size, False)
    return _round(once, -(-packers // ROUND), (F.desc("length"),), 1 << 62, size, True).drop("ids")


def padding(pieces: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows, ids in them and ids of padding."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    return filled.agg(F.count("*").alias("windows"), F.sum("filled").alias("ids"), F.sum(size - F.col("filled")).alias("padding"))
