"""Removal of repeated strings of bytes, by a depth-limited radix sort of suffixes.

Suffixes are compared through LENGTH bytes only; those that agree so far are the repeated windows. Ordering every
suffix of a corpus would move a hundred times its size, so the sort begins with suffixes at *anchors*: the GRAM bytes
with the least hash among all GRAM-byte strings of a window (winnowing). Every window holds an anchor, and equal
windows hold equal anchors at equal places, so windows are equal only if they stand alike around equal anchors.

1. First digit. Each task sorts its anchors by (hash of the gram, hash of all bytes that any window around it can
   hold). Grams that stand once in the corpus drop out. Of equal surroundings, all but the first are marked at once.
2. Further digits. What is left are first occurrences whose gram occurs in other surroundings too. Their windows are
   sorted from the most significant digit on, 8 bytes a pass; a window alone in its class drops out after each pass.
   Classes after the last pass are the repeated windows; in each, all but the first are marked.
3. A gram with very many different surroundings (a passage in a large part of the corpus) isn't brought to one task:
   its windows are dealt and marked by a 128-bit hash of the window, and each task sends one row at most for each.
4. What steps 1 and 3 marked by hashes is compared byte by byte with the occurrence before it in its class, which is
   asked of the task that holds that text; equality being transitive, all equal the first then. Two texts that differ
   under one hash fail the job rather than lose a byte; another seed then gives other hashes.

The texts are shuffled once: steps 2 and 4 and the end read the same shuffle again."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

LENGTH, GRAM = 100, 24
#: Anchors of a task that are sorted together; different surroundings of a gram in one task, and in all, above which
#: its windows go by hash; surroundings that are sorted together; bytes that are hashed together.
FLUSH, HOT_TASK, HOT, SORTED, CHUNK = 600_000, 64, 1_024, 3_000, 1 << 18
#: Documents of a block, and of a bucket.
BLOCK_DOCS, BUCKET_DOCS = 400, 1_000
FULL, SORT, HASH = 1, 2, 3
PART = 1 << 40

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("pos", "<i8")])
#: An anchor, and the one before it in its class; a run of bytes and the run that it is to be compared with (at < 0: none).
MARK = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("before", "<i8"), ("at", "<i8"), ("kind", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("end", "<i8"), ("before", "<i8"), ("at", "<i8")])


def tables(seed: int) -> np.ndarray:
    """Two random odd numbers for each byte: what the hashes are made of."""
    return np.random.default_rng(20240229 + seed).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slid(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each width neighbours, in steps that double."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return x[:n] if size == width else f(x[:n], x[width - size : width - size + n])


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each GRAM bytes (16 + 8), never 0."""
    h, power, size, kept = table[data], BASE, 1, None
    with np.errstate(over="ignore"):
        while size < 16:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
            kept = h if size == 8 else kept
        h = h[: len(data) - GRAM + 1] * BASE**np.uint64(8) + kept[16 : len(data) - GRAM + 17]
        return np.maximum(mixed(h), np.uint64(1))


class Ranges:
    """Hashes of any range of a string, from sums of its bytes times powers."""

    powers = np.ones(1, np.uint64)
    backs = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, table: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            if len(Ranges.powers) <= len(data):
                n = max(CHUNK, len(data)) + 1
                Ranges.powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, BASE))])
                Ranges.backs = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, BACK))])
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * Ranges.powers[: len(data)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[b] - self.sums[a]) * Ranges.backs[a] + (b - a).astype(np.uint64))


def anchors(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, place in it, hash of the gram and of its surroundings, of each anchor."""
    span = LENGTH - GRAM + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    h = gram_hashes(data, table[0])
    least = slid(h, span, np.minimum)
    owner = np.repeat(np.arange(len(texts)), sizes)
    least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0  # windows that cross an end
    zeros = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(slid(np.concatenate([zeros, least, zeros]), span, np.maximum) == h)
    own = owner[chosen]
    left, right = np.maximum(begins[own], chosen - (span - 1)), np.minimum(ends[own], chosen + LENGTH)
    with np.errstate(over="ignore"):
        around = mixed(Ranges(data, table[1]).of(left, right) + (chosen - left).astype(np.uint64) * BASE)
    return own, chosen - begins[own], h[chosen], around


def pieces(body: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A text in pieces (first, end, where its bytes begin, bytes): an anchor from first to end has all windows and
    surroundings in these bytes, so a very long text costs no more memory than others."""
    margin = 2 * LENGTH
    for a in range(0, len(body), CHUNK):
        begin = max(0, a - margin)
        yield a, min(a + CHUNK, len(body)), begin, body[begin : a + CHUNK + margin]


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _by_bucket(x: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]]), strict=True):
        if b > a:
            yield int(bucket[a]), _blob(x[a:b])


def _block(doc: np.ndarray, n: int) -> np.ndarray:
    """As ``_block_column`` has it."""
    ids, back = np.unique(doc, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % n for i in ids.tolist()], np.int64)[back] if len(ids) else np.empty(0, np.int64)


def _block_column(n: int):  # noqa: ANN202
    return F.crc32(F.col("doc").cast("string").cast("binary")) % n


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order; whether each begins a gram, begins a class, and is the entry before it once more."""
    x = x[np.lexsort((x["pos"], x["doc"], x["c"], x["h"]))]
    new_h = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
    new_c = new_h | np.concatenate([[True], x["c"][1:] != x["c"][:-1]])
    same = np.concatenate([[False], (x["doc"][1:] == x["doc"][:-1]) & (x["pos"][1:] == x["pos"][:-1])]) & ~new_c
    return x, new_h, new_c, same


def _marks(x: np.ndarray, rows: np.ndarray, kind: int) -> np.ndarray:
    """Marks of the entries rows, each with the entry before it."""
    at = np.flatnonzero(rows)
    m = np.zeros(len(at), MARK)
    m["doc"], m["pos"], m["kind"] = x["doc"][at], x["pos"][at], kind
    if kind == FULL:
        m["before"], m["at"] = x["doc"][at - 1], x["pos"][at - 1]
    return m


def _first_digit(n_buckets: int, n_blocks: int, table: np.ndarray):  # noqa: ANN202
    """Task side of step 1: rows (bucket, kind, blob); kind 0: entries, 1: hot gram hashes, 2: marks, which only pass
    through and are dealt by their document."""
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(found) if found else np.empty(0, ENTRY)
        found.clear()
        if not len(x):
            return
        x, new_h, new_c, same = _classes(x)
        group = np.cumsum(new_h) - 1
        hot = (np.bincount(group[new_c]) > HOT_TASK)[group]
        m = np.concatenate([_marks(x, ~new_c & ~same, FULL), _marks(x, new_c & hot, HASH)])
        y = x[new_c & ~hot]
        out = [(b, 0, v) for b, v in _by_bucket(y, (y["h"] % np.uint64(n_buckets)).astype(np.int64))]
        y = x["h"][new_h & hot]
        out += [(b, 1, v) for b, v in _by_bucket(y, (y % np.uint64(n_buckets)).astype(np.int64))]
        out += [(b, 2, v) for b, v in _by_bucket(m, _block(m["doc"], n_blocks) % n_buckets)]
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held: list[tuple[int, int, int, int, bytes]] = []  # document, place of the bytes, first and end of what counts, bytes
        count = size = 0

        def take() -> int:
            nonlocal size
            doc, shift, first, end = np.array([h[:4] for h in held], np.int64).T
            own, pos, h, c = anchors([h[4] for h in held], table)
            at = pos + shift[own]
            ok = (at % PART >= first[own]) & (at % PART < end[own])
            x = np.empty(int(ok.sum()), ENTRY)
            x["h"], x["c"], x["doc"], x["pos"] = h[ok], c[ok], doc[own][ok], at[ok]
            found.append(x)
            held.clear()
            size = 0
            return len(x)

        for b in batches:
            for i in range(0, b.num_rows, 128):
                s = b.slice(i, 128)
                for doc, part, body in zip(s["doc"].to_pylist(), s["part"].to_pylist(), s["body"].to_pylist(), strict=True):
                    if len(body) < LENGTH:
                        continue
                    for first, end, begin, piece in pieces(body):
                        held.append((doc, part * PART + begin, first, end, piece))
                        size += len(piece)
                        if size >= CHUNK:
                            count += take()
                            if count >= FLUSH:
                                yield from flush(found)
                                count = 0
        if held:
            take()
        yield from flush(found)

    return run


def _blocked(runs: np.ndarray, n_blocks: int, of: str = "doc") -> list[tuple[int, bytes]]:
    return list(_by_bucket(runs, _block(runs[of], n_blocks)))


def _grams_of(n_blocks: int):  # noqa: ANN202
    """Bucket side of step 1: marks of anchors, by block of the document."""

    def run(t):  # noqa: ANN001, ANN202
        kinds, blobs = t["kind"].to_numpy(), t["blob"].to_pylist()
        pick = lambda k, d: np.frombuffer(b"".join(v for v, kk in zip(blobs, kinds, strict=True) if kk == k), d)
        x, hot, out = pick(0, ENTRY), pick(1, "<u8"), [pick(2, MARK)]
        if len(x):
            x, new_h, new_c, same = _classes(x)
            group = np.cumsum(new_h) - 1
            kinds_of = np.bincount(group[new_c])
            is_hot = ((kinds_of > HOT) | np.isin(x["h"][new_h], hot))[group]
            out += [_marks(x, ~new_c & ~same, FULL), _marks(x, new_c & is_hot, HASH), _marks(x, new_c & ~is_hot & (kinds_of[group] > 1), SORT)]
        rows = _blocked(np.concatenate(out), n_blocks)
        return pa.table([pa.array([b for b, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], names=["blk", "blob"])

    return run


def _by_document(m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Marks or runs by (document, part), with places in the part."""
    m = m.copy()
    part = m["pos"] // PART
    m["pos"] -= part * PART
    if "end" in m.dtype.names:
        m["end"] -= part * PART
    order = np.lexsort((part, m["doc"]))
    m, part = m[order], part[order]
    cuts = np.flatnonzero((np.diff(m["doc"]) != 0) | (np.diff(part) != 0)) + 1
    starts = np.concatenate([[0], cuts]).astype(int)
    return {(int(m["doc"][a]), int(part[a])): m[a:b] for a, b in zip(starts, np.concatenate([cuts, [len(m)]]).astype(int), strict=True) if b > a}


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of one document that touch each other and are to be compared with adjoining bytes, as one."""
    if not len(runs):
        return runs
    shift = np.where(runs["at"] < 0, 0, runs["at"] - runs["pos"])
    part = runs["pos"] // PART
    order = np.lexsort((runs["pos"], shift, runs["before"], runs["at"] < 0, part, runs["doc"]))
    runs, keys = runs[order], (runs["doc"][order], part[order], runs["before"][order], shift[order], runs["at"][order] < 0)
    other = np.concatenate([[False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    chain = np.cumsum(other) * PART
    reach = np.maximum.accumulate(chain + runs["end"] % PART)
    new = other | np.concatenate([[True], (chain + runs["pos"] % PART)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    out = runs[first]
    out["end"] = np.maximum.reduceat(runs["end"], first)
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges, as maximal runs."""
    if not len(starts):
        return []
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    inside = np.concatenate([[0], np.cumsum(change) > 0, [0]])
    edges = np.flatnonzero(np.diff(inside))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


#: Rows between steps 2 and 3, by kind: 0 runs that pass through, 2 surroundings to be sorted, 3 hashes of windows.
BETWEEN = (("kind", "int"), ("bucket", "long"), ("doc", "long"), ("part", "long"), ("pos", "long"), ("left", "int"), ("body", "binary"))
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], columns: tuple[tuple[str, str], ...]) -> pa.Table:
    made = zip(*rows, strict=True) if rows else [()] * len(columns)
    return pa.table([pa.array(c, ARROW[k]) for c, (_, k) in zip(made, columns, strict=True)], names=[n for n, _ in columns])


def _texts(docs: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    """Row, document, part and bytes of a block's texts; of rows that are one document, the first. Bytes are made one by one."""
    seen = set()
    body = docs["body"]
    for i, key in enumerate(zip(docs["doc"].to_pylist(), docs["part"].to_pylist(), strict=True)):
        if key not in seen:
            seen.add(key)
            yield i, *key, body[i].as_py()


def _surroundings(n_buckets: int, table: np.ndarray):  # noqa: ANN202
    """Step 1's marks put on the documents of a block; rows as BETWEEN has them."""
    span = LENGTH - GRAM

    def run(docs, marks):  # noqa: ANN001, ANN202
        by = _by_document(np.frombuffer(b"".join(marks["blob"].to_pylist()), MARK)) if marks.num_rows else {}
        rows: list[tuple] = []
        hashed: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        for _, doc, part, body in _texts(docs) if by else ():
            m = by.get((doc, part))
            if m is None:
                continue
            n = len(body)
            full = m[m["kind"] == FULL]
            lo, hi = np.maximum(full["pos"] - span, 0), np.minimum(full["pos"] + LENGTH, n)
            r = np.zeros(len(full), RUN)
            r["doc"], r["pos"], r["end"], r["before"], r["at"] = doc, part * PART + lo, part * PART + hi, full["before"], full["at"] - (full["pos"] - lo)
            runs.append(_joined(r))
            known = np.zeros(n + 1, bool)
            for a, b in covered(n + 1, lo, hi - LENGTH + 1):
                known[a:b] = True
            for pos in m[m["kind"] == SORT]["pos"].tolist():
                a, b = max(0, pos - span), min(n, pos + LENGTH)
                if not known[a : b - LENGTH + 1].all():
                    rows.append((2, zlib.crc32(body[pos : pos + GRAM]) % n_buckets, doc, part, pos, pos - a, body[a:b]))
            if len(hot := m[m["kind"] == HASH]["pos"]):
                lo, hi = np.maximum(hot - span, 0), np.minimum(hot, n - LENGTH) + 1
                for a, b in covered(n + 1, lo, hi):
                    for a in range(a, b, CHUNK):  # noqa: B020, PLW2901
                        starts = np.arange(a, min(a + CHUNK, b))
                        starts = starts[~known[starts]]
                        if len(starts):
                            data, at = np.frombuffer(body, np.uint8, min(CHUNK + LENGTH, n - a), a), starts - a
                            x = np.empty(len(starts), ENTRY)
                            x["h"], x["c"] = (Ranges(data, t).of(at, at + LENGTH) for t in table)
                            x["doc"], x["pos"] = doc, part * PART + starts
                            hashed.append(x)
        if hashed:
            x, _, new, same = _classes(np.concatenate(hashed))
            runs.append(_windows(x, ~new & ~same))
            y = x[new]
            rows += [(3, b, None, None, None, None, v) for b, v in _by_bucket(y, (y["h"] % np.uint64(n_buckets)).astype(np.int64))]
        if runs:
            r = np.concatenate(runs)
            rows += [(0, b, None, None, None, None, v) for b, v in _by_bucket(r, np.full(len(r), marks["blk"][0].as_py() % n_buckets))]
        return _table(rows, BETWEEN)

    return run


def _windows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of the windows rows of sorted entries, to be compared with the windows before them."""
    at = np.flatnonzero(rows)
    r = np.zeros(len(at), RUN)
    r["doc"], r["pos"], r["end"], r["before"], r["at"] = x["doc"][at], x["pos"][at], x["pos"][at] + LENGTH, x["doc"][at - 1], x["pos"][at - 1]
    return _joined(r)


def radix_classes(rows: np.ndarray, first: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited MSD radix sort of suffixes: row and start of each, in the matrix of bytes rows (padded by 8).
    Suffixes are only compared within a group. Returns those that are not alone, and their class."""
    item = np.arange(len(first))
    cls = group
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)).view(">u8")[..., 0]
    for depth in range(0, LENGTH, 8):
        digit = words[first[item], starts[item] + depth]
        if LENGTH - depth < 8:
            digit = digit >> np.uint64(8 * (8 - LENGTH + depth))
        digit = digit.astype(np.uint64)
        order = np.lexsort((digit, cls))
        item, cls, digit = item[order], cls[order], digit[order]
        new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (digit[1:] != digit[:-1])]) if len(item) else np.empty(0, bool)
        cls = np.cumsum(new) - 1
        many = (np.bincount(cls) > 1)[cls] if len(cls) else np.empty(0, bool)
        item, cls = item[many], cls[many]
        if not len(item):
            break
    return item, cls


def _sorted_windows(n_blocks: int):  # noqa: ANN202
    """Steps 2 and 3 in a bucket: marks of the windows that aren't the first of their class."""
    span = LENGTH - GRAM

    def sort(batch: list[tuple[int, int, int, bytes, int]]) -> np.ndarray:
        width = span + LENGTH
        rows = np.zeros((len(batch), width + 8), np.uint8)
        left, size = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
        for i, (_, _, off, body, _) in enumerate(batch):
            a = span - off
            rows[i, a : a + len(body)] = np.frombuffer(body, np.uint8)
            left[i], size[i] = a, len(body)
        n = size - LENGTH + 1
        first = np.repeat(np.arange(len(batch)), n)
        starts = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n) + left[first]
        group = np.array([g for *_, g in batch])[first] * width + starts
        item, cls = radix_classes(rows, first, starts, group)
        doc = np.array([b[0] for b in batch])[first[item]]
        pos = np.array([b[1] for b in batch])[first[item]] + starts[item] - span
        order = np.lexsort((pos, doc, cls))
        cls, doc, pos = cls[order], doc[order], pos[order]
        new = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.empty(0, bool)
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])]) if len(cls) else np.empty(0, bool)
        found = np.zeros(int((~new & ~same).sum()), RUN)
        found["doc"], found["pos"], found["at"] = doc[~new & ~same], pos[~new & ~same], -1
        found["end"] = found["pos"] + LENGTH
        return _joined(found)

    def run(t):  # noqa: ANN001, ANN202
        kinds = t["kind"].to_numpy()
        out = [np.frombuffer(b"".join(t.filter(pa.array(kinds == 0))["body"].to_pylist()), RUN)]
        if (kinds == 2).any():
            s = t.filter(pa.array(kinds == 2))
            groups: dict[bytes, list] = defaultdict(list)
            for doc, part, pos, left, body in zip(*(s[c].to_pylist() for c in ("doc", "part", "pos", "left", "body")), strict=True):
                groups[body[left : left + GRAM]].append((doc, part * PART + pos, left, body))
            batch: list[tuple] = []
            for g, (_, members) in enumerate(sorted(groups.items())):
                batch += [(*m, g) for m in members]
                if len(batch) >= SORTED:
                    out.append(sort(batch))
                    batch = []
            if batch:
                out.append(sort(batch))
        if (kinds == 3).any():
            x, _, new, same = _classes(np.frombuffer(b"".join(t.filter(pa.array(kinds == 3))["body"].to_pylist()), ENTRY))
            out.append(_windows(x, ~new & ~same))
        rows = _blocked(np.concatenate(out), n_blocks)
        return pa.table([pa.array([b for b, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], names=["blk", "blob"])

    return run


#: Rows of step 4, by kind: 0 runs of the block's texts, 1 runs whose bytes another block asks for, 2 runs with such bytes.
ASKED = (("blk", "long"), ("kind", "int"), ("blob", "binary"), ("data", "binary"))


def _asked(n_blocks: int):  # noqa: ANN202
    """The runs of a block's documents, and those to be compared once more, to the blocks of the texts before them."""

    def run(t):  # noqa: ANN001, ANN202
        runs = _joined(np.frombuffer(b"".join(t["blob"].to_pylist()), RUN))
        ask = runs[runs["at"] >= 0]
        rows = [(t["blk"][0].as_py(), 0, _blob(runs), None)]
        return _table(rows + [(b, 1, v, None) for b, v in _blocked(ask, n_blocks, "before")], ASKED)

    return run


def _answered(n_blocks: int):  # noqa: ANN202
    """Bytes of a block's texts, to those that asked for them; each row is of one asking block and some CHUNK bytes."""

    def run(docs, rows):  # noqa: ANN001, ANN202
        out = [(r["blk"], 0, r["blob"], None) for r in rows.to_pylist() if r["kind"] == 0]
        asked = np.frombuffer(b"".join(r["blob"] for r in rows.to_pylist() if r["kind"] == 1), RUN)
        if len(asked):
            asked = asked[np.lexsort((asked["pos"], asked["doc"], asked["at"], asked["before"]))]
            part = asked["at"] // PART
            cuts = np.flatnonzero((np.diff(asked["before"]) != 0) | (np.diff(part) != 0)) + 1
            spans = {(int(asked["before"][a]), int(part[a])): (a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(asked)], strict=True)}
            block = _block(asked["doc"], n_blocks)
            held: dict[int, list] = defaultdict(list)
            sizes: dict[int, int] = defaultdict(int)

            def give(to: int) -> None:
                out.append((to, 2, b"".join(r for r, _ in held[to]), b"".join(d for _, d in held[to])))
                held[to].clear()
                sizes[to] = 0

            for _, doc, p, body in _texts(docs):
                for i in range(*spans.get((doc, p), (0, 0))):
                    a, to = int(asked["at"][i]) - p * PART, int(block[i])
                    held[to].append((asked[i].tobytes(), body[a : a + int(asked["end"][i] - asked["pos"][i])]))
                    sizes[to] += len(held[to][-1][1])
                    if sizes[to] > CHUNK:
                        give(to)
            for to in [k for k, v in held.items() if v]:
                give(to)
        return _table(out, ASKED)

    return run


def _compared(rows: pa.Table) -> dict[tuple[int, int], list[tuple[int, int, bytes]]]:
    """By document and part: runs and the bytes that they must hold."""
    out = defaultdict(list)
    for blob, data in zip(rows["blob"].to_pylist(), rows["data"].to_pylist(), strict=True):
        at = 0
        for doc, pos, end, _, _ in np.frombuffer(blob, RUN).tolist():
            out[doc, pos // PART].append((pos % PART, pos % PART + end - pos, data[at : at + end - pos]))
            at += end - pos
    return out


def _finished(finish: Callable, names: list[str], carried: list[str]):  # noqa: ANN202
    """Documents with all their runs, compared: what finish makes of (bytes, maximal runs)."""

    def run(docs, rows):  # noqa: ANN001, ANN202
        kinds = rows["kind"].to_numpy() if rows.num_rows else np.empty(0, int)
        by = _by_document(np.frombuffer(b"".join(rows.filter(pa.array(kinds == 0))["blob"].to_pylist()), RUN)) if len(kinds) else {}
        same = _compared(rows.filter(pa.array(kinds == 2))) if len(kinds) else {}
        made: dict[tuple[int, int], tuple] = {}
        for _, doc, part, body in _texts(docs):
            r = by.get((doc, part))
            wanted = same.get((doc, part), ())
            if r is not None and int((r["at"] >= 0).sum()) != len(wanted):
                raise RuntimeError(f"document {doc}: {len(wanted)} comparisons of {int((r['at'] >= 0).sum())}")
            if any(body[a:b] != x for a, b, x in wanted):
                raise ValueError("different strings under one hash: run again with another seed")
            made[doc, part] = finish(body, covered(len(body), r["pos"], r["end"]) if r is not None else [])
        rows = [made[k] for k in zip(docs["doc"].to_pylist(), docs["part"].to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.table([*(pa.array(c, KINDS.get(n, pa.string())) for n, c in zip(names, columns, strict=True)), *(docs[c] for c in carried)], names=[*names, *carried])

    return run


KINDS = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def digest(body: bytes, runs: list[tuple[int, int]]) -> tuple:
    keep, at = hashlib.sha256(), 0
    for a, b in runs:
        keep.update(body[at:a])
        at = b
    keep.update(body[at:])
    return len(body), sum(b - a for a, b in runs), len(runs), keep.hexdigest()


def kept_text(body: bytes, runs: list[tuple[int, int]]) -> tuple:
    """The text without the runs; a character that a run holds in part stays."""
    out, at = [], 0
    for a, b in runs:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        out.append(body[at:a])
        at = b
    return (b"".join([*out, body[at:]]).decode(),)


def without_repeats(docs: DataFrame, finish: Callable, fields: str, table: np.ndarray) -> DataFrame:
    """docs without the column text, with fields: what finish returns for (bytes of the text, runs of removed bytes).

    A byte is removed if a LENGTH-byte string covers it that also starts earlier: in a document of a smaller doc_id, or
    earlier in the same. Null texts are empty; texts shorter than LENGTH bytes lose nothing. A null doc_id is less
    than all others. Rows that share doc_id and text are one document and get the same result; texts that share a
    doc_id are ordered by their hashes, then text. An empty table gives no rows; other columns are carried along. A very
    long text is hashed in pieces; it is held once in memory by each task that reads its block."""
    spark = docs.sparkSession
    carried = [f"carried_{i}" for i, c in enumerate(docs.columns) if c != "text"]
    names = [c for c in docs.columns if c != "text"]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), body.alias("body"), *(F.col(f"`{c}`").alias(x) for c, x in zip(names, carried, strict=True)))
    ids = base.groupBy("doc").agg(F.count("*").alias("c"))
    total = ids.agg(F.sum("c"), F.max("c")).first()
    rows = total[0] or 0
    if (total[1] or 0) > 1:
        hashed = base.withColumn("hash", F.xxhash64("body"))
        shared = hashed.join(ids.where("c > 1").select("doc"), "doc", "left_semi").select("doc", "hash", "body").distinct()
        numbered = shared.withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy("hash", "body")).cast("long") - 1)
        base = hashed.join(numbered, ["doc", "hash", "body"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).drop("hash")
    else:
        base = base.withColumn("part", F.lit(0).cast("long"))
    n_blocks, n_buckets = blocks(spark, rows, BLOCK_DOCS), blocks(spark, rows, BUCKET_DOCS)
    columns = lambda named: ", ".join(f"{n} {k}" for n, k in named)
    entries = base.select("doc", "part", "body").mapInArrow(_first_digit(n_buckets, n_blocks, table), "bucket long, kind int, blob binary")
    marks = entries.groupBy("bucket").applyInArrow(_grams_of(n_blocks), "blk long, blob binary")
    placed = base.withColumn("blk", _block_column(n_blocks)).groupBy("blk")
    between = placed.cogroup(marks.groupBy("blk")).applyInArrow(_surroundings(n_buckets, table), columns(BETWEEN))
    runs = between.groupBy("bucket").applyInArrow(_sorted_windows(n_blocks), "blk long, blob binary")
    asked = runs.groupBy("blk").applyInArrow(_asked(n_blocks), columns(ASKED))
    answered = placed.cogroup(asked.groupBy("blk")).applyInArrow(_answered(n_blocks), columns(ASKED))
    kinds, made = dict(docs.dtypes), [x.split()[0] for x in fields.split(",")]
    extra = "".join(f", {x} {kinds[c]}" for c, x in zip(names, carried, strict=True))
    out = placed.cogroup(answered.groupBy("blk")).applyInArrow(_finished(finish, made, carried), fields + extra)
    return out.select(*(F.col(x).alias(c) for c, x in zip(names, carried, strict=True)), *made)


def repeats(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; see without_repeats."""
    return without_repeats(docs.select("doc_id", "text"), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", tables(seed))


def deduplicated(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs with the repeats cut out of text and n_chars set to match; all rows and columns stay. A null text stays
    null. A character of which a run covers a part only stays whole."""
    free = "_" * max(map(len, docs.columns))  # no column of docs has such a name
    marked = docs.withColumn(f"null{free}", F.col("text").isNull())
    out = without_repeats(marked, kept_text, f"kept{free} string", tables(seed)).withColumn("text", F.when(~F.col(f"null{free}"), F.col(f"kept{free}")))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)
