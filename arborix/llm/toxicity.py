"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, by_batch, documents, staged
from .training import SAMPLE, held_out, labelled_sample

#: Lengths of n-grams, in characters of a word with a space before and behind it, and the places they are hashed to.
LENGTHS, PLACES = (4, 5, 6, 7, 8), 1 << 21
#: Smoothing of counts; least documents and least z of a kept n-gram; L2 weight; fitting steps; folds that set the threshold.
ALPHA, LEAST, Z, L2, STEPS, FOLDS = 1.0, 4, 3.0, 0.3, 300, 3
THRESHOLD = 0.7
MEMO = 300_000
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[int]:
    """Places of the word's n-grams."""
    w = f" {word} "
    return [zlib.crc32(w[i : i + n].encode()) % PLACES for n in LENGTHS for i in range(len(w) - n + 1)]


def words(text: str) -> set[str]:
    """Runs of letters, in lower case."""
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    """weight of the places that count, and what a text without any gets."""

    weight: dict[int, float]
    bias: float

    def scorer(self):  # noqa: ANN201
        memo: dict[str, tuple[int, ...]] = {}
        weight = self.weight

        def places(word: str) -> tuple[int, ...]:
            if (x := memo.get(word)) is None:
                if len(memo) > MEMO:
                    memo.clear()
                x = memo[word] = tuple(g for g in grams(word) if g in weight)
            return x

        def score(text: str) -> float:
            found = {g for w in words(text) for g in places(w)}
            return 1 / (1 + np.exp(-np.clip(self.bias + sum(weight[g] for g in sorted(found)), -500, 500)))

        return score


def _in_parts(sample: DataFrame, schema: pa.Schema, ddl: str, work) -> DataFrame:  # noqa: ANN001
    """work of (y, fold, places) of some rows at a time. Equal texts lie in one fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, b.num_rows, SLICE):
                    part = b.slice(i, SLICE)
                    texts = part["text"].to_pylist()
                    yield part["y"].to_numpy(), np.array([zlib.crc32(t.encode()) % FOLDS for t in texts]), [np.array(sorted({g for w in words(t) for g in grams(w)}), np.int64) for t in texts]

        yield from (pa.record_batch(columns, schema=schema) for columns in work(parts()))

    return sample.select("y", "text").mapInArrow(run, ddl)


def _scores(n, t, docs: int, toxic: int):  # noqa: ANN001, ANN202
    """How far the share of toxic documents among n (t of them toxic) lies from that of all, in standard deviations; of
    columns or of arrays."""
    rate = toxic / docs if docs else 0.0
    return (t - n * rate) / (n * (rate * (1 - rate)) + 1e-9) ** 0.5


def counted(sample: DataFrame, sizes: np.ndarray) -> pa.Table:
    """place, and for each fold how many documents (n0, n1...) and toxic ones (t0...) hold it, of the places that are kept
    for the whole sample or for the sample without one fold. Counted by the executors; only kept places come back."""
    names = [f"{c}{f}" for f in range(FOLDS) for c in "nt"]

    def work(parts: Iterator[tuple]) -> Iterator[list]:
        sums = np.zeros((2 * FOLDS, PLACES), np.int32)
        for y, fold, places in parts:
            for yy, f, at in zip(y.tolist(), fold.tolist(), places, strict=True):
                sums[2 * f][at] += 1
                sums[2 * f + 1][at] += yy
        at = np.flatnonzero(sums[::2].any(0))
        yield [pa.array(at), *(pa.array(x[at].astype(np.int64)) for x in sums)]

    schema = pa.schema([("place", pa.int64()), *((n, pa.int64()) for n in names)])
    found = _in_parts(sample, schema, ", ".join(f"{f.name} long" for f in schema), work).groupBy("place").agg(*(F.sum(n).alias(n) for n in names))
    kept = F.lit(False)
    for out in (None, *range(FOLDS)):
        use = [f for f in range(FOLDS) if f != out]
        n, t = (sum((F.col(f"{c}{f}") for f in use[1:]), F.col(f"{c}{use[0]}")) for c in "nt")
        docs, toxic = (int(sizes[use, k].sum()) for k in range(2))
        kept = kept | ((n >= LEAST) & (F.abs(_scores(n, t, docs, toxic)) >= Z))
    return found.where(kept).orderBy("place").toArrow()


def features(sample: DataFrame, kept: np.ndarray) -> pa.Table:
    """y, fold and, of each document, which of the kept places it holds (by their index)."""
    known = sample.sparkSession.sparkContext.broadcast(kept)
    schema = pa.schema([("y", pa.int32()), ("fold", pa.int32()), ("own", pa.list_(pa.int32()))])

    def work(parts: Iterator[tuple]) -> Iterator[list]:
        for y, fold, places in parts:
            held = [np.flatnonzero(np.isin(known.value, at, assume_unique=True)) for at in places]
            yield [pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(held, pa.list_(pa.int32()))]

    return _in_parts(sample, schema, "y int, fold int, own array<int>", work).toArrow()


def fit(y: np.ndarray, rows: np.ndarray, own: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the places and the bias: naive Bayes log-count ratios r, then logistic regression on r times presence.

    y: labels; rows, own: which document holds which place; n, t: documents and toxic documents of each place. Places whose
    share of toxic documents is no further from that of all than chance has it (Z) weigh nothing."""
    toxic, docs = y.sum(), len(y)
    if not docs or toxic in (0, docs):
        return np.zeros(len(n)), 0.0 if not docs else (20.0 if toxic else -20.0)
    r = np.log((t + ALPHA) / (toxic + 2 * ALPHA)) - np.log((n - t + ALPHA) / (docs - toxic + 2 * ALPHA))
    r[(n < LEAST) | (np.abs(_scores(n, t, docs, toxic)) < Z)] = 0.0
    ok = r[own] != 0
    rows, own = rows[ok], own[ok]
    x = r[own]
    w, b = np.zeros(len(n)), float(np.log(toxic / (docs - toxic)))
    # Gradient descent with a step from each place's own curvature bound (Adagrad).
    seen_w, seen_b = np.full(len(n), 1e-6), 1e-6
    best, kept_w = np.inf, (w.copy(), b)
    for _ in range(STEPS):
        m = np.bincount(rows, x * w[own], docs) + b
        loss = np.logaddexp(0, np.where(y > 0, -m, m)).sum() + L2 / 2 * (w @ w)
        if loss < best:
            best, kept_w = loss, (w.copy(), b)
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        g, gb = np.bincount(own, x * (p - y)[rows], len(n)) + L2 * w, (p - y).sum()
        seen_w, seen_b = seen_w + g * g, seen_b + gb * gb
        w, b = w - 0.3 * g / np.sqrt(seen_w), b - 0.3 * gb / np.sqrt(seen_b)
    return kept_w[0] * r, float(kept_w[1])


def best_margin(y: np.ndarray, m: np.ndarray) -> float | None:
    """The margin from which on label 1 has the best F1, half way to the margin below; None without two classes."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-m, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (taken + y.sum())
    f1[:-1][m[order][:-1] == m[order][1:]] = -1  # equal margins are taken together
    i = int(f1.argmax())
    below = m[order][i + 1] if i + 1 < len(y) else m[order][i] - 1
    return float(m[order][i] + below) / 2


def fitted(table: pa.Table, places: np.ndarray, n: np.ndarray, t: np.ndarray, threshold: float) -> Model:
    """The model of all rows of table. Its bias is moved so that the score threshold lies where documents of a fold, under a
    model of the other folds, are best told apart (F1)."""
    y, fold = table["y"].to_numpy().astype(float), table["fold"].to_numpy()
    lists = table["own"].combine_chunks()
    own = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    w, b = fit(y, rows, own, n.sum(0), t.sum(0))
    margin, tried = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(FOLDS):
        use = fold != f
        number = np.cumsum(use) - 1
        at = use[rows]
        fw, fb = fit(y[use], number[rows[at]], own[at], n.sum(0) - n[f], t.sum(0) - t[f])
        if 0 < y[use].sum() < use.sum():
            margin[~use] = (np.bincount(rows[~at], fw[own[~at]], len(y)) + fb)[~use]
            tried |= ~use
    cut = best_margin(y[tried], margin[tried])
    if cut is not None:
        b += float(np.log(threshold / (1 - threshold))) - cut
    return Model({int(p): float(v) for p, v in zip(places, w, strict=True) if v}, b)


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, size: int = SAMPLE, threshold: float = THRESHOLD) -> Model:
    """On labelled rows with crc32(doc_id) mod parts other than part. The rows are written to the shared folder once."""
    sample = staged(labelled_sample(docs, labels, "toxic", ~held_out(parts, part), size).select("y", "text"), "labelled")
    sizes = np.zeros((FOLDS, 2))
    for f, docs_there, toxic in sample.groupBy((F.crc32(F.col("text").cast("binary")) % FOLDS).alias("f")).agg(F.count("*"), F.sum("y")).collect():
        sizes[f] = docs_there, toxic
    kept = counted(sample, sizes)
    places = kept["place"].to_numpy()
    n, t = (np.stack([kept[f"{c}{f}"].to_numpy() for f in range(FOLDS)]).astype(float) for c in "nt")
    return fitted(features(sample, places), places, n, t, threshold)


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, threshold: float = THRESHOLD, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by its text alone.

    Null and empty texts get the score of a text without n-grams. Equal texts get equal scores. A null doc_id is never
    held out. An empty table gives no rows; other columns are not read. The model is broadcast; it has PLACES weights
    at most. Nothing is shuffled but the labels and the counts of n-grams. A very long text costs its distinct words."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, parts, part, size, threshold))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        score = model.value.scorer()
        for b in batches:
            s = [float(score(t)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    scored = by_batch(documents(docs), "doc_id long, score double, predicted int", work)
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", "predicted")
