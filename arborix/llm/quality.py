"""Quality: a generalised additive model with pairwise interactions, of lookup tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE, by_batch, documents
from .training import SAMPLE, held_out, labelled_sample

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "symbol", "bar", "exclaim", "stop", "non_ascii", "entropy",
    "unique_words", "top_word", "odd_end", "no_letter", "short_words", "lines", "repeated_lines", "line_length", "upper_words",
)
#: Bins of a feature, cells of a side of a pair's grid, boosting rounds, learning rate, pairs, leaf weight.
BINS, GRID, ROUNDS, RATE, PAIRS, LEAF = 32, 8, 120, 0.15, 6, 5.0
THRESHOLD = 0.3
SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]|\\/_=+", np.uint8)


def measure(text: str) -> list[float]:
    """The features of a text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = seen[seen > 0] / n
    words = text.split()
    k = max(1, len(words))
    lengths = [len(w) for w in words] or [0]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(len(x) * (c - 1) for x, c in Counter(lines).items() if c > 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / k, np.log1p(max(lengths)), seen[65:91].sum() / n, seen[48:58].sum() / n, seen[SYMBOLS].sum() / n,
        seen[124] / n, seen[33] / n, seen[46] / n, seen[128:].sum() / n, float(-(share * np.log2(share)).sum()), len(counts) / k, max(counts.values(), default=0) / k,
        sum(not (w[-1].isalpha() or w[-1] in ".,") for w in words) / k, sum(w.isdigit() or not any(map(str.isalpha, w)) for w in words) / k, sum(x <= 3 for x in lengths) / k,
        np.log1p(len(lines)), repeated / len(text), np.log1p(len(text) / max(1, len(lines))), sum(map(str.isupper, words)) / k,
    ]


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Steps of the bins of one feature by a tree of that depth, from the bins' gradients and curvatures."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    c, d = g.sum() - a, h.sum() - b
    gain = np.where((b >= LEAF / 4) & (d >= LEAF / 4), a * a / (b + 1.0) + c * c / (d + 1.0), -1.0)
    at = int(gain.argmax())
    if gain[at] <= g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
        return out
    return np.concatenate([tree(g[: at + 1], h[: at + 1], depth - 1), tree(g[at + 1 :], h[at + 1 :], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps of the cells of a grid by one cut of each side (four leaves), and the gain of the best such cuts."""
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]
    best, cut = -1.0, (1, 1)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for i in range(1, len(g)):
        for j in range(1, len(g)):
            gain = 0.0
            for a, b, c, d in ((0, i, 0, j), (0, i, j, len(g)), (i, len(g), 0, j), (i, len(g), j, len(g))):
                x, y = (s[b, d] - s[a, d] - s[b, c] + s[a, c] for s in sums)
                gain += x * x / (y + 1.0)
            if gain > best:
                best, cut = gain, (i, j)
    out = np.zeros_like(g)
    for rows in (slice(0, cut[0]), slice(cut[0], None)):
        for cols in (slice(0, cut[1]), slice(cut[1], None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return out, best - whole


@dataclass
class Model:
    """cuts of each feature's bins, a table for each feature, and one for each pair (on coarser bins)."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries: one lookup for each feature and pair, of all rows at once."""
        m = np.full(len(x), self.bias)
        if not self.cuts or not len(x):
            return m
        b = self.bins(x)
        for i, t in enumerate(self.tables):
            m += t[b[:, i]]
        coarse = b * GRID // BINS
        for i, j, t in self.pairs:
            m += t[coarse[:, i], coarse[:, j]]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosting in turn over the features, each step a shallow tree of one feature; then over the pairs that explain
    most of what is left. Without two classes, the score is the share of label 1 (1 without any labels)."""
    if not len(y) or y.min() == y.max():
        return Model(20.0 if not len(y) or y[0] else -20.0)
    rate = y.mean()
    model = Model(float(np.log(rate / (1 - rate))))
    for i in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS))
        model.cuts.append(cuts)
        model.tables.append(np.zeros(BINS))
    b = model.bins(x)
    m = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-m))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(x.shape[1]):
            g, h = slopes()
            step = RATE * tree(np.bincount(b[:, i], g, BINS), np.bincount(b[:, i], h, BINS))
            model.tables[i] += step
            m += step[b[:, i]]
    coarse = b * GRID // BINS
    grid = lambda i, j, v: np.bincount(coarse[:, i] * GRID + coarse[:, j], v, GRID * GRID).reshape(GRID, GRID)
    g, h = slopes()
    ranked = sorted(((pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((GRID, GRID))) for _, i, j in ranked]
    for _ in range(ROUNDS // 4):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = RATE * pair_tree(grid(i, j, g), grid(i, j, h))[0]
            t += step
            m += step[coarse[:, i], coarse[:, j]]
    return model


def features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                yield pa.record_batch([part["doc_id"], part["y"].cast(pa.int32()), pa.array([list(map(float, measure(t))) for t in part["text"].to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    table = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return x, table["y"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, size: int = SAMPLE) -> Model:
    """On labelled rows with crc32(doc_id) mod parts other than part."""
    return fit(*features(labelled_sample(docs, labels, "quality", ~held_out(parts, part), size)))


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, threshold: float = THRESHOLD, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by its text alone.

    Null and empty texts get the score of an empty text. Equal texts get equal scores. A null doc_id is never held
    out. An empty table gives no rows; other columns are not read. The model (a few tables) is broadcast; nothing is
    shuffled but the labels."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, parts, part, size))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            s = model.value.score(np.array([measure(t) for t in b["text"]], float).reshape(-1, len(FEATURES)))
            yield {"doc_id": b["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    scored = by_batch(documents(docs), "doc_id long, score double, predicted int", work)
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; a null text counts as empty."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(shared.value.score(np.array([measure(t or "") for t in texts], float).reshape(-1, len(FEATURES))) >= threshold)

    return docs.where(good("text"))
