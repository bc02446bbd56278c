"""A dense encoder without a model: hashed words and character n-grams."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

#: fixed values, which stored vectors depend on
PERSON, SIZES, DIMENSIONS = b"ngrag-v1", (3, 4), 192


@lru_cache(maxsize=1 << 18)
def _place(name: str) -> tuple[int, float]:
    h = hashlib.blake2b(name.encode(), digest_size=8, person=PERSON).digest()
    return int.from_bytes(h[:4], "big"), 1.0 if h[4] % 2 else -1.0


def hashed(words: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of the words and of the n-grams of the words joined by "_", of length 1 (or 0 without words)."""
    if dimensions < 8:
        raise ValueError("at least 8 dimensions")
    joined, v = "_".join(words), np.zeros(dimensions)
    names = [f"w:{w}" for w in words] + [f"c{n}:{joined[i : i + n]}" for n in SIZES for i in range(len(joined) - n + 1)]
    for name, n in Counter(names).items():
        at, sign = _place(name)
        v[at % dimensions] += sign * n
    size = float(np.sqrt((v * v).sum()))
    return v / size if size else v


def _added(v: np.ndarray, rows: np.ndarray, kinds: np.ndarray, names: list[str]) -> None:
    """Adds to v the signs of what stands in rows: kinds are places in names, of which each is hashed once; "" counts nothing."""
    at, sign = (np.array(x) for x in zip(*(_place(x) if x else (0, 0.0) for x in names), strict=True))
    n = v.shape[1]
    v += np.bincount(rows * n + (at % n)[kinds], weights=sign[kinds], minlength=v.size).reshape(v.shape)


def hashed_rows(joined: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """hashed of many texts, a row for each, whose words are joined by "_". N-grams are numbered, not cut out one by one: by
    three code points of 21 bits, or by the number of the one before and one more; only different ones are hashed."""
    v, text = np.zeros((len(joined), dimensions)), "\0".join(joined)
    if not any(joined):
        return v
    words = pa.array(joined, pa.large_string())
    words = pc.split_pattern(pc.if_else(pc.equal(words, ""), None, words), "_")
    kinds = words.flatten().dictionary_encode()
    _added(v, pc.list_parent_indices(words).to_numpy(), kinds.indices.to_numpy(), [f"w:{w}" for w in kinds.dictionary.to_pylist()])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(joined)), [len(j) + 1 for j in joined])
    numbers = points
    for n in range(2, max(SIZES) + 1):
        numbers = (numbers[:-1] << 21) | points[n - 1 :]
        if n in SIZES and len(numbers):
            numbers = pd.factorize(numbers)[0]
            first = np.flatnonzero(np.diff(np.maximum.accumulate(numbers), prepend=-1)).tolist()
            found = [text[i : i + n] for i in first]
            _added(v, rows[: len(numbers)], numbers, ["" if "\0" in x else f"c{n}:{x}" for x in found])
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=v, where=size > 0)


def letters(words: list[str]) -> np.ndarray:
    """How often each of the letters a to z stands in the words: a plain encoder, whose cosines SQL can compute."""
    joined = "".join(words)
    return np.array([joined.count(chr(ord("a") + i)) for i in range(26)], float)


#: Code points that are numbered at once, unless one text has more.
CHUNK = 1 << 20


def _chunks(joined: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for j in joined:
        if part and n + len(j) > CHUNK:
            yield part
            part, n = [], 0
        part.append(j)
        n += len(j)
    if part:
        yield part


def encoded(text: Column, encoder: Callable[[list[str]], np.ndarray] = hashed) -> Column:
    """Vectors of texts, by batches; another encoder of the words can be given. Words hold no "_", and come joined by it."""

    @F.arrow_udf("array<double>")
    def run(words: pa.Array) -> pa.Array:
        texts = [w or "" for w in words.to_pylist()]
        if encoder is hashed:
            v = [hashed_rows(part) for part in _chunks(texts)]
        else:
            v = [np.array(encoder(t.split("_") if t else []), float)[None] for t in texts]
        flat = np.concatenate([x.ravel() for x in v]) if v else np.zeros(0)
        sizes = np.concatenate([np.full(len(x), x.shape[1]) for x in v]) if v else np.zeros(0, int)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)

    return run(F.array_join(tokens(text), "_"))
