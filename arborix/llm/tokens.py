"""Token counts, encoding and decoding of whole documents."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ID, MEMO, SPACE, VOCABULARY, Lexicon, Pieces, merged, numbers, vocabulary
from .common import by_batch, documents

#: The longest of windows that a document is held against, in tokens.
LIMIT = 1024
#: Words of the lexicon at most; a word must stand this often in all documents to be taken in.
LEXICON, LEAST = 50_000, 20


@lru_cache(maxsize=1)
def _counter(path: str) -> Pieces:
    """Counts tokens; its memos serve all tasks of a worker process."""
    vocab, memo = vocabulary(path), {}

    def count(words: list[str]) -> int:
        total = 0
        for w in words:
            if (n := memo.get(w)) is None:
                if len(memo) > MEMO:
                    memo.clear()
                raw = w.encode()
                n = memo[w] = len(raw) - merged(vocab, raw)[1]
            total += n
        return total

    return Pieces(vocab, count, sum)


def token_counts(docs: DataFrame, path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, without making any ids.

    A word's count is its bytes less its merges (a heap of adjacent pairs over a linked list of symbols). Null texts
    are empty: 0 bytes, 0 tokens. Rows that repeat are counted each; a null doc_id stays null; an empty table gives no
    rows; other columns are not read."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        pieces = _counter(path)
        for part in parts:
            n = [pieces.of(t, lambda _: 1) for t in part["text"]]
            yield {"doc_id": part["doc_id"], "n_bytes": [len(t.encode()) for t in part["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return by_batch(documents(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)


def frequent_words(docs: DataFrame, path: str = VOCABULARY, size: int = LEXICON) -> list[str]:
    """The size most frequent words of all documents, of those that stand LEAST times or more in them (at most so many
    come to the driver). Each task splits its distinct pieces and passes all counts on. Next to a space, other white
    space is counted as split there."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        find, seen, first = vocabulary(path).words.findall, Counter(), Counter()

        def flush() -> dict:
            count = Counter()
            for pieces, before in ((seen, " "), (first, "")):
                for piece, n in pieces.items():
                    for w in find(before + piece):
                        count[w] += n
                pieces.clear()
            return {"word": list(count), "n": list(count.values())}

        for part in parts:
            for t in part["text"]:
                head, *rest = t.split(" ")
                first[head] += 1
                seen.update(rest)
            if len(seen) + len(first) > MEMO:
                yield flush()
        yield flush()

    counts = by_batch(documents(docs).select("text"), "word string, n long", work).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(size).collect()]


def lexicon(docs: DataFrame, path: str = VOCABULARY, size: int = LEXICON) -> bytes:
    """The compiled transducer of the most frequent words of docs, with their ids."""
    vocab = vocabulary(path)
    return Lexicon.compile({(raw := w.encode()): merged(vocab, raw)[0] for w in frequent_words(docs, path, size)})


@lru_cache(maxsize=1)
def ranked(path: str):  # noqa: ANN201
    """The vocabulary for tiktoken, whose merges go by the ids of the merged tokens: so they do in a file whose ids are
    its merges' order, which is checked."""
    import tiktoken

    vocab = vocabulary(path)
    order = [v & ((1 << ID) - 1) for v in vocab.pairs.values()]
    if order != sorted(order):
        raise ValueError("the ids of the merged tokens don't follow their ranks")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})


#: The encoder of a worker process, by lexicon and vocabulary: its memos serve all of the process's tasks.
_ENCODERS: dict = {}


def encoder_of(compiled: bytes, path: str) -> Encoder:
    key = hashlib.sha256(compiled).digest(), path
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(compiled, path)
    return _ENCODERS[key]


class Encoder:
    """ids of texts: words of the lexicon are looked up, others merged. Values are pairs of packed ids and decimal ids,
    each followed by a comma."""

    def __init__(self, compiled: bytes, path: str) -> None:
        self.vocab, self.lexicon, self.ranks = vocabulary(path), Lexicon(compiled), ranked(path)
        most = 1 + max(self.vocab.bytes_of)
        self.decimal, self.spelled = [f"{i}," for i in range(most)], [self.vocab.bytes_of.get(i, b"") for i in range(most)]
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pieces = Pieces(self.vocab, self._words, lambda xs: (b"".join([x[0] for x in xs]), "".join([x[1] for x in xs])))

    def _value(self, packed: bytes) -> tuple[bytes, str]:
        return packed, "".join(map(self.decimal.__getitem__, numbers(packed)))

    def _words(self, words: list[str]) -> tuple[bytes, str]:
        known = self.known
        if len(words) == 1 and (x := known.get(words[0])) is not None:
            return x
        new = [w for w in words if w not in known]
        if new:
            self.learn(new)
        out = [known[w] for w in words]
        return out[0] if len(out) == 1 else (b"".join([x[0] for x in out]), "".join([x[1] for x in out]))

    def learn(self, words: list[str]) -> None:
        """Of words that the lexicon doesn't have, the library merges the bytes by rank."""
        raw = [w.encode() for w in words]
        merge, ids = self.ranks._encode_single_piece, self.vocab.ids
        for w, r, place in zip(words, raw, self.lexicon.places(raw).tolist(), strict=True):
            self.known[w] = self._value(self.lexicon.ids_of(place) if place >= 0 else array("I", [ids[r]] if r in ids else merge(r)).tobytes())

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Looks the words of many texts up at once, encodes the pieces that come up first in them, then joins."""
        memo, known, find = self.pieces.memo, self.known, self.vocab.words.findall
        if len(known) > MEMO or len(memo) > MEMO:
            known.clear()
            memo.clear()
        parts = [t.split(" ") for t in texts]
        new = set().union(*parts).difference(memo)
        split = {p: find(" " + p) for p in new if p and p[0] not in SPACE and p[-1] not in SPACE}
        words = {w for ws in split.values() for w in ws}.difference(known)
        if words:
            self.learn(list(words))
        for p, ws in split.items():
            memo[p] = known[ws[0]] if len(ws) == 1 else self._words(ws)
        return [self.encode(t, p) for t, p in zip(texts, parts, strict=True)]

    def encode(self, text: str, parts: list[str] | None = None) -> tuple[bytes, str]:
        return self.pieces.of(text, lambda i: self._value(np.array([i], "<u4").tobytes()), parts)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.spelled.__getitem__, numbers(packed))).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str = VOCABULARY, size: int = LEXICON) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit), id_text (decimal, comma-joined) and decoded text of each document.

    Null texts are empty: no ids, an empty decoded text. Rows that repeat are encoded each; a null doc_id stays null;
    an empty table gives no rows; other columns are not read. The lexicon (bounded by size words) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, size))

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        encoder = encoder_of(shared.value, path)
        for part in parts:
            pairs = encoder.encode_all(part["text"])
            yield {"doc_id": part["doc_id"], "ids": [p for p, _ in pairs], "id_text": [s[:-1] for _, s in pairs], "decoded": [encoder.decode(p) for p, _ in pairs]}

    return by_batch(documents(docs), "doc_id long, ids binary, id_text string, decoded string", work)


def encoding_digests(docs: DataFrame, path: str = VOCABULARY, size: int = LEXICON) -> DataFrame:
    """As encoded, but the number of ids and the SHA-256 of id_text and decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, size))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        encoder = encoder_of(shared.value, path)
        for part in parts:
            pairs = encoder.encode_all(part["text"])
            yield {"doc_id": part["doc_id"], "n_tokens": [len(p) // 4 for p, _ in pairs], "ids_sha256": [sha(s[:-1]) for _, s in pairs], "decoded_sha256": [sha(encoder.decode(p)) for p, _ in pairs]}

    return by_batch(documents(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
