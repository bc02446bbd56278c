"""Byte-level BPE as the tokenizers library does it: the split into words, exact merges, and a lexicon of words that
are looked up instead of merged. The vocabulary's file is a parameter and is read where it is used."""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: White space as Unicode has it (fixed values).
SPACE = frozenset(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Entries of a memo before it is emptied; memos only save time.
MEMO = 400_000
#: Bits of an id, and of a place in a word, in packed numbers.
ID, PLACE = 24, 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's file: printable ones for themselves, the others from
    U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """ids of tokens, ranks of pairs of ids, and the special strings, of a tokenizers file with a byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.ids = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        raw = lambda token: bytes(back[c] for c in token)
        self.pairs: dict[int, int] = {}  # two ids in one number: rank and new id in one number
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.pairs[self.ids[a] << ID | self.ids[b]] = rank << ID | self.ids[a + b]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def merged(vocab: Vocabulary, word: bytes) -> tuple[list[int], int]:
    """ids of a word's tokens, and how many merges made them. The symbols are a linked list; a heap holds the adjacent
    pairs by rank, then place, each packed in a number; one that isn't its place's pair any more is skipped."""
    ids = [vocab.byte_id[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids, 0
    find, push, pop = vocab.pairs.get, heapq.heappush, heapq.heappop
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [find(a << ID | b, -1) for a, b in zip(ids, ids[1:], strict=False)] + [-1]
    heap = [v << PLACE | i for i, v in enumerate(now) if v >= 0]
    heapq.heapify(heap)
    merges, place, low = 0, (1 << PLACE) - 1, (1 << ID) - 1
    while heap:
        x = pop(heap)
        i, v = x & place, x >> PLACE
        if now[i] != v:
            continue
        j = right[i]
        k = right[i] = right[j]
        new = ids[i] = v & low
        ids[j] = now[j] = now[i] = -1
        merges += 1
        if k < n:
            left[k] = i
            if (w := find(new << ID | ids[k])) is not None:
                now[i] = w
                push(heap, w << PLACE | i)
        h = left[i]
        if h >= 0:
            w = now[h] = find(ids[h] << ID | new, -1)
            if w >= 0:
                push(heap, w << PLACE | h)
    return [x for x in ids if x >= 0], merges


class Pieces:
    """Cuts texts at spaces into pieces that are encoded on their own, so that each distinct piece is worked on once.

    A space between two characters that aren't white space always begins a word, so what stands between two such
    spaces is split alike in any text. Texts with other white space next to a space are split as a whole. Special
    strings are found first, as the library does. ``work`` maps a list of words to the piece's value; ``join`` adds
    values up."""

    def __init__(self, vocab: Vocabulary, work, join) -> None:
        self.vocab, self.work, self.join = vocab, work, join
        self.memo: dict[str, object] = {}

    def _value(self, piece: str) -> object:
        """Of a piece behind a space; None if it must be seen in its text."""
        if not piece or piece[0] in SPACE or piece[-1] in SPACE:
            return None
        return self.work(self.vocab.words.findall(" " + piece))

    def plain(self, text: str, parts: list[str] | None = None) -> list:
        """Values of a text without special strings (parts: it, split at spaces); they are to be joined."""
        if not text:
            return []
        first, *rest = parts or text.split(" ")
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = list(map(memo.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    piece = rest[i]
                    x = memo.get(piece)
                    if x is None:
                        x = self._value(piece)
                        if x is None:
                            return [self.work(self.vocab.words.findall(text))]
                        memo[piece] = x
                    found[i] = x
        if not first or first[-1] in SPACE:
            return [self.work(self.vocab.words.findall(text))]
        return [self.work(self.vocab.words.findall(first)), *found]

    def of(self, text: str, special, parts: list[str] | None = None) -> object:
        """special: value of a special string's id."""
        if self.vocab.cut is None or not any(s in text for s in self.vocab.special):
            return self.join(self.plain(text, parts))
        out: list = []
        for part in self.vocab.cut.split(text):
            out += [special(self.vocab.special[part])] if part in self.vocab.special else self.plain(part)
        return self.join(out)


# ---------------------------------------------------------------- lexicon


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions, final marks and root of the minimal acyclic automaton of sorted distinct words: each state whose
    subtree is complete is replaced by an equal one if there is one already."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path, last = [0], b""

    def freeze(depth: int) -> None:
        while len(path) - 1 > depth:
            child, parent = path.pop(), path[-1]
            signature = (final[child], tuple(arcs[child].items()))
            same = known.setdefault(signature, child)
            if same != child:
                arcs[parent][last[len(path) - 1]] = same

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        freeze(common)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)
    return arcs, final, 0


class Lexicon:
    """Words with their ids as a minimal acyclic transducer. The outputs of a word's arcs add up to its place among
    the sorted words, which leads to its ids; words share states by their ends as well as by their beginnings.

    The compiled form is a few arrays in one file, which is mapped and not loaded. Words are looked up many at a time:
    one step of all of them for each byte."""

    PARTS = (("key", "<i8"), ("to", "<i4"), ("out", "<i4"), ("final", "u1"), ("start", "<i4"), ("ids", "<u4"))

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        order = sorted(w for w in words if w)
        arcs, final, root = minimal_automaton(order)
        live, todo = {root: 0}, [root]
        for s in todo:
            for t in arcs[s].values():
                if t not in live:
                    live[t] = len(live)
                    todo.append(t)
        below: dict[int, int] = {}
        for s in _children_first(arcs, root):
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
        rows = []
        for s in todo:
            passed = int(final[s])
            for b, t in sorted(arcs[s].items()):
                rows.append((live[s] * 256 + b, live[t], passed))
                passed += below[t]
        rows.sort()
        lengths = [len(words[w]) for w in order]
        parts = {
            "key": [r[0] for r in rows], "to": [r[1] for r in rows], "out": [r[2] for r in rows], "final": [final[s] for s in todo],
            "start": np.concatenate([[0], np.cumsum(lengths)]) if order else [0], "ids": [i for w in order for i in words[w]],
        }
        made = [np.asarray(parts[name]).astype(kind) for name, kind in Lexicon.PARTS]
        head = np.array([len(x) for x in made], "<i8").tobytes()
        return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in made)

    def __init__(self, compiled: bytes) -> None:
        """Maps the compiled bytes through a file without a name, which goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at = np.frombuffer(self.map, "<i8", len(self.PARTS)), 8 * len(self.PARTS)
        for (name, kind), n in zip(self.PARTS, sizes.tolist(), strict=True):
            setattr(self, name, np.frombuffer(self.map, kind, n, at))
            nbytes = n * np.dtype(kind).itemsize
            at += nbytes + -nbytes % 8

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of each word among the sorted ones of the lexicon; -1: not there."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(words) else n
        data = np.frombuffer(b"".join(words), np.uint8)
        state, total, found = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        alive = np.flatnonzero(n > 0)
        if not len(self.key):
            return found
        for depth in range(int(n.max(initial=0))):
            key = state[alive] * 256 + data[begin[alive] + depth]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            ok = self.key[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.to[at]
            total[alive] += self.out[at]
            over = n[alive] == depth + 1
            done = alive[over]
            done = done[self.final[state[done]] > 0]
            found[done] = total[done]
            alive = alive[~over]
            if not len(alive):
                break
        return found

    def ids_of(self, place: int) -> bytes:
        return self.ids[self.start[place] : self.start[place + 1]].tobytes()


def _children_first(arcs: list[dict[int, int]], root: int) -> Iterator[int]:
    seen, stack = set(), [(root, False)]
    while stack:
        s, ready = stack.pop()
        if ready:
            yield s
        elif s not in seen:
            seen.add(s)
            stack.append((s, True))
            stack.extend((t, False) for t in arcs[s].values())


def numbers(packed: bytes) -> array:
    return array("I", packed)
