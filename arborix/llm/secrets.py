"""Secrets in texts: fixed patterns, and strings that a BPE vocabulary needs many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Patterns of the fixed kinds, and the fewest characters of the match (of its second group, if it has one); fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Only runs of 16 or more count, and a greedy match of a class is the whole run either way.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
#: A candidate of the token test: a run of this alphabet, this long at least, with a letter in it.
LENGTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LENGTH},}}")
#: Parts of a run, and what joins them; no token of the vocabulary's pattern reaches over their ends.
PART = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")
#: Fewer characters per token than this are a random string: prose has 4 and more, names in code 3, base64 below 2.
RATIO = 2.0
#: Hex digits of known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and UUIDs.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
PLAIN_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Parts of an identifier: lower-case or capitalised words and numbers; none can be split in two, or long runs would backtrack.
WORD = r"(?:[A-Z]?[a-z]{3,}+|[A-Z]{3,}(?![A-Z]{2})|[0-9]++)"
IDENTIFIER = re.compile(rf"{WORD}(?:[-_/]?{WORD})*")
#: Subpatterns of an identifier's words may not be this many for its length: random strings fall into short ones.
WORD_LENGTH = 4
REPLACEMENT = "[SECRET]"


@lru_cache(maxsize=2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, in order."""
    spans = []
    for m in ASSIGN.finditer(text) if ":" in text or "=" in text else ():
        if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
            spans.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def known_form(run: str) -> bool:
    """Whether a run without UUIDs is a digest, or an identifier of words and numbers."""
    if PLAIN_HEX.fullmatch(run):
        return len(run) in DIGESTS
    if not IDENTIFIER.fullmatch(run):
        return False
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", run)
    return len(words) * WORD_LENGTH <= len(run) and max(map(len, words)) < LENGTH


def _outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of start to end lies in none of the sorted spans."""
    out = []
    for a, _, b in spans:
        if a >= end:
            break
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def _has_letter(run: str) -> bool:
    return any(c.isalpha() for c in run)


def _random_within(run: str, ranks: str, ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or else each longest row of its parts that readable parts
    don't thin out: a part gains by its tokens and loses by its characters, and these are the rows of greatest gain."""
    if len(run) < LENGTH or not _has_letter(run):
        return []
    encoding, known = _encoding(ranks), known_form(run)
    ids = encoding.encode_ordinary(run)
    if not known and len(run) < ratio * len(ids):
        return [(0, len(run))]
    ends = [0]
    for t in encoding.decode_tokens_bytes(ids):
        ends.append(ends[-1] + len(t))
    rows, at, total = [], 0, 0.0  # start, end, gain before, gain after, the last row that begins with less gain
    for m in PART.finditer(run):
        before, a = total, at
        while ends[at] < m.end():
            at += 1
        digest = PLAIN_HEX.fullmatch(m[0]) and len(m[0]) in DIGESTS
        total += -2 * ratio * len(run) if digest else ratio * (at - a) - len(m[0])
        if total <= before:
            continue
        start, low = m.start(), before
        while True:
            k = len(rows) - 1
            while k >= 0 and rows[k][2] >= low:
                k = rows[k][4]
            if k < 0 or rows[k][3] >= total:
                rows.append((start, m.end(), low, total, k))
                break
            start, low = rows[k][0], rows[k][2]
            del rows[k:]
    return [(a, b) for a, b, *_ in rows if b - a >= LENGTH and _has_letter(run[a:b]) and not known_form(run[a:b])]


def random_spans(text: str, ranks: str = RANKS, ratio: float = RATIO, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs, as UUIDs cut them, and of parts of runs, with few characters per token that aren't of
    a known form. What lies outside the spans of base is tested by itself as well, unless the whole run is such a one."""
    out = set()
    for m in CANDIDATE.finditer(text):
        for start, end in _outside(*m.span(), [(u.start() + m.start(), 3, u.end() + m.start()) for u in UUID.finditer(m[0])]):
            found = {(start + a, 3, start + b) for a, b in _random_within(text[start:end], ranks, ratio)}
            if (start, 3, end) not in found and (near := [b for b in base if b[0] < end and start < b[2]]):
                rest = {(a + x, 3, a + y) for a, b in _outside(start, end, near) for x, y in _random_within(text[a:b], ranks, ratio)}
                found |= {r for r in rest if not any(f[0] <= r[0] and r[2] <= f[2] for f in found)}
            out |= found
    return sorted(out)


def all_spans(text: str, ranks: str = RANKS, ratio: float = RATIO) -> tuple[list, list]:
    """The fixed spans, and these with the token test's, but for those that fixed ones cover fully."""
    base = fixed_spans(text)
    new = [s for s in random_spans(text, ranks, ratio, base) if _outside(s[0], s[2], base)]
    return base, sorted(base + new) if new else base


def _say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, ranks: str = RANKS, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each document.

    Null and empty texts have no spans (base_sha256 is that of the empty string). Rows that repeat are scanned each; a
    null doc_id stays null; an empty table gives no rows; other columns are not read. Nothing is shuffled."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        for part in parts:
            found = [all_spans(t, ranks, ratio) for t in part["text"]]
            counts = [[sum(s[1] == k for s in every) for _, every in found] for k in range(4)]
            yield {
                "doc_id": part["doc_id"], "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "n_random": counts[3],
                "base_sha256": [hashlib.sha256(_say(base).encode()).hexdigest() for base, _ in found], "spans": [_say(every) for _, every in found],
            }

    return by_batch(documents(docs), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", work)


def redact(text: str, ranks: str = RANKS, ratio: float = RATIO) -> str:
    """text with each span, or overlapping spans together, replaced."""
    out, at = [], 0
    for a, _, b in all_spans(text, ranks, ratio)[1]:
        if a >= at:
            out += [text[at:a], REPLACEMENT]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, ranks: str = RANKS, ratio: float = RATIO) -> DataFrame:
    """docs with secrets replaced in text and n_chars set to match; all rows and columns stay, null texts too."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: redact(t, ranks, ratio), na_action="ignore")

    return docs.withColumn("text", clean("text")).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
