"""JSON payloads walked by depth, against json and a recursion."""

import json
import re

from pyspark.sql import functions as F

from arborix.functions.text import redacted
from arborix.operators import payloads

NAMES, PARTS = ["answer", "Gold"], ["score"]
PATTERN = "KEY[0-9]+"
TEXTS = [
    {"answer": 1},
    {"q": "the answer is a score", "deep": [{"a": {"b": {"c": {"GOLD": None}}}}]},
    {"x": ["KEY12 and KEY3", {"y": "KEY9", "KEY7": "z"}], "n": 1.5, "t": True, "u": None, "e": {}, "l": [], "s": ""},
    ["my\"Scores\"", "tab\t\\ [é] ]", [["KEY1"]], {"MyScore": {"answer": ["gold"]}}],
    "KEY5 alone",
    12,
    None,
    {},
]


def keys(x, depth=0):
    if isinstance(x, dict):
        for k, v in x.items():
            if k.lower() in ("answer", "gold") or "score" in k.lower():
                yield depth + 1, k
            yield from keys(v, depth + 1)
    elif isinstance(x, list):
        for v in x:
            yield from keys(v, depth + 1)


def cleaned(x):
    if isinstance(x, str):
        return re.subn(PATTERN, "[REDACTED_SECRET]", x)
    pairs = [(k, *cleaned(v)) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))] if isinstance(x, dict | list) else []
    n = sum(c for *_, c in pairs)
    return ({k: v for k, v, _ in pairs}, n) if isinstance(x, dict) else ([v for _, v, _ in pairs], n) if isinstance(x, list) else (x, 0)


def strings(x):
    return isinstance(x, str) or sum(strings(v) for v in (x.values() if isinstance(x, dict) else x)) if isinstance(x, str | dict | list) else 0


def test_payloads_are_walked_by_depth(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(TEXTS)] + [(100, None), (101, "{not json"), (102, "")]
    found = payloads.levels(spark.createDataFrame(rows, "id long, payload string"))
    got = sorted((r.id, r.depth, r.key) for r in payloads.forbidden_keys(found, NAMES, PARTS).collect())
    assert got == sorted((i, *k) for i, x in enumerate(TEXTS) for k in keys(x)) and max(d for _, d, _ in got) == 6
    made = {r.id: (json.loads(r.payload), r.n) for r in payloads.changed_strings(found, lambda c: redacted(c, (PATTERN,))).collect()}
    assert made == {i: cleaned(x) for i, x in enumerate(TEXTS)}
    assert sum(x.where(F.col("kind") == "string").count() for x in found) == sum(strings(x) for x in TEXTS)


def test_no_payloads(spark):
    found = payloads.levels(spark.createDataFrame([], "id long, payload string"))
    assert len(found) == 1 and payloads.forbidden_keys(found, NAMES).count() == 0
    assert payloads.changed_strings(found, lambda c: redacted(c, (PATTERN,))).count() == 0
