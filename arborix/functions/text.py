"""Column functions over texts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, case-folded; order and repetitions stay."""
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def share(x: Column, total: Column) -> Column:
    return F.when(total > 0, x / total).otherwise(F.lit(0.0))


def weighted(a: Column, b: Column, wa: float, wb: float) -> Column:
    return (a * wa + b * wb) / (wa + wb)


def decayed(value: Column, age: Column, half_life: float) -> Column:
    return value * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def query_gate(query: Column, target: Column, floor: float, power: float) -> Column:
    """floor + (1 - floor) * cosine of the token sets ** power."""
    return set_gate(F.array_distinct(query), F.array_distinct(target), floor, power)


def set_gate(q: Column, e: Column, floor: float, power: float) -> Column:
    """query_gate of tokens that stand once each. They are few, and looked up one by one: no set is made for a row."""
    both = F.size(F.filter(q, lambda x: F.array_contains(e, x)))
    cosine = F.when((F.size(q) > 0) & (F.size(e) > 0), both / F.sqrt(F.size(q) * F.size(e))).otherwise(0.0)
    return floor + (1 - floor) * F.pow(clamped(cosine, 0.0, 1.0), F.lit(power))


def redacted(text: Column, patterns: tuple[str, ...], mark: str = "[REDACTED_SECRET]") -> tuple[Column, Column]:
    """The text with each pattern replaced, and how many were."""
    count = F.lit(0)
    for p in patterns:
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, mark)
    return text, count
