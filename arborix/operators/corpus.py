"""Checks of a corpus: snapshots, digests, links, coverage and contamination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, before, after of what two snapshots(path, blob_sha) don't share."""
    a, b = before.select("path", F.col("blob_sha").alias("before")), after.select("path", F.col("blob_sha").alias("after"))
    return a.join(b, "path", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def hash_decision(raw: Column, expected: Column) -> Column:
    """How the bytes (as text) meet an expected digest: as they are, or with all line ends turned into the other kind.
    Bare returns and mixed line ends are turned down; so is what has nothing to turn."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    lf, cr, crlf = F.lit("\n"), F.lit("\r"), F.lit("\r\n")
    rest = F.replace(raw, crlf, F.lit(""))
    alternate = F.when(F.contains(raw, cr), sha(F.replace(raw, crlf, lf))).otherwise(sha(F.replace(raw, lf, crlf)))
    kind = F.when(F.contains(raw, cr), F.lit("newline_equivalent_crlf_to_lf")).otherwise(F.lit("newline_equivalent_lf_to_crlf"))
    return (
        F.when(sha(raw) == expected, "raw_match")
        .when(~F.contains(raw, cr) & ~F.contains(raw, lf), "rejected_no_newline_conversion")
        .when(F.contains(rest, cr), "rejected_bare_cr")
        .when(F.contains(raw, cr) & F.contains(rest, lf), "rejected_mixed_newlines")
        .when(alternate == expected, kind)
        .otherwise("rejected_hash_mismatch")
    )


def links(documents: DataFrame, pattern: str) -> DataFrame:
    """source_id, target of documents(node_id, text): what the pattern's first group finds, once."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))
    return documents.select(F.col("node_id").alias("source_id"), found.alias("target"))


def contamination(development: DataFrame, others: DataFrame) -> DataFrame:
    """kind, against, overlap, identifiers of identifiers(kind, identifier) and others(against, kind, identifier): how many
    stand on both sides."""
    both = development.select("kind", "identifier").distinct().join(others.select("against", "kind", "identifier").distinct(), ["kind", "identifier"])
    every = others.select("against", "kind").distinct()
    n = both.groupBy("against", "kind").agg(F.count("*").alias("overlap"))
    return every.join(n, ["against", "kind"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def normalised_query(q: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))


def coverage(rows: DataFrame, key: list[str], identifier: str) -> DataFrame:
    """Rows and distinct identifiers, empty ones aside, of each group."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(F.nullif(F.col(identifier), F.lit(""))).alias("n_distinct"))


def coverage_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """before, after, delta of each group of either; a missing one counts 0."""
    a, b = (x.select(*key, F.col(value).alias(n)) for x, n in ((before, "before"), (after, "after")))
    both = a.join(b, key, "full").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def rejected_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """reason, id of what keeps a corpus from being loaded: repeated ids or edges, and edges without an end."""
    name = F.concat_ws(">", "source_id", "target_id", "edge_type")
    again = nodes.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate_node").alias("reason"), F.col("node_id").alias("id"))
    twice = edges.groupBy("source_id", "target_id", "edge_type").count().where("count > 1").select(F.lit("duplicate_edge").alias("reason"), name.alias("id"))
    loose = [edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti").select(F.lit(f"dangling_{end}").alias("reason"), name.alias("id")) for end in ("source_id", "target_id")]
    return reduce(DataFrame.unionByName, [again, twice, *loose])


def forbidden_keys(payload: Column, names: list[str]) -> Column:
    """Whether a JSON text holds one of the keys, at any depth."""
    return F.regexp_like(payload, F.lit('"(?:' + "|".join(names) + r')"\s*:'))
