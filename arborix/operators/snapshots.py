"""Whether two versions of a table hold the same rows, and where they differ, without a sort of either.

A bucket's digest adds up, over its rows, four numbers of 60 bits from the SHA-256 of a row: it depends on no order, parts of
it can be merged, and rows that repeat count as often as they stand. So equality costs one aggregate with a row for each
bucket of each task, and only buckets that differ are read again to find the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a lane of the digest, and lanes.
DIGITS, LANES = 15, 4


def row_text(columns: Sequence[str]) -> Column:
    """A row as text that no other row shares: each value with its length in bytes before it, a null as a dash."""
    return F.concat_ws(",", *(F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, 1 + DIGITS * at, DIGITS), 16, 10)


def _bucketed(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    named = F.sha2(row_text(key).cast("binary"), 256)
    return df.withColumn("in_bucket", (_lane(named, 0).cast("long") % buckets).cast("int"))


def digests(df: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """in_bucket, n, digest of each bucket of the rows of df; a bucket is what the key hashes to. Null keys are a key like
    others; a table without rows has no buckets. No column may be named in_bucket."""
    h = F.sha2(row_text(df.columns).cast("binary"), 256)
    rows = _bucketed(df, key, buckets).select("in_bucket", h.alias("h"))
    sums = [F.sum(_lane(F.col("h"), i).cast("decimal(20,0)")).cast("string") for i in range(LANES)]
    return rows.groupBy("in_bucket").agg(F.count("*").alias("n"), F.concat_ws(":", *sums).alias("digest"))


def unequal(before: DataFrame, after: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """in_bucket, n_before, n_after of the buckets whose rows differ; none: the versions are equal."""
    a, b = digests(before, key, buckets), digests(after.select(*before.columns), key, buckets)
    both = a.select("in_bucket", F.col("n").alias("n_before"), F.col("digest").alias("was")).join(b.select("in_bucket", F.col("n").alias("n_after"), F.col("digest").alias("now")), "in_bucket", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("in_bucket", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def located(before: DataFrame, after: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """The rows that stand more often in one version, with side and copies (how many more), from unequal buckets alone."""
    where = F.broadcast(unequal(before, after, key, buckets).select("in_bucket"))  # a row for each bucket at most
    columns = before.columns
    one = lambda df, sign: _bucketed(df.select(*columns), key, buckets).join(where, "in_bucket", "left_semi").select(*columns, F.lit(sign).alias("sign"))
    more = one(before, -1).unionByName(one(after, 1)).groupBy(*columns).agg(F.sum("sign").alias("more")).where("more <> 0")
    return more.select(*columns, F.when(F.col("more") > 0, "after").otherwise("before").alias("side"), F.abs("more").alias("copies"))
