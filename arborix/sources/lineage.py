"""Cuts the lineage of iterative plans, in the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, tasks: int = 0) -> DataFrame:
    """The same rows, written to spark.checkpoint.dir, which executors share and which outlives any of them, as compressed
    columns, of which later steps read what they need. A session that names no folder must run on one machine, as in tests,
    and gets a temporary one.

    tasks: a shuffle is cut into so many, or into as many as the session says, if these are more. Names and paths are a small
    part, when shuffled, of what they take in memory, so Spark would put too many into one task; and a few keys that lead to
    few rows would be few tasks, were those rows not sent to all."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    put = {"spark.sql.shuffle.partitions": str(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0"} if tasks else {}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(folder)


def dealt(keys: Sequence[str], first: DataFrame, *parts: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows of all parts, cut, in buckets of the keys: joins and groups on these find them so, and don't shuffle them
    again. And the same rows without their buckets, for unions: Spark 4.1 takes a union of tables in buckets for dealt, and
    may yet read them in other portions, so that groups fall apart. Later parts may depend on what lies there before them."""
    spark = first.sparkSession
    folder, name = _folder(spark), f"cut_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i, part in enumerate((lambda _: first, *parts)):
        part(spark.read.schema(first.schema).parquet(folder) if i else first).select(first.columns).write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(n, *keys).mode("append").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as they lie in a folder of their own
    return out, spark.read.schema(out.schema).parquet(folder)
