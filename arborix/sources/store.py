"""Versioned tables of Parquet, and readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIXTURE = """schema_version int,
nodes array<struct<node_id:string,text:string,confidence:double,metadata:map<string,string>>>,
edges array<struct<source_id:string,target_id:string,edge_type:string,weight:double,factuality:double,metadata:map<string,string>>>"""
SNAPSHOT = "schema_version int, repository string, commit string, documents array<struct<path:string,blob_sha:string,content:string,source_url:string>>"


def fixture(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON files; others than the known version raise when they are read."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    fine = raw.where(F.assert_true(F.col("schema_version").eqNullSafe(F.lit(version)), F.lit("unknown schema version")).isNull())
    return fine.select(F.inline("nodes")).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))), fine.select(F.inline("edges"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """node_id, path, blob_sha, text of pinned snapshots; addresses that don't pin repository, commit and path raise."""
    d = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select("repository", "commit", F.inline("documents"))
    pinned = F.concat(F.lit("https://github.com/"), "repository", F.lit("/blob/"), "commit", F.lit("/"), "path")
    d = d.where(F.assert_true(F.col("source_url").eqNullSafe(pinned), F.lit("source_url must pin repository, commit and path")).isNull())
    return d.select(F.concat_ws(":", F.lit("github"), "repository", "path").alias("node_id"), "path", "blob_sha", F.concat_ws("\n\n", "path", "content").alias("text"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """node_id (the file's name), text of whole files."""
    raw = spark.read.text(f"{folder}/*.md", wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("node_id"), F.col("value").alias("text"))


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with the last change (by seq) of each key in place of its row; columns that a change leaves null stay."""
    rest = [c for c in table.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("new"))
    both = table.withColumn("old", F.struct(*rest)).select(*key, "old").join(last, key, "full")
    return both.select(*key, *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in rest))


def publish(df: DataFrame, folder: str, version: int) -> None:
    """A version is written once, and complete with its _SUCCESS file; to overwrite one is an error."""
    df.write.mode("errorifexists").parquet(f"{folder}/v={version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, the last complete one if none is named: readers keep theirs while others write."""
    return spark.read.parquet(f"{folder}/v={versions(spark, folder)[-1] if version is None else version}")


def fingerprint(df: DataFrame, key: list[str]) -> DataFrame:
    """n_rows, digest of a table, whatever the order of its rows: digests of rows, added up in four parts."""
    row = F.sha2(F.to_json(F.struct(*key, *sorted(c for c in df.columns if c not in key))), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *(part(i) for i in range(4))), 256).alias("digest"))


def latest(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return events.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")
