"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a Python stage turns into objects at a time.
SLICE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; if that is unset, a folder of
    this process's own, as in tests on one machine; on a cluster that fails."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            return checkpoint.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arborix-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage: a lost executor then
    costs a read and no recomputation. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arborix-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text only, a null text as the empty one; columns of other names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def by_batch(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """mapInArrow with plain lists: work gets an iterator of ``{column: list}`` of at most SLICE rows each, for one
    task, and yields ``{column: list or array}`` of any length."""
    fields = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict]:
            for b in batches:
                for i in range(0, b.num_rows, SLICE):
                    part = b.slice(i, SLICE)
                    yield dict(zip(part.schema.names, (c.to_pylist() for c in part.columns), strict=True))

        for out in work(parts()):
            yield pa.record_batch([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")])


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, mod parts; -1 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def blocks(spark: SparkSession, rows: int, each: int) -> int:
    """A number of buckets that grows with the rows: about ``each`` rows in a bucket, one for each shuffle partition
    at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // each, 1)


def joined(left: DataFrame, right: DataFrame, keys: list[str], weight: str, share: int = 1_000) -> DataFrame:
    """The inner join of left with right, whose keys are distinct and not null and whose column weight holds the number of
    rows of left that they meet; that column goes. Keys that meet one of share rows or more, of which there are share at
    most, are looked up in a broadcast, so a hot key stays where it is; the others are shuffled. Both sides are read
    twice: give tables."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share >= total
    heavy, light = F.broadcast(right.where(hot).drop(weight)), right.where(~hot).drop(weight)
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(heavy, keys).unionByName(rest.join(light, keys))
