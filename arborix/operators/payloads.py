"""JSON payloads walked by depth: keys and values apart, so a forbidden word as a value is none as a key.

Payloads are VARIANT values. Each depth is one step that opens the objects and arrays of the depth before, for all payloads
at once, and is cut there; the walk ends with the deepest payload. No payload is a Python object."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut

#: What stands in each row of a level: place is the positions from the root, as text; up is the place of the parent.
LEVEL = ("id", "place", "up", "pos", "key", "kind", "v")


def _level(df: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
    return cut(df.withColumn("kind", kind).select(*LEVEL))


def levels(rows: DataFrame) -> list[DataFrame]:
    """The values of rows(id, payload), a table for each depth, from the payloads themselves on. An id stands for one row.

    Texts that are no JSON, nulls, and objects in which a key repeats have no values. Keys of an object come in their
    order as text, positions count from 0."""
    spark = rows.sparkSession
    root = rows.select("id", F.lit("$").alias("place"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.try_parse_json("payload").alias("v"))
    out = [_level(root.where("v is not null"))]
    while True:
        open_ = out[-1].where(F.col("kind").isin("object", "array")).select("id", F.col("place").alias("up"), "v")
        if open_.isEmpty():
            return out
        kids = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", "up", "pos", "key", F.col("value").alias("v"))
        out.append(_level(kids.withColumn("place", F.concat_ws(".", "up", F.col("pos").cast("string")))))


def forbidden_keys(found: Sequence[DataFrame], names: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """id, depth, key of each key of the levels that is one of names, or holds one of parts, in either case."""
    key = F.lower("key")
    bad = reduce(Column.__or__, [key.contains(p.lower()) for p in parts], key.isin(*(n.lower() for n in names)))
    return reduce(DataFrame.unionByName, [x.where(F.col("key").isNotNull() & bad).select("id", F.lit(d).alias("depth"), "key") for d, x in enumerate(found)])


def quoted(text: Column) -> Column:
    """A string as JSON: the only entry of an array, without its brackets."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def changed_strings(found: Sequence[DataFrame], change: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """id, payload, n of the payloads of the levels: each string value as change gives it, and how often it did, summed;
    keys stay. Payloads are written anew without spaces, from the deepest level up: a container is the texts of what it holds."""
    below = None
    for level in reversed(found):
        text, n = change(F.variant_get("v", "$", "string"))
        own, holder = F.col("kind") == "string", F.col("kind").isin("object", "array")
        rows = level.withColumns({"text": F.when(own, quoted(text)).when(~holder, F.coalesce(F.col("v").cast("string"), F.lit("null"))), "n": F.when(own, n).otherwise(0).cast("long")})
        if below is not None:
            rows = rows.join(below, (rows["id"] == below["of"]) & (rows["place"] == below["holder"]), "left")
            rows = rows.withColumn("n", F.col("n") + F.coalesce("n_below", F.lit(0)))
        inner = F.coalesce("inner", F.lit("")) if below is not None else F.lit("")
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("text"))
        rows = rows.select("id", "up", "pos", "key", whole.alias("text"), "n")
        if level is found[0]:
            return rows.select("id", F.col("text").alias("payload"), "n")
        name = rows.withColumn("piece", F.when(F.col("key").isNotNull(), F.concat(quoted(F.col("key")), F.lit(":"), "text")).otherwise(F.col("text")))
        held = name.groupBy(F.col("id").alias("of"), F.col("up").alias("holder")).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("x"), F.sum("n").alias("n_below"))
        below = cut(held.select("of", "holder", F.concat_ws(",", "x.piece").alias("inner"), "n_below"))
    raise ValueError("no levels")
