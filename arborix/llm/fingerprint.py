"""Canonical exact digests of documents, by DataFrame functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, then each run of white space as one space and none at the ends.

    Spark has no function for Unicode normalisation; ``java_method`` calls the one of ICU, which Spark ships."""
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\x85\p{Z}]+", " "))


def wide_hash(text: Column) -> tuple[Column, Column]:
    """Two xxhash64 of the same bytes, the second under another seed (the hash of a constant seeds the next column's)."""
    return F.xxhash64(text), F.xxhash64(F.lit("second seed"), text)


def _hex(a: Column, b: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (a, b))))


def _block_of(key: Column, bounds: list[int]) -> Column:
    """blk, the index of the last bound <= key, and whether the key is that bound; looked up in two levels, so the cost
    is the root of the number of blocks."""
    size = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    g = F.greatest(F.size(F.filter(array([x[0] for x in groups]), lambda x: x <= key)), F.lit(1))
    inner = F.element_at(F.array(*(array(x) for x in groups)), g)
    within = F.filter(inner, lambda x: x <= key)
    return F.struct(F.greatest((g - 1) * size + F.size(within) - 1, F.lit(0)).cast("int").alias("blk"), F.coalesce(F.try_element_at(within, F.lit(-1)) == key, F.lit(False)).alias("first"))


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, h1 and h2 (hashes of the canonical text), the same of the next document (next_text, n1, n2), where
    the row stands (blk, pos) and whether it is the last of its block (ends); and the number of blocks. Order: doc_id,
    then text; after the last comes the first. Null doc_ids come first.

    The ids are cut into blocks at quantiles. Blocks and rows of a block both grow with the root of the rows: at 5e10
    documents the driver holds some 220,000 bounds, and a block as many rows, which the window sorts and spills. Each
    block also gets a copy of the first rows of the next, so the window needs one shuffle by block and no global sort."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    docs = documents(docs)
    rows = docs.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), isqrt(rows), 1)
    found = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(0.5)), F.lit(4 * n)).alias("q")).first()
    bounds = sorted({found["least"], *found["q"]}) if rows else [0]
    last = len(bounds) - 1
    h1, h2 = wide_hash(F.col("canon"))
    docs = docs.withColumn("canon", canonical(F.col("text"))).withColumns({"h1": h1, "h2": h2}).drop("canon").withColumn("own", _block_of(key, bounds))
    at = lambda b, later: F.struct(b.alias("blk"), F.lit(later).alias("later"))
    own, first = F.col("own.blk"), F.col("own.first")
    before = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    placed = docs.select("doc_id", "text", "h1", "h2", F.explode(F.when(first, F.array(at(own, False), at(before, True))).otherwise(F.array(at(own, False)))).alias("at")).select("doc_id", "text", "h1", "h2", "at.*")
    w = Window.partitionBy("blk").orderBy("later", F.col("doc_id").asc_nulls_first(), "text")
    following = placed.select("*", F.row_number().over(w).alias("pos"), F.lead("text").over(w).alias("next_text"), F.lead("h1").over(w).alias("n1"), F.lead("h2").over(w).alias("n2"), F.lead("later").over(w).alias("ends"))
    return following.where(~F.col("later")).drop("later"), last + 1


def _bits(marks: DataFrame) -> DataFrame:
    """blk and marked, the marks of each block as bitmaps of 32,768 bits, in order; a block needs few of them."""
    one = marks.groupBy("blk", F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    return one.groupBy("blk").agg(F.collect_list(F.struct("bucket", "bits")).alias("marked"))


def _has_bit(mark: Column) -> Column:
    """Whether a mark stands in marked; the cost doesn't depend on how many marks there are in its bitmap."""
    place = F.bitmap_bit_position(mark)
    own = F.get(F.filter("marked", lambda x: x["bucket"] == F.bitmap_bucket_number(mark)), 0)["bits"]
    byte = F.conv(F.hex(F.substring(own, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, that of its edited text, and how these and the next document's agree.

    A fingerprint is 32 hex digits of two xxhash64 over the canonical text. Within an equal hash the canonical texts
    are compared byte by byte, and the second and further distinct ones get a suffix ``-1``, ``-2``... (ordered by
    text), so fingerprints are equal exactly if canonical texts are.

    The texts are shuffled once, by block. All else that is shuffled are hashes, and the texts of rows whose hash
    occurs twice, folded into one row per distinct text by each task; the marks on such rows come back as bitmaps of
    each block, to where the block's texts lie. Suffixes come back as a list, which is empty but for clashes of 128 bits.

    Null texts are empty texts. Null doc_ids come first in order; rows that share a doc_id are ordered by text. One
    row alone is its own next. An empty table gives no rows; other columns are not read. Texts differ or agree as a
    whole, so near_edited and near_next are 0 or 1."""
    base, n_blocks = in_order(docs)
    n, q = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    base = base.withColumn("edited", F.concat(F.left(F.col("text"), n - q), F.left(F.col("next_text"), q)))
    base = base.withColumn("edited_canon", canonical(F.col("edited")))
    e1, e2 = wide_hash(F.col("edited_canon"))
    base = base.withColumns({"e1": e1, "e2": e2})
    row = base.select("blk", F.explode(F.array(*(F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"), (F.col("pos") * 2 + s).alias("mark")) for s, (a, b) in enumerate((("h1", "h2"), ("e1", "e2")))))).alias("x")).select("blk", "x.*")
    shared = row.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    marked = _bits(row.join(shared, ["h1", "h2"]))
    pick = lambda s, canon, a, b: F.when(_has_bit(F.col("pos") * 2 + s), F.struct(F.lit(s).alias("side"), F.col(a).alias("h1"), F.col(b).alias("h2"), canon.alias("canon")))
    texts = base.join(marked, "blk").select("blk", "pos", F.explode(F.filter(F.array(pick(0, canonical(F.col("text")), "h1", "h2"), pick(1, F.col("edited_canon"), "e1", "e2")), lambda x: x.isNotNull())).alias("x")).select("blk", "pos", "x.*")
    # Byte comparison: copies fold into one row in each task; what is left is a row for each distinct text.
    distinct = texts.groupBy("h1", "h2", "canon").agg(F.count("*").alias("c"))
    clash = distinct.groupBy("h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1").select("h1", "h2")
    numbered = distinct.join(clash, ["h1", "h2"]).withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1).where("k > 0").select("h1", "h2", "canon", "k")
    # A suffix serves its own row and, as that of the next document, the row before (pos 0: the last of its block).
    entry = lambda b, p, what: F.struct(b.alias("blk"), p.alias("pos"), F.lit(what).alias("what"), F.col("k"))
    b, p = F.col("blk"), F.col("pos")
    before = F.when(p > 1, b).when(b == 0, F.lit(n_blocks - 1)).otherwise(b - 1)
    suffix = texts.join(numbered, ["h1", "h2", "canon"]).select(F.explode(F.when(F.col("side") == 0, F.array(entry(b, p, 0), entry(before, p - 1, 2))).otherwise(F.array(entry(b, p, 1)))).alias("x")).select("x.*")
    suffix = suffix.groupBy("blk").agg(F.collect_list(F.struct("pos", "what", "k")).alias("suffixes"))
    out = base.select("doc_id", "blk", "pos", "ends", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "h1", "h2", "e1", "e2", "n1", "n2").join(suffix, "blk", "left")

    def named(a: str, b: str, what: int) -> Column:
        at = F.when(F.col("ends"), F.lit(0)).otherwise(F.col("pos")) if what == 2 else F.col("pos")
        k = F.filter("suffixes", lambda x: (x["what"] == what) & (x["pos"] == at))
        return F.concat(_hex(F.col(a), F.col(b)), F.when(F.size(k) > 0, F.concat(F.lit("-"), F.get(k, 0)["k"].cast("string"))).otherwise(""))

    out = out.select("doc_id", "n_chars", "edited_sha256", named("h1", "h2", 0).alias("fingerprint"), named("e1", "e2", 1).alias("edited_fingerprint"), named("n1", "n2", 2).alias("next_fingerprint"))
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
