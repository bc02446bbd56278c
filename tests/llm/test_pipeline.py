import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from arborix.llm import packing, quality

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality.quality(before, labels).where("predicted = 1").collect()}
    assert set(texts(after)) == good
    before, after = seen["ngram_jaccard_join"]
    want = {d for d, (_, c) in brute.similar(list(texts(before).items())).items() if d == c}
    assert set(texts(after)) == want
    before, after = seen["suffix_array_dedup"]
    cut = brute.repeats(list(texts(before).items()))
    assert {d: len(t.encode()) < cut[d][0] for d, t in texts(after).items()} == {d: x[1] > 1 for d, x in cut.items()}
    before, after = seen["secret_scans"]
    held = {d for d, t in texts(before).items() if brute.base_spans(t)}
    assert held <= {d for d, t in texts(after).items() if "[SECRET]" in t}
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == set(texts(before))


def odd_table(spark):
    """Null, repeated and clashing: texts, ids, copies of whole rows, and columns named as the stages name their own."""
    rng = random.Random(8)
    prose = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "doc_id").orderBy("doc_id").limit(12).collect()]
    long = "".join(rng.choices("abcdefghij", k=300_000))
    rows = [(i, t) for i, t in enumerate(prose)] + [(3, prose[3]), (3, prose[4]), (None, prose[5]), (None, None), (50, None), (51, ""), (52, long), (53, prose[6] + " " + prose[7]), (54, f"key {'wJalrXUtnFEMIK7MDENGbPxRfiCYzEXk8Fq2zL'} end")]
    names = ("kept_id", "is_null", "carried_0", "kept", "node", "own_node", "part", "blk", "score", "predicted", "y", "ids", "laid", "length")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")).alias("n_chars"), *(F.lit(7).alias(n) for n in names)).repartition(3)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = odd_table(spark)
    rows = sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    out = stage(spark, docs, FOLDER)
    got = out.collect()
    if name == "packing":
        assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got) and sum(r.start == 0 for r in got) == len(rows)
        return
    assert out.dtypes == docs.dtypes and all(r.is_null == r.kept == r.node == r.score == 7 for r in got)
    assert all(r.n_chars == len(r.text or "") for r in got)
    after = sorted((str(r.doc_id), str(r.text)) for r in got)
    if name == "ngram_jaccard_join":
        assert len(after) < len(rows) and set(after) <= set(rows) and ("50", "None") in after and ("None", prose_of(rows, "5")) not in after
    if name in ("suffix_array_dedup", "secret_scans"):
        assert [d for d, _ in after] == [d for d, _ in rows]
        assert {d for d, t in after if t == "None"} == {"None", "50"}
    if name == "secret_scans":
        assert ("54", "key [SECRET] end") in after
    if name == "quality_classifier":
        assert set(after) <= set(rows)


def prose_of(rows, doc):
    return dict(rows)[doc]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_empty_tables(spark, number):
    docs = odd_table(spark).where("false")
    out = corpus_pipeline.STAGES[number][1](spark, docs, FOLDER)
    assert out.count() == 0 and (number == 4 or out.dtypes == docs.dtypes)


def test_run(spark):
    """The whole pipeline, each stage written and reread: what its stages give one by one."""
    got = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER).cache()
    want = packing.packed(docs)
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert key(got) == key(want) and packing.padding(got).first().ids == packing.padding(want).first().ids
