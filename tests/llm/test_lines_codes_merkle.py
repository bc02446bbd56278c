import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import codes, lines, merkle
from arborix.llm.common import joined

from . import brute

FOLDER = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
NULLS = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)


def same(got, want):
    return sorted(map(NULLS, map(tuple, got))) == sorted(map(NULLS, want))


# Line dedup


@pytest.fixture(scope="module")
def texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    long = "a line that many documents hold, word for word"
    for i in range(60):  # in each document, once or more often, with other white space and cases
        some = [rng.choice([long, long.upper(), f"\t {long}\r", "short", "", f"its own line with the number {i} and some more", "é" * 39, "É" * 40, "é" * 40]) for _ in range(rng.randrange(6))]
        rows.append((10_000 + rng.randrange(50), "\n".join(some)))
    rows += [(None, long), (None, long), (None, None), (20_000, ""), (20_001, None), (20_002, "\n"), (20_003, "x" * 300_000 + "\n" + long), (20_003, "x" * 300_000 + "\n" + long)]
    return rows


def test_line_dedup(spark, texts):
    df = spark.createDataFrame([(*r, "x", 7, True) for r in texts], "doc_id long, text string, digests string, hash int, late boolean").repartition(5)
    want = brute.cut_lines(texts)
    assert same(lines.cut_lines(df).collect(), want)
    assert same(lines.line_dedup(df).collect(), [(d, n, k, SHA(t)) for d, t, n, k in want])
    assert any(k for _, _, _, k in want) and any(k for d, _, _, k in want if d is None)


def test_line_dedup_of_few_documents_and_ties(spark):
    line = "b" * 40
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in lines.cut_lines(make([(i % 4, line) for i in range(20)])).collect()} == {0}  # four documents of five rows
    got = lines.cut_lines(make([(i % 5, f"{line}\n{line}\nz") for i in range(20)])).collect()
    assert {(r.doc_id, r.text, r.n_dropped) for r in got} == {(4, f"{line}\n{line}\nz", 0), *((i, "z", 2) for i in range(4))} and len(got) == 20
    got = lines.cut_lines(make([(i, line) for i in range(5)])).collect()
    assert sorted((r.doc_id, r.text, r.n_lines) for r in got) == [*((i, "", 1) for i in range(4)), (4, line, 1)]
    assert lines.line_dedup(make([])).count() == 0


def test_packs_and_shards_of_any_size_find_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(lines, "PACK", 7)
    monkeypatch.setattr(lines, "SHARD", 50)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert same(lines.cut_lines(df).collect(), brute.cut_lines(texts))


def test_filters_suspect_all_repeats_and_few_others():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 2**64, (60_000, 2), np.uint64)
    digests[40_000:50_000] = digests[:10_000]
    many = np.zeros(len(digests), bool)
    many[20_000:20_100] = True
    found = lines.suspects(digests, many)
    assert found[:10_000].all() and found[40_000:50_000].all() and found[20_000:20_100].all()
    assert found[10_000:40_000].sum() + found[50_000:].sum() < 0.01 * len(digests)


def test_joined_looks_up_hot_keys_by_broadcast(spark):
    left = spark.range(3_000).select(F.when(F.col("id") < 1_000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = joined(left, right, ["k"], "n", share=10)
    assert got.count() == 3_000 and got.where("k = 0 AND top = 999").count() == 1_000 and got.columns == ["k", "id", "top"]


# Codes of vectors


def test_vector_codes(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.11, rng.gauss(0, 0.2)]) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(i, rows[5][1], 1) for i in range(300, 420)]  # copies
    rows += [(7, rows[9][1], 3), (None, rows[10][1], None), (None, [5e3] * 32, 4)]
    bad = [(500, None, 1), (501, [], 1), (502, [None] + [0.0] * 31, 1), (503, [float("nan")] * 32, 1), (504, [float("inf")] * 32, None), (505, [0.5] * 17, 1)]
    df = spark.createDataFrame([(a, v, b, 1, "x") for a, v, b in rows + bad], "vec_id long, embedding array<double>, label int, row int, code string").repartition(5)
    found, sha = brute.codes(rows)
    want = [(r[0], *f, sha) for r, f in zip(rows, found, strict=True)]
    assert same(codes.vector_codes(df).collect(), want)
    codec = codes.Codec(df)
    assert codec.distinct.count() < 16 * 300
    got = codec.decoded(codec.coded()).select("error", "embedding", "vec_id").where("vec_id = 7").collect()
    assert all(len(r.embedding) == 32 for r in got)


def test_vector_codes_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert codes.vector_codes(make([])).count() == codes.vector_codes(make([(1, None, 1)])).count() == 0
    one = codes.vector_codes(make([(1, [0.1] * 16, 1)])).collect()
    assert (one[0].code, one[0].error, one[0].label_error) == ("00" * 16, 0, 0)
    sizes = codes.vector_codes(make([(i, [i / 9.0] * (16 if i % 2 else 48), None) for i in range(200)])).collect()
    assert len(sizes) == 200 and len({r.codebooks_sha256 for r in sizes}) == 2 and len({r.label_error for r in sizes}) == 1
    large = [(i, [float(i % 70) * 2.0**33] * 16, 1) for i in range(140)]  # beyond what float64 sums exactly
    found, sha = brute.codes(large[:70])
    with pytest.raises(Exception, match="(?i)overflow|too large|long|int64"):
        codes.vector_codes(make(large)).collect()
    wide = [(i, [float(i % 70) * 2.0**17] * 16, 1) for i in range(140)]
    found, sha = brute.codes(wide)
    assert same(codes.vector_codes(make(wide)).collect(), [(r[0], *f, sha) for r, f in zip(wide, found, strict=True)])


# Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [(1_000 + i, "big", "en", i, f"Text {i}") for i in range(4_500)]  # two blocks, the second one short
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, None, "x", 1, "É Ab"), (5, "", "", 0, ""), (6, "alone", None, None, "A" * 400_000), (1_001, "big", "en", 1, "Text 1"), (1_001, "big", "en", 1, "other")]
    rows += [(i, f"s{i}", "d", 1, "Z") for i in range(270)]  # more sources than two levels hold
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", pos int, leaf string").repartition(6)
    want = brute.manifest(rows)
    got = merkle.manifest(df).collect()
    assert same(got, want) and len({r.root for r in got}) == 1
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    (got,) = merkle.manifest(spark.createDataFrame([(1, "a", None, 2, "x")], DOCS)).collect()
    assert got.leaf == got.subroot == got.root == SHA("1:11:a-1:21:x") and got.proof_sha256 == SHA("") and got.verified


def test_proofs_lead_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # blocks of 16 leaves: many rounds
    rows = [(i, "ab"[i % 3 == 0], "en", 1, f"T{i}") for i in range(700)]
    df = spark.createDataFrame(rows, DOCS)
    assert same(merkle.manifest(df).collect(), brute.manifest(rows))
    for r in merkle.proofs(df).collect():
        assert merkle.fold(r.leaf.encode(), [x.encode() for x in r.path]).decode() == r.root


@pytest.mark.parametrize("n, block, want", [(1, 0, 0), (2, 0, 1), (16, 0, 1), (17, 0, 2), (4096, 0, 3), (1, 3, 3), (300, 1, 3)])
def test_height(n, block, want):
    assert merkle.height(n, block) == want
