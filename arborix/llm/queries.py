"""The operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, fingerprint, jaccard, lines, merkle, packing, quality, secrets, suffixes, tokens, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoding_digests(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_secret_scans, op3_toxicity, op4_suffix_array_dedup, op5_exact_top_k,
        op6_bpe_codec, op7_packing, op8_token_counts, op9_ngram_jaccard, op10_quality_classifier,
        op11_line_dedup, op12_vector_codes, op13_merkle_manifest,
    )
}



def _code_rounds() -> str:
    """Two rounds of Lloyd's rule and the last assignment: near0 and book1, near1 and book2, near2."""
    near = """near{k} AS (
  SELECT row, dims, part, any_value(x) AS x, min(to_entry.d) AS error, arg_min(entry, to_entry) AS code
  FROM (SELECT p.row, p.dims, p.part, p.x, b.entry,
          struct_pack(d := CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT), e := b.entry) AS to_entry
        FROM parts p JOIN book{k} b USING (dims, part))
  GROUP BY row, dims, part
)"""
    book = """moved{n} AS (
  SELECT dims, part, code AS entry, i, CAST(floor(sum(x[i])::DECIMAL(38, 0) / count(*)) AS BIGINT) AS v
  FROM near{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY dims, part, code, i
), book{n} AS (
  SELECT b.dims, b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (SELECT dims, part, entry, list(v ORDER BY i) AS x FROM moved{n} GROUP BY ALL) m USING (dims, part, entry)
)"""
    return ",\n".join(f.format(k=k, n=k + 1) for k in (0, 1) for f in (near, book)) + ",\n" + near.format(k=2)


#: Levels that the SQL of op13 goes up, in a source and above the sources: up to 16 ** 6 nodes.
UP = range(6)


def _merkle_levels(name: str, first: str) -> str:
    """Levels above the nodes of ``first`` (tree, pos, h), in runs of 16 up to one node a tree; and, for each of those
    nodes, what stands before and after it on each level, and whether the level has other nodes at all."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({first}))"]
    for k in UP:
        out.append(f"""{name}{k + 1} AS (
  SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
    FROM {name}{k} GROUP BY tree, pos // 16)
), {name}_beside{k} AS (
  SELECT o.tree, o.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < o.pos // {16**k}), '') AS {name}b{k},
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > o.pos // {16**k}), '') AS {name}a{k}, any_value(s.n) > 1 AS {name}on{k}
  FROM {name}0 o JOIN {name}{k} s ON s.tree = o.tree AND s.pos // 16 = o.pos // {16 ** (k + 1)} GROUP BY o.tree, o.pos
)""")
    joins = " ".join(f"JOIN {name}_beside{k} USING (tree, pos)" for k in UP)
    return ",\n".join(out) + f",\n{name}_beside AS (SELECT * EXCLUDE (h, n) FROM {name}0 {joins})"


def _merkle_folds() -> str:
    """fold12: the digest of what is at hand, with what stands beside it level by level."""
    steps = [(x, k) for x in "dr" for k in UP]
    return ",\n".join(f"fold{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN {x}on{k} THEN sha256({x}b{k} || f || {x}a{k}) ELSE f END AS f FROM fold{i})" for i, (x, k) in enumerate(steps))


#: What SQL can express; the others are tested against brute force, round trips or held-out labels in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
    "op11_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nr FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, often.last IS NOT NULL AND k.doc_id < often.last AS gone FROM k LEFT JOIN often USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
""",
    "op12_vector_codes": f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, len(embedding) AS dims,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT row, vec_id, dims, part, e[part * (dims // 16) + 1 : (part + 1) * (dims // 16)] AS x
  FROM v, LATERAL (SELECT unnest(range(16)) AS part)
), book0 AS (
  SELECT dims, part, entry, x FROM (SELECT *, row_number() OVER (PARTITION BY dims, part ORDER BY vec_id) - 1 AS entry FROM parts) WHERE entry < 64
), {_code_rounds()},
digests AS (
  SELECT dims, sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2 GROUP BY dims
), coded AS (
  SELECT row, dims, string_agg(printf('%02x', CAST(code AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near2 GROUP BY row, dims
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (row) JOIN digests ON digests.dims = coded.dims
""",
    "op13_merkle_manifest": f"""
WITH items AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, crc % 5 = 0 AS hit,
    sha256(head || coalesce(strlen(lower_text) || ':' || lower_text, '-')) AS changed
  FROM items
), placed AS (
  SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), {_merkle_levels("d", "SELECT tree, pos, leaf AS h FROM placed")},
sources AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM d6),
{_merkle_levels("r", "SELECT 'root' AS tree, pos, subroot AS h FROM sources")},
fold0 AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT any_value(h) FROM r6) AS root, CASE WHEN p.hit THEN p.changed ELSE p.leaf END AS f,
    d.* EXCLUDE (tree, pos), r.* EXCLUDE (tree, pos)
  FROM placed p JOIN d_beside d ON d.tree = p.tree AND d.pos = p.pos JOIN sources s ON s.tree = p.tree JOIN r_beside r ON r.pos = s.pos
), {_merkle_folds()}
SELECT doc_id, leaf, subroot, root, sha256(concat({", ".join(f"{x}b{k}, {x}a{k}" for x in "dr" for k in UP)})) AS proof_sha256, f AS folded_root, f = root AS verified
FROM fold12
""",
}
