"""Column functions that check, name and identify: ids, addresses, payloads and private content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids: a letter or digit, then up to 199 more or one of . _ : / - (fixed values).
ID = r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,199}$"
#: Absolute paths, private keys and credentials, which results must not hold (fixed values).
PRIVATE = (r"(?:^|[\s\"'=(])(?:/(?:home|Users|root|tmp|var)/|[A-Za-z]:\\)", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?:ghp|gho|ghs|github_pat)_[A-Za-z0-9_]{16,}", r"AKIA[A-Z0-9]{16}", r"(?i)(?:password|passwd|secret|api_key)\s*[:=]\s*\S{8,}")


def contribution_id(*fields: Column) -> Column:
    """A digest of a contribution's fields, which a null character keeps apart."""
    return F.sha2(F.concat_ws("\0", *(x.cast("string") for x in fields)).cast("binary"), 256)


def payload_hash(*fields: Column) -> Column:
    """A digest of a request's fields as JSON, in the order of their names as they are given."""
    return F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256)


def simple_path(seed: Column, steps: Column) -> Column:
    """A path by its seed and its edges alone, without scores and weights."""
    return F.struct(seed.alias("seed_id"), F.transform(steps, lambda s: F.struct(s.source_id.alias("source_id"), s.target_id.alias("target_id"), s.edge_type.alias("edge_type"))).alias("steps"))


def bounded_text(text: Column, most: int) -> Column:
    """Whether a text has something other than white space, no more than most characters and no control characters but
    line ends and tabs."""
    return F.coalesce((F.length(text) <= most) & F.regexp_like(text, F.lit(r"\S")) & ~F.regexp_like(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")), F.lit(False))


def valid_id(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(ID)), F.lit(False))


def secure_url(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(r"^https://[^\s/?#@]+(?:[/?#]\S*)?$")), F.lit(False))


def private_content(payload: Column) -> Column:
    """Whether a text holds an absolute path, a private key or a credential."""
    return F.coalesce(F.regexp_like(payload, F.lit("|".join(f"(?:{p})" for p in PRIVATE))), F.lit(False))


def source_identity(url: Column) -> Column:
    """repository and path of the address of a file, an issue or a repository; null where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"^https://[^/]+/([^/]+/[^/?#]+)(?:/(?:blob|tree)/[^/]+/([^?#]+)|/((?:issues|pull|commit)/[^?#]+))?", i), F.lit(""))
    return F.struct(part(1).alias("repository"), F.coalesce(part(2), part(3)).alias("path"))


def first_mutation(quorum: int, evidence: Column) -> Column:
    """At which further event an edge first changes."""
    return F.greatest(F.lit(1), F.lit(quorum) - evidence)
