"""Canonical JSON files: one form of bytes for each value."""

from __future__ import annotations

import json
from pathlib import Path


def canonical_json(value: object) -> bytes:
    """Keys in order, two spaces of indent, one line end; the form is a fixed value, as digests depend on it."""
    return f"{json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)}\n".encode()


def read_canonical(path: str) -> dict:
    """The object in a file, if the file is its canonical form byte for byte."""
    raw = Path(path).read_bytes()
    try:
        value = json.loads(raw.decode())
    except ValueError as e:
        raise ValueError(f"no JSON in UTF-8: {path}") from e
    if not isinstance(value, dict) or canonical_json(value) != raw:
        raise ValueError(f"no canonical JSON object: {path}")
    return value


def write_canonical(path: str, value: dict) -> None:
    """Writes a file that must not be there yet."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("xb") as f:
        f.write(canonical_json(value))
