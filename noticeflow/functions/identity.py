"""Identity expressions: content hashes, short ids and identity keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, present


def business_hash(*columns: Column | str) -> Column:
    """SHA-256 of the cleaned columns, joined by bars; null counts as empty, so no column drops out."""
    return F.sha2(F.concat_ws("|", *[clean(c) for c in columns]), 256)


def short_id(c: Column) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(F.coalesce(c, F.lit(""))), 1, 16)


def identity_key(*choices: Sequence[Column | str]) -> Column:
    """The first choice whose first column is present, as text ``choice:part|part``; null if none is."""
    out = F.lit(None).cast("string")
    for n in reversed(range(len(choices))):
        parts = [present(c) for c in choices[n]]
        out = F.when(parts[0] != "", F.concat(F.lit(f"{n}:"), F.concat_ws("|", *parts))).otherwise(out)
    return out


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns as JSON in the order of their names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(settings: object) -> str:
    """SHA-256 of settings as JSON with sorted keys, for checkpoints and manifests (driver side)."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def seeded_order(key: Column | str, seed: int) -> Column:
    """A repeatable shuffled order of keys."""
    return F.xxhash64(F.lit(seed), key)
