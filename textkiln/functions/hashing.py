"""Seeded, retry-stable hashing.

``rand()`` changes when a task is retried; every random-looking decision in
this library instead hashes ``salt:seed:epoch:id`` with md5, so a rerun (or a
lost executor) reproduces the same rows. The first 8 hex digits give an
unsigned 32-bit draw; DuckDB computes the same value with
``('0x' || substr(md5(s), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(salt: str, *parts) -> Column:
    cols = [F.lit(salt)] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def seeded_hash_hex(salt: str, *parts) -> Column:
    """md5 hex digest of ``salt:part1:part2:...``."""
    return F.md5(_key(salt, *parts))


def hex8_to_u32(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")


def seeded_u32(salt: str, *parts) -> Column:
    """Unsigned 32-bit draw in [0, 2^32)."""
    return hex8_to_u32(seeded_hash_hex(salt, *parts))


def uniform01(salt: str, *parts) -> Column:
    """Open-interval uniform draw ``(u32 + 0.5) / 2^32`` in (0, 1)."""
    return (seeded_u32(salt, *parts) + F.lit(0.5)) / F.lit(4294967296.0)
