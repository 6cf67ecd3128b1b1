"""Pre-tokenizing text natively (no Python) and the hashed-piece id map.

``pretokenize`` is the first stage of byte-level BPE: the regex split. It runs
as ``regexp_extract_all`` inside whole-stage codegen. ``hashed_piece_ids`` maps
each piece to an id in ``[0, EOT)`` with md5; it is an exact, SQL-reproducible
stand-in tokenizer, so every operator downstream of tokenizing can be checked
against DuckDB. Real BPE ids come from ``textkiln.operators.tokens``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkiln.constants import EOT, PIECE_PATTERN
from textkiln.functions.hashing import hex8_to_u32


def pretokenize(text: Column, pattern: str = PIECE_PATTERN) -> Column:
    """ARRAY<STRING> of pre-tokens; NULL text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def hashed_piece_ids(text: Column, pattern: str = PIECE_PATTERN, buckets: int = EOT) -> Column:
    """ARRAY<INT>: one id per pre-token, ``u32(md5(piece)) mod buckets``."""
    return F.transform(
        pretokenize(text, pattern),
        lambda p: F.pmod(hex8_to_u32(F.md5(p)), F.lit(buckets)).cast("int"),
    )
