"""SQL text fragments (DuckDB dialect) that mirror the native column functions.

They exist so that every query has an independent oracle: the same result
computed by another engine straight from the parquet tables.
"""

from __future__ import annotations

from textkiln.constants import EOT, PIECE_PATTERN


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def u32(expr: str) -> str:
    """First 32 bits of md5(expr) as BIGINT (twin of ``hashing.seeded_u32``)."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def seeded_key(salt: str, *parts: str) -> str:
    return "concat_ws(':', " + ", ".join([lit(salt)] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"


def hashed_ids(text_expr: str) -> str:
    """Twin of ``functions.text.hashed_piece_ids``."""
    return (
        f"list_transform(regexp_extract_all(coalesce({text_expr}, ''), {lit(PIECE_PATTERN)}), "
        f"lambda p: ({u32('p')} % {EOT})::INTEGER)"
    )


def arr_md5(expr: str) -> str:
    return f"md5(array_to_string({expr}, ','))"


def pad(expr: str, length: int, value: int) -> str:
    return f"list_concat({expr}, list_transform(range(greatest({length} - len({expr}), 0)), lambda x: ({value})::INTEGER))"


def count_valid(labels: str) -> str:
    return f"len(list_filter(list_slice({labels}, 2, len({labels})), lambda x: x <> -100))"
