"""Tokenizing corpora: byte-level BPE through an Arrow UDF, and token statistics.

The BPE encoder is built once per Python worker from the installed rank file
(shipped by path, never through the task closure) and applied per Arrow batch.
Special strings in the text are ordinary text, as with ``encode_ordinary``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.constants import BPE_PATTERN, EOT
from textkiln.functions.text import hashed_piece_ids

_ENCODER = None


def rank_file() -> str:
    try:
        import public_tokenizers
    except ImportError as e:  # pragma: no cover - depends on the image
        raise RuntimeError("byte-level BPE rank file not installed") from e
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder():
    """The byte-level BPE encoding, cached per process."""
    global _ENCODER
    if _ENCODER is None:
        import tiktoken

        with open(rank_file(), "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in (ln.split() for ln in fh if ln.strip())}
        _ENCODER = tiktoken.Encoding("byte_bpe_50k", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER


#: Bytes of text whose tokens leave a worker in one batch.
ENCODE_BYTES = 1 << 20


def _encoded(texts: pa.Array) -> pa.ListArray:
    """Token ids of a batch of texts as one flat int32 buffer: no id is a Python object
    for longer than its text is encoded. A null text has no tokens."""
    enc = encoder()
    ids = [np.array(enc.encode_ordinary(t.as_py()), np.int32) if t.is_valid else np.zeros(0, np.int32) for t in texts]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def bpe_encode_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _encoded(texts)


EOT_TEXT = "<|endoftext|>"


@F.arrow_udf(T.StringType())
def bpe_decode_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    enc = encoder()

    def dec(ids: np.ndarray) -> str:
        cuts = np.flatnonzero(ids == EOT)
        return EOT_TEXT.join(enc.decode(run[run != EOT].tolist()) for run in np.split(ids, cuts))

    for lists in batches:
        yield pa.array([dec(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in lists], pa.string())


def encode(text: Column, tokenizer: str = "bpe") -> Column:
    """Token ids of ``text``: ``bpe`` (the real vocabulary) or ``hashed`` (native, SQL-checkable)."""
    if tokenizer == "bpe":
        return bpe_encode_udf(text)
    if tokenizer == "hashed":
        return hashed_piece_ids(text)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def decode(ids: Column) -> Column:
    return bpe_decode_udf(ids)


def _encode_batches(text_col: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            upto = np.cumsum([t.as_buffer().size if t.is_valid else 0 for t in texts], dtype=np.int64)
            starts = np.unique(upto // ENCODE_BYTES, return_index=True)[1].tolist()
            for i, j in zip(starts, [*starts[1:], len(texts)], strict=True):
                part = batch.slice(i, j - i)
                kept = [c for c in part.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _encoded(part.column(text_col))], names=[*kept, out])

    return run


def tokenize(df: DataFrame, text_col: str = "text", out: str = "tokens", tokenizer: str = "bpe") -> DataFrame:
    """Add ``out`` = token ids. NULL or empty text is filtered natively first, so
    the tokenizer never sees rows that cannot produce a token.

    Either tokenizer runs exactly once a row, after any repartition that spreads the
    scan: BPE is a ``mapInArrow``, whose texts are encoded in runs of bounded bytes, and
    the native ids come out of an ``explode`` of the one array. No filter on the tokens
    (``drop_empty``, or the one Catalyst infers from a later ``explode``) moves below
    these, where it would be a second evaluation of the tokenizer."""
    nonempty = df.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0)
    kept = [f for f in nonempty.schema.fields if f.name != out]
    if tokenizer == "bpe":
        schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])
        return nonempty.mapInArrow(_encode_batches(text_col, out), schema)
    return nonempty.select(*[F.col(f"`{f.name}`") for f in kept], F.explode(F.array(encode(F.col(text_col), tokenizer))).alias(out))


def drop_empty(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Rows whose token list is empty carry nothing to learn; drop them."""
    return df.where(F.size(F.col(tokens_col)) > 0)


def token_counts(df: DataFrame, group_cols=("lang", "source"), tokens_col: str = "tokens") -> DataFrame:
    """Documents and tokens per group (partial + final hash aggregate)."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size(tokens_col).cast("bigint")).alias("n_tokens"),
        F.max(F.size(tokens_col).cast("bigint")).alias("max_tokens"),
    )
