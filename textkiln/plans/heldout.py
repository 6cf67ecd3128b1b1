"""The held-out corpus as one token sequence, built piecewise.

texts -> joined prefix segments -> whitespace-safe pieces -> tokens per piece
-> running token offsets -> the previous piece's last token (for the first
pair of each piece). Nothing is ever concatenated into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.operators.evaluation import next_token_pairs
from textkiln.operators.ranking import in_order, running_totals
from textkiln.operators.tokens import encode
from textkiln.session import materialize
from textkiln.sources.corpus import HELDOUT_SCHEMA, concat_prefix, corpus_scan, table_path, whitespace_pieces


def heldout_pieces(texts: DataFrame, id_col: str = "item_id", tokenizer: str = "bpe", limit: int | None = None) -> DataFrame:
    """``(piece, text, tokens, tok_offset, prev_last)`` of the joined corpus (its first
    ``limit`` characters, or all of it)."""
    segs = concat_prefix(texts, id_col, "text", limit)
    pieces = whitespace_pieces(segs, unicode_ws=(tokenizer == "bpe"))
    pieces = pieces.withColumn("tokens", encode(F.col("text"), tokenizer))
    # the piece table is read by several consumers (offsets, pairs, lengths, the
    # shifted self-join): cut the lineage once, so the tokenizer runs once
    pieces = materialize(pieces, "heldout-pieces")
    sizes = in_order(pieces.select("piece", F.size("tokens").cast("bigint").alias("_n")), ["piece"], "heldout-sizes")
    offsets = running_totals(sizes, [], {"_end": F.col("_n")}).select("piece", (F.col("_end") - F.col("_n")).alias("tok_offset"))
    pieces = pieces.join(offsets, "piece")
    prev = pieces.select((F.col("piece") + 1).alias("piece"), F.element_at("tokens", -1).alias("prev_last"))
    return pieces.join(prev, "piece", "left")


def heldout_pairs(pieces: DataFrame) -> DataFrame:
    """``(seq, pos, ctx, next)`` over the whole joined sequence (seq = 0)."""
    d = pieces.withColumn("seq", F.lit(0))
    return next_token_pairs(d, ["seq"], "tokens", base_pos=F.col("tok_offset"), prev_token=F.col("prev_last"))


def heldout_length(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy(F.lit(0).alias("seq")).agg(F.sum(F.size("tokens")).cast("bigint").alias("L"))


def heldout_texts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_scan(spark, table_path(sf, "benchmark"), ("item_id", "text"), HELDOUT_SCHEMA)
