"""Corpus and conversation scans, and the joined-corpus prefix.

The held-out corpus is evaluated as one string: all texts joined with a blank
line, cut to a character prefix, then tokenized. It is never built as one
string here. Running character offsets (see ``ranking``) place every
document in the joined text; the prefix keeps documents that start before the
limit and cuts the boundary one. Tokenizing the joined text piece by piece is
exact when pieces are cut where a visible character meets whitespace: no
pre-token spans such a point, so every piece carries the whitespace that
precedes its first visible character and ends at its last visible character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.constants import EVAL_JOIN_SEP, EVAL_PREFIX_CHARS
from textkiln.operators.ranking import in_order, running_totals

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CONVERSATION_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
HELDOUT_SCHEMA = "item_id BIGINT, text STRING"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan whose files give few splits (e.g. one huge row group) over the
    session's parallelism; text work after the scan is per row and would otherwise
    run in a few tasks. A scan of many files is left alone. Only the placement of
    rows differs."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys)


def corpus_scan(spark: SparkSession, path: str, columns=("doc_id", "text"), schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Read a corpus with a declared schema; only ``columns`` reach the scan."""
    df = spark.read.schema(schema).parquet(path).select(*columns)
    return balanced(df, columns[0]) if "text" in columns else df


def chat_scan(spark: SparkSession, path: str) -> DataFrame:
    """Conversations in long form ``(conv_id, turn, role, text)``."""
    return balanced(spark.read.schema(CONVERSATION_SCHEMA).parquet(path), "conv_id", "turn")


def nest_conversations(turns: DataFrame) -> DataFrame:
    """Long form -> ``conv_id, messages ARRAY<STRUCT<role, content>>`` in turn order."""
    msgs = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(
        F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")
    )


def unnest_conversations(nested: DataFrame) -> DataFrame:
    """Nested form -> long form; ``turn`` is the message position."""
    return nested.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text")
    )


def concat_prefix(
    df: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    limit: int | None = EVAL_PREFIX_CHARS,
    sep: str = EVAL_JOIN_SEP,
) -> DataFrame:
    """Segments ``(seg_id, seg_start, segment)`` whose concatenation in ``seg_id``
    order equals ``sep.join(texts)[:limit]`` (``limit=None``: the whole joined text).
    The separator is attached in front of every text but the first. Ids are unique
    and may be of any kind, e.g. hashes.

    Offsets are running sums over ``(id, length)`` rows in id order; texts move
    only to meet the kept offsets. With a limit those are at most ``limit`` rows
    (each text adds at least the separator), which is what allows broadcasting
    them."""
    sl = len(sep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).alias("seg_id"), text.alias("_t"))
    narrow = in_order(d.select("seg_id", (F.length("_t") + F.lit(sl)).cast("bigint").alias("_w")), ["seg_id"], "corpus-lengths")
    off = running_totals(narrow, [], {"_end": F.col("_w")}).select(F.col("seg_id").alias("_id"), (F.col("_end") - F.col("_w")).alias("_off"))
    if limit is not None:
        off = F.broadcast(off.where(F.col("_off") < limit + sl))
    kept = d.join(off, F.col("seg_id").eqNullSafe(F.col("_id")))
    first = F.col("_off") == 0
    seg = F.when(first, F.col("_t")).otherwise(F.concat(F.lit(sep), F.col("_t")))
    start = F.when(first, F.lit(0)).otherwise(F.col("_off") - F.lit(sl)).cast("bigint")
    kept = kept.select("seg_id", start.alias("seg_start"), seg.alias("segment"))
    if limit is None:
        return kept
    kept = kept.where(F.col("seg_start") < limit)
    return kept.select("seg_id", "seg_start", F.expr(f"substring(segment, 1, int({limit} - seg_start))").alias("segment"))


def whitespace_pieces(segments: DataFrame, unicode_ws: bool = False) -> DataFrame:
    """Re-cut ordered segments into independently tokenizable pieces.

    Output ``(piece, text)``, ``piece`` = 0, 1, ... in text order. Piece ``r`` is the
    whitespace after the ``r``-th visible stretch (blank segments included) plus
    the next segment's text up to its last visible character; the last piece
    holds the trailing whitespace. ``unicode_ws`` matches a tokenizer whose
    whitespace class is Unicode (BPE); the native piece pattern uses ASCII.
    """
    flags = "(?s)(?U)" if unicode_ws else "(?s)"
    head = F.regexp_extract(F.col("segment"), flags + r"^(.*\S)", 1)
    d = segments.select("seg_id", "segment", head.alias("_head"))
    d = d.withColumn("_nb", (F.length("_head") > 0).cast("int"))
    counted = running_totals(in_order(d.select("seg_id", "_nb"), ["seg_id"], "corpus-visible"), [], {"_upto": F.col("_nb")})
    before = counted.select(F.col("seg_id").alias("_id"), (F.col("_upto") - F.col("_nb")).alias("_before"))
    d = d.join(before, F.col("seg_id").eqNullSafe(F.col("_id"))).drop("_id")
    trail = F.expr("substring(segment, length(_head) + 1)")
    frags = F.array(
        F.struct(F.col("_before").alias("piece"), F.col("seg_id"), F.lit(0).alias("part"), F.col("_head").alias("frag")),
        F.struct(
            (F.col("_before") + F.col("_nb")).cast("bigint").alias("piece"),
            F.col("seg_id"),
            F.lit(1).alias("part"),
            trail.alias("frag"),
        ),
    )
    f = d.select(F.explode(frags).alias("f")).select("f.*").where(F.length("frag") > 0)
    parts = F.sort_array(F.collect_list(F.struct("seg_id", "part", "frag")))
    return f.groupBy("piece").agg(F.array_join(F.transform(parts, lambda x: x["frag"]), "").alias("text"))
