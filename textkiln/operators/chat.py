"""Conversation assembly: role routing, chat template, loss mask, truncation, padding.

Each turn is tokenized on its own and the segments are concatenated in turn
order (encoding the joined string would merge pieces across the seam). Only
the head of a conversation survives truncation, so the running token offset
of every turn is computed first (see ``ranking``) and turns that start past the
row length or hold no token never reach the per-conversation aggregate: the
collected group is bounded by the row length however long the conversation is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.constants import EOT, IGNORE, SEQ_LEN, USER_PREFIX, USER_SUFFIX
from textkiln.functions.arrays import append_eot, count_valid, pad_to, repeat_ignore
from textkiln.operators.ranking import in_order, running_totals
from textkiln.operators.tokens import encode
from textkiln.session import materialize

ROLES = ("user", "assistant")


def role_route(turns: DataFrame, role_col: str = "role") -> DataFrame:
    """Keep user and assistant turns; any other role (e.g. system) is ignored."""
    return turns.where(F.col(role_col).isin(*ROLES))


def chat_template(turns: DataFrame, role_col: str = "role", text_col: str = "text", out: str = "segment") -> DataFrame:
    """User text becomes ``User: {text}\\nAssistant: ``; assistant text is kept as is."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    seg = F.when(F.col(role_col) == "user", F.concat(F.lit(USER_PREFIX), content, F.lit(USER_SUFFIX))).when(
        F.col(role_col) == "assistant", content
    )
    return turns.withColumn(out, seg)


def loss_mask(segments: DataFrame, tokenizer: str = "bpe", role_col: str = "role") -> DataFrame:
    """Token ids and labels per turn: user labels are IGNORE, assistant turns end in
    EOT and are their own labels; other roles contribute empty arrays."""
    toks = encode(F.col("segment"), tokenizer)
    is_user = F.col(role_col) == "user"
    is_asst = F.col(role_col) == "assistant"
    empty = F.array().cast("array<int>")
    ids = F.when(is_user, toks).when(is_asst, append_eot(toks)).otherwise(empty)
    d = segments.withColumn("seg_ids", ids)
    return d.withColumn("seg_labels", F.when(is_user, repeat_ignore(F.col("seg_ids"))).otherwise(F.col("seg_ids")))


def chat_training_rows(
    conversations: DataFrame,
    tokenizer: str = "bpe",
    seq_len: int = SEQ_LEN,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
) -> DataFrame:
    """One fixed-length training row per conversation (long-form input). Roles other
    than user and assistant are left out first; a conversation without any token
    gives a row of padding only. Turns with one number follow each other by role,
    length and content; a turn that is there twice counts twice.

    Output: conv_id, input_ids, labels (both ``seq_len`` long), n_tokens (before
    padding), total_tokens (before truncation), n_targets, truncated, zero_target.
    """
    segs = loss_mask(chat_template(role_route(conversations)), tokenizer)
    # only ids and role are kept: labels follow from them after the cut. The lineage
    # is cut so that the tokenizer runs once per turn, where the scan has put it; the
    # written table also keeps every row's number, which tells repeated turns apart
    segs = segs.select(conv_col, turn_col, "role", "seg_ids", F.size("seg_ids").cast("bigint").alias("n")).where("n > 0")
    segs = materialize(segs.withColumn("_row", F.monotonically_increasing_id()), "chat-turns")
    # running offsets are sums over narrow rows; a hot conversation spreads over
    # the range partitions of (conversation, turn)
    narrow = segs.select(conv_col, turn_col, "role", "n", F.xxhash64("seg_ids").alias("_hash"), "_row")
    order = in_order(narrow, [conv_col, turn_col, "role", "n", "_hash", "_row"], "chat-sizes")
    offsets = running_totals(order, [conv_col], {"_end": F.col("n")}).withColumn("tok_offset", F.col("_end") - F.col("n"))
    totals = conversations.select(conv_col).distinct().join(
        order.groupBy(F.col(conv_col).alias("_c")).agg(F.sum("n").cast("bigint").alias("_total")), F.col(conv_col).eqNullSafe(F.col("_c")), "left"
    )
    totals = totals.select(conv_col, F.coalesce("_total", F.lit(0).cast("bigint")).alias("total_tokens"))
    # the turns that still have room: at most ``seq_len`` a conversation, as each holds a token
    room = offsets.where(F.col("tok_offset") < seq_len).select("_row", "tok_offset")
    left = F.lit(seq_len) - F.col("tok_offset")
    cut = F.slice("seg_ids", 1, left.cast("int"))
    part = F.struct(F.col("tok_offset"), cut.alias("ids"), F.when(F.col("role") == "user", repeat_ignore(cut)).otherwise(cut).alias("labels"))
    parts = segs.join(room, "_row").groupBy(F.col(conv_col).alias("_c")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    conv = totals.join(parts, F.col(conv_col).eqNullSafe(F.col("_c")), "left").withColumn("parts", F.coalesce("parts", F.expr("cast(array() as array<struct<tok_offset:bigint,ids:array<int>,labels:array<int>>>)")))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    labels = F.flatten(F.transform("parts", lambda p: p["labels"]))
    rows = conv.select(conv_col, ids.alias("ids"), labels.alias("lbl"), "total_tokens")
    rows = rows.select(
        conv_col,
        pad_to(F.col("ids"), seq_len, EOT).alias("input_ids"),
        pad_to(F.col("lbl"), seq_len, IGNORE).alias("labels"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        "total_tokens",
    )
    rows = rows.withColumn("n_targets", count_valid(F.col("labels")).cast("bigint"))
    return rows.withColumn("truncated", F.col("total_tokens") > seq_len).withColumn(
        "zero_target", F.col("n_targets") == 0
    )
