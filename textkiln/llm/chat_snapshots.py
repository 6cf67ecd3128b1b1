"""Chat formatting of logged conversations after collapsing cumulative snapshots.

A log that stores a conversation after every exchange holds each conversation
many times, as prefixes of its last state. Every turn gets the rolling hash of
the conversation up to it; a conversation whose final hash is the hash of
another's proper prefix is a snapshot. An anti-join keeps the maximal ones,
and only their turns are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import cut, in_order, running_totals

LANES = ["_l0", "_l1", "_l2", "_l3"]


def prefix_hashes(turns: DataFrame, name: str = "chat") -> DataFrame:
    """(conv_id, pos, four lanes of 32-bit sums, _pid, _idx) of every row of an ordered turn table.

    The hash of a prefix is the sum, lane by lane, of hashes of (position,
    turn), so it rolls from one turn to the next and partial sums of a long
    conversation can be added up across partitions. Positions count from 1.
    """
    narrow = turns.select("conv_id", "_c", "_pid", "_idx")
    placed = cut(running_totals(narrow, ["conv_id"], {"pos": F.lit(1)}), f"{name}-places")
    mixed = F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("_c")))
    lanes = {lane: F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long") for i, lane in enumerate(LANES)}
    return cut(running_totals(placed, ["conv_id"], lanes), f"{name}-prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another; of equal ones the smallest id."""
    lanes = F.struct(*LANES)
    ends = cut(prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by(lanes, "pos").alias("_end")), "chat-ends")
    sizes = ends.select(F.col("conv_id").alias("_conv"), F.col("n").alias("_n"))
    inner = prefixes.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") < F.col("_n")))
    proper = inner.select(F.col("pos").alias("_pos"), *[F.col(x).alias(f"p{x}") for x in LANES]).distinct()
    once = ends.groupBy("n", "_end").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "n", "_end.*")
    same = F.col("n") == F.col("_pos")
    for x in LANES:
        same = same & (F.col(x) == F.col(f"p{x}"))
    return once.join(proper, same, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def collapse(turns: DataFrame) -> DataFrame:
    """Turns of the maximal conversations: conv_id, turn, pos, n_turns, role, text and ``rendered``.

    Turns are taken in the order of ``turn`` (null first; rows with the same
    number by the hash of their content), repeated rows are turns of their
    own. Null roles and texts count as empty, rows without ``conv_id`` form one
    conversation (kept only if no other equals it). A conversation of any
    length stays split: one row a turn, whose ``rendered`` pieces make up the
    text in the order of ``pos``. An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(F.concat_ws("\x1f", role, text)).alias("_c"))
    ordered = in_order(own, [F.col("conv_id"), F.col("turn"), F.col("_c")], "chat-turns")
    prefixes = prefix_hashes(ordered)
    kept = cut(maximal(prefixes), "chat-maximal").select(F.col("conv_id").alias("_conv"), "n_turns")
    rows = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("_pid", "_idx", "pos", "n_turns")
    out = ordered.join(rows, ["_pid", "_idx"])
    rendered = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    return out.select("conv_id", "turn", "pos", "n_turns", "role", "text", rendered.alias("rendered"))
