"""Seeded shuffle, sharding, cropping/padding into training rows, batch plans.

All draws hash ``salt:seed:epoch:id`` (see ``functions.hashing``), so every
row's fate is a pure function of its id: task retries and reruns agree, and
shards are disjoint and complete by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.constants import BATCH_SIZE, EOT, GRAD_ACCUM, IGNORE, SEED, SEQ_LEN, SHUFFLE_BUFFER
from textkiln.functions.arrays import count_valid, pad_to, tail
from textkiln.functions.hashing import seeded_hash_hex, seeded_u32
from textkiln.operators.ranking import global_rank, in_order, numbered


def seeded_shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = SEED, epoch: int = 0, out: str = "shuffle_rank") -> DataFrame:
    """Exact seeded permutation: ``out`` = 0-based rank by (md5 key, id).

    The rank is computed blockwise over hash prefixes, never in one task;
    sorting the output by ``out`` (a range shuffle) is left to the sink.
    """
    d = df.withColumn("_shuf", seeded_hash_hex("shuf", seed, epoch, F.col(id_col)))
    return global_rank(d, "_shuf", id_col, out=out).drop("_shuf")


def buffered_shuffle(
    df: DataFrame, order: Sequence[str | Column], id_col: str = "doc_id", buffer: int = SHUFFLE_BUFFER, seed: int = SEED, epoch: int = 0, out: str = "shuffle_rank"
) -> DataFrame:
    """Shuffle of a stream in the given order by a buffer: ``out`` = 0-based place.

    A row at position ``p`` leaves at tick ``p + d``, where ``d`` in
    ``[0, buffer)`` is drawn from its id; rows of one tick leave in the order of
    their draws. So no row moves by ``buffer`` places or more, a buffer of 1
    keeps the order, and a retry gives the same one. Positions and places are
    counted over range partitions; only the order's columns, the id and the draw
    are sorted. Rows without an id draw like any other."""
    draw = seeded_u32("buffer", seed, epoch, F.coalesce(F.col(id_col).cast("string"), F.lit("none")))
    placed = numbered(in_order(df.withColumn("_draw", draw), [*order, "_draw"], "buffer-order"), "_place")
    tick = F.col("_place") + F.floor(F.col("_draw") * F.lit(buffer) / F.lit(1 << 32)).cast("long")
    left = numbered(in_order(placed.withColumn("_tick", tick), ["_tick", "_draw", "_place"], "buffer-ticks"), out)
    return left.drop("_draw", "_place", "_tick")


def shard(df: DataFrame, num_shards: int, id_col: str = "doc_id", seed: int = SEED, epoch: int = 0, out: str = "shard") -> DataFrame:
    """Assign each row to one of ``num_shards`` workers."""
    return df.withColumn(out, F.pmod(seeded_u32("shard", seed, epoch, F.col(id_col)), F.lit(num_shards)).cast("int"))


def crop_start(tokens: str, id_col: str, seq_len: int = SEQ_LEN, seed: int = SEED, epoch: int = 0):
    """Uniform start in ``[0, len - seq_len]`` for rows longer than ``seq_len``, else 0."""
    span = F.size(tokens) - F.lit(seq_len) + F.lit(1)
    draw = F.pmod(seeded_u32("crop", seed, epoch, F.col(id_col)), span)
    return F.when(F.size(tokens) > seq_len, draw).otherwise(F.lit(0)).cast("int")


def crop_or_pad(
    df: DataFrame, tokens: str = "tokens", id_col: str = "doc_id", seq_len: int = SEQ_LEN, seed: int = SEED, epoch: int = 0
) -> DataFrame:
    """One training row per document: a random contiguous crop when longer than
    ``seq_len`` (labels = ids), otherwise right-padding (ids with EOT, labels IGNORE)."""
    d = df.withColumn("crop_start", crop_start(tokens, id_col, seq_len, seed, epoch))
    long = F.size(tokens) > seq_len
    cropped = F.slice(tokens, F.col("crop_start") + 1, seq_len)
    ids = F.when(long, cropped).otherwise(pad_to(F.col(tokens), seq_len, EOT))
    labels = F.when(long, cropped).otherwise(pad_to(F.col(tokens), seq_len, IGNORE))
    return d.withColumn("input_ids", ids).withColumn("labels", labels)


def all_rows(df: DataFrame, tokens: str = "tokens", seq_len: int = SEQ_LEN) -> DataFrame:
    """Training rows that cover every token: consecutive runs of ``seq_len`` tokens
    as rows ``row_no`` = 0, 1, ...; only a document's last row is padded. The
    crop of ``crop_or_pad`` is the other option: one row a document and epoch."""
    size = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(seq_len))
    d = df.withColumn("row_no", F.explode(F.when(size > 0, F.transform(starts, lambda x: F.floor(x / seq_len).cast("bigint")))))
    run = F.slice(tokens, (F.col("row_no") * seq_len + 1).cast("int"), seq_len)
    return d.withColumn("input_ids", pad_to(run, seq_len, EOT)).withColumn("labels", pad_to(run, seq_len, IGNORE))


def head_truncate(col: str, seq_len: int = SEQ_LEN):
    return F.slice(col, 1, seq_len)


def tail_context(col: str, seq_len: int = SEQ_LEN):
    """The last ``seq_len`` tokens: the context a generator conditions on."""
    return tail(F.col(col), seq_len)


def batch_plan(
    ranked: DataFrame,
    rank_col: str = "shuffle_rank",
    batch_size: int = BATCH_SIZE,
    grad_accum: int = GRAD_ACCUM,
    max_steps: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Micro-step and global step of every row in shuffled order.

    ``step_complete`` tells whether the step gets all its rows: ranks count
    from 0 without gaps, so it follows from the number of rows (``n_rows``, by
    default counted on the ranks). ``max_steps`` stops training early: rows of
    later steps are left out; without it every row is planned."""
    micro = F.floor(F.col(rank_col) / batch_size).cast("bigint")
    d = ranked.withColumn("micro_step", micro).withColumn(
        "global_step", (F.floor(F.col("micro_step") / grad_accum) + 1).cast("bigint")
    )
    n = n_rows if n_rows is not None else ranked.count()
    d = d.withColumn("step_complete", F.col("global_step") * F.lit(batch_size * grad_accum) <= F.lit(n))
    return d if max_steps is None else d.where(F.col("global_step") <= max_steps)


def packing_report(rows: DataFrame, tokens_col: str = "n_tokens", seq_len: int = SEQ_LEN, batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """Token budget of a set of training rows (one aggregate row)."""
    n = F.col(tokens_col)
    agg = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.least(n, F.lit(seq_len))).cast("bigint").alias("n_tokens"),
        F.sum(F.greatest(F.lit(seq_len) - n, F.lit(0))).cast("bigint").alias("n_pad"),
        F.sum(count_valid(F.col("labels"))).cast("bigint").alias("n_targets"),
        F.sum((n > seq_len).cast("int")).cast("bigint").alias("n_cropped"),
    )
    micro = F.ceil(F.col("n_rows") / batch_size).cast("bigint")
    return agg.select(
        "n_rows",
        "n_tokens",
        "n_pad",
        "n_targets",
        "n_cropped",
        (F.col("n_rows") * seq_len).cast("bigint").alias("token_budget"),
        micro.alias("micro_steps"),
        F.floor(micro / grad_accum).cast("bigint").alias("global_steps"),
        F.round(F.col("n_pad") / (F.col("n_rows") * seq_len), 6).alias("pad_share"),
        F.round(F.col("n_targets") / (F.col("n_rows") * seq_len), 6).alias("target_share"),
    )


def multi_epoch_plan(
    rows: DataFrame,
    epochs: int,
    id_col: str = "doc_id",
    batch_size: int = BATCH_SIZE,
    grad_accum: int = GRAD_ACCUM,
    seed: int = SEED,
) -> DataFrame:
    """Batch plan over several epochs, each with its own seeded permutation.

    The micro-step counter continues across epochs (an epoch has
    ``ceil(N / batch_size)`` micro-steps, its last batch possibly short), so a
    global step may span two epochs and the number of steps can exceed the
    per-epoch estimate ``(ceil(N / batch) // accum) * epochs``."""
    import math

    n = rows.select(id_col).count()
    per_epoch = math.ceil(n / batch_size)
    ids = rows.select(id_col)
    plans = [
        seeded_shuffle(ids, id_col, seed=seed, epoch=e).withColumn("epoch", F.lit(e)) for e in range(epochs)
    ]
    d = plans[0]
    for p in plans[1:]:
        d = d.unionByName(p)
    micro = (F.col("epoch") * per_epoch + F.floor(F.col("shuffle_rank") / batch_size)).cast("bigint")
    d = d.withColumn("micro_step", micro)
    return d.withColumn("global_step", (F.floor(F.col("micro_step") / grad_accum) + 1).cast("bigint")).withColumn(
        "planned_steps", F.lit((per_epoch // grad_accum) * epochs).cast("bigint")
    )


def in_shuffled_order(ranked: DataFrame, rank_col: str = "shuffle_rank", num_partitions: int | None = None) -> DataFrame:
    """Lay rows out in rank order for a sink: a range shuffle on the rank, then a
    sort inside each partition (no global single-task sort)."""
    n = num_partitions or int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked.repartitionByRange(n, rank_col).sortWithinPartitions(rank_col)
