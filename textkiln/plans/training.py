"""End-to-end training-row plans.

``corpus_rows``: corpus -> tokens -> drop empty -> crop or pad -> shard, with
the seeded shuffle key attached. ``write_corpus_rows`` lays the rows out in
shuffled order with a single range shuffle on that key (the integer rank is
not needed for the layout) and writes one folder per shard. The integer
shuffle rank and the batch plan depend only on the ids, so ``corpus_plan``
computes them on the narrow id column: the wide rows (two 1024-id arrays each)
cross the network once. ``chat_rows`` / ``write_chat_rows`` do the same for
conversations. Nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.constants import SEED
from textkiln.functions.hashing import seeded_hash_hex
from textkiln.operators import chat, sampling, tokens
from textkiln.sources import sinks


def shuffle_key(id_col: str, seed: int = SEED, epoch: int = 0):
    """The seeded key whose order (then the id) is the shuffled order."""
    return seeded_hash_hex("shuf", seed, epoch, F.col(id_col))


def corpus_rows(corpus: DataFrame, tokenizer: str = "bpe", num_shards: int = 2, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """``doc_id, shuffle_key, shard, crop_start, input_ids, labels`` for one epoch."""
    t = tokens.tokenize(corpus.select("doc_id", "text"), tokenizer=tokenizer)
    if tokenizer == "bpe":  # the native tokenizer's own text filter already drops empty rows
        t = tokens.drop_empty(t)
    rows = sampling.crop_or_pad(t, seed=seed, epoch=epoch)
    rows = sampling.shard(rows, num_shards, seed=seed, epoch=epoch).withColumn("shuffle_key", shuffle_key("doc_id", seed, epoch))
    return rows.select("doc_id", "shuffle_key", "shard", "crop_start", "input_ids", "labels")


def corpus_plan(corpus: DataFrame, seed: int = SEED, epoch: int = 0, **plan_args) -> DataFrame:
    """Shuffle rank, micro-step and global step per non-empty document, on ids only.

    Empty documents give no training row, so they get no rank either."""
    ids = corpus.where(F.length("text") > 0).select("doc_id")
    ranked = sampling.seeded_shuffle(ids, seed=seed, epoch=epoch)
    return sampling.batch_plan(ranked, **plan_args)


def in_key_order(rows: DataFrame, *order: str) -> DataFrame:
    """Range shuffle and sort for a sink: with the shard first, a task writes to one
    shard folder or, at a border, a few."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_corpus_rows(corpus: DataFrame, path: str, tokenizer: str = "bpe", num_shards: int = 2, seed: int = SEED, epoch: int = 0) -> None:
    """Write one epoch of training rows, in shuffled order within each shard."""
    rows = in_key_order(corpus_rows(corpus, tokenizer, num_shards, seed, epoch), "shard", "shuffle_key", "doc_id")
    sinks.write_training_rows(rows, path)


def chat_rows(conversations: DataFrame, tokenizer: str = "bpe", seed: int = SEED, epoch: int = 0) -> DataFrame:
    """``conv_id, shuffle_key, input_ids, labels, n_targets, zero_target`` for one epoch."""
    rows = chat.chat_training_rows(conversations, tokenizer=tokenizer)
    rows = rows.withColumn("shuffle_key", shuffle_key("conv_id", seed, epoch))
    return rows.select("conv_id", "shuffle_key", "input_ids", "labels", "n_targets", "zero_target")


def write_chat_rows(conversations: DataFrame, path: str, tokenizer: str = "bpe", seed: int = SEED, epoch: int = 0) -> None:
    rows = in_key_order(chat_rows(conversations, tokenizer, seed, epoch).withColumn("shard", F.lit(0)), "shard", "shuffle_key", "conv_id")
    sinks.write_training_rows(rows, path)
