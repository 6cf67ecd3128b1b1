"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output over its own
size. Every document is repeated as often as a Poisson variable with that mean
says, found by inverting the distribution at a number hashed from the seed and
the document's id; copies are exploded and shuffled globally on a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.functions.hashing import seeded_hash_hex, uniform01
from textkiln.llm.common import checked_broadcast, cut
from textkiln.operators.ranking import partitions_for

SEED = 42
#: Target weights are proportional to a source's bytes to this power (1: as they are, 0: all alike).
POWER = 0.5
#: Bytes of the mixture over the bytes of the input.
EPOCHS = 1.0
#: A larger mean is drawn as a sum of independent draws, so its table stays short and exact.
LARGEST_MEAN = 32.0
#: Copies of a document that are made from one array.
RANGE = 1000


def document_key(doc_id: Column, text: Column) -> Column:
    """What a document's draws are hashed from: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, power: float = POWER, epochs: float = EPOCHS) -> DataFrame:
    """(source, bytes, rate) by source; a null source is one of its own.

    ``weights`` gives target weights by source (missing ones: 0); without it
    they follow ``power``. Texts count their UTF-8 bytes and one more, so a
    source of empty texts has a size.
    """
    col = F.col(f"`{source}`")
    sizes = docs.groupBy(col.alias("source")).agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + F.lit(1)).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = cut(sizes.withColumn("w", weight), "mix-sizes")  # read again for its totals
    all_bytes, all_w = sizes.agg(F.sum("bytes"), F.sum("w")).first()
    rate = F.lit(float(all_bytes) * epochs / all_w) * F.col("w") / F.col("bytes") if all_w else F.lit(0.0)
    return sizes.select("source", "bytes", rate.alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """``rates`` with ``parts`` and ``cdf``: the distribution function of a Poisson variable of mean rate / parts."""
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(LARGEST_MEAN)), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")  # beyond it lies less than the smallest step of a draw
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return rates.withColumn("parts", parts).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["c"]))


def copies(key: Column, seed: int = SEED) -> Column:
    """Poisson count of a row with columns ``_mix_parts`` and ``_mix_cdf``: per part, the entries below the hashed number."""

    def draw(j: Column) -> Column:
        u = uniform01("mix", F.lit(str(seed)), key, j)
        return F.size(F.filter(F.col("_mix_cdf"), lambda c: c < u))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), draw), F.lit(0), lambda a, x: a + x)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, names: tuple[str, str] = ("copy", "shuffle_key"), **how) -> DataFrame:
    """``docs`` replicated to the target weights and globally shuffled, with copy number and shuffle key in columns ``names``.

    Copies of a document count from 0. The shuffle sends a row to a partition
    and sorts it there by a hash of seed, document and copy, so any run gives
    the same rows in the same order of keys. Rows that share an id get the same
    number of copies; rows without one draw by their text. An empty table
    gives an empty result. Columns of ``docs`` with the new names are replaced.
    """
    rates = with_distribution(source_rates(docs, source, text, **how)).select(F.col("source").alias("_mix_source"), F.col("parts").alias("_mix_parts"), F.col("cdf").alias("_mix_cdf"))
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in names]
    key = document_key(F.col(f"d.`{doc_id}`"), F.col(f"d.`{text}`"))
    joined = docs.alias("d").join(checked_broadcast(rates), F.col(f"d.`{source}`").eqNullSafe(F.col("_mix_source")))
    counted = joined.select(*own, key.alias("_mix_key"), copies(key, seed).alias("_mix_n")).where("_mix_n > 0")
    # in two steps, so no array grows with the number of copies
    ranges = counted.withColumn("_mix_from", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1, F.lit(RANGE))))
    exploded = ranges.withColumn(names[0], F.explode(F.sequence(F.col("_mix_from"), F.least(F.col("_mix_n"), F.col("_mix_from") + RANGE) - 1)))
    keyed = exploded.withColumn(names[1], F.substring(seeded_hash_hex("order", F.lit(str(seed)), F.col("_mix_key"), F.col(names[0])), 1, 16)).drop("_mix_key", "_mix_n", "_mix_from")
    return keyed.repartition(*partitions_for(docs), names[1]).sortWithinPartitions(names[1])
