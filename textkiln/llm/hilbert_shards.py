"""Sharding along a Hilbert curve over metadata dimensions, with built-in functions only.

Each dimension is quantised to a few bits; the curve index of the cell orders
the rows, and equal runs of that order are the shards. Neighbours on the curve
share nearly all coordinates, so a shard covers narrow ranges of every
dimension and files can be pruned by any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkiln.llm.common import in_order, running_totals

SHARDS = 40
#: Bits of each dimension.
BITS = 4
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
LAW = "rows"


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the row's own."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def log_class(value: Column, first: int = 4, bits: int = BITS) -> Column:
    """Classes of a positive number by powers of two, from 2^first on (null, smaller and larger ones at the ends)."""
    top = (1 << bits) - 1
    return F.coalesce(F.least(F.greatest(F.floor(F.log2(value)) - F.lit(first), F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def cut_points(df: DataFrame, dim: str, bits: int = BITS) -> list[str]:
    """Up to 2^bits - 1 values that split the rows into classes of similar size, in value order.

    Exact weighted quantiles over all values: a value's class follows from the
    rows before it, and the least value of each class but the first is a cut.
    Values are counted and summed in Spark; only the cuts reach the driver.
    """
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    upto = running_totals(in_order(counts, ["value"], "shard-values"), [], {"upto": F.col("rows")})
    total = upto.agg(F.max("upto")).first()[0]
    if not total:
        return []
    level = F.floor((F.col("upto") - F.col("rows")) * F.lit(1 << bits) / F.lit(total))
    least = upto.groupBy(level.alias("level")).agg(F.min("value").alias("value")).where("level > 0")
    return sorted((r["value"] for r in least.collect()), key=str.encode)


def value_class(value: Column, cuts: Sequence[str]) -> Column:
    """Number of cut points up to the value; 0 for null."""
    out = F.lit(0).cast("long")
    for c in cuts:
        out = out + F.when(value >= F.lit(c), 1).otherwise(0)
    return out


def hilbert_index(df: DataFrame, dims: Sequence[str], bits: int = BITS, out: str = "hilbert") -> DataFrame:
    """``df`` with the Hilbert curve index of the cell given by the long columns ``dims`` (0 to 2^bits - 1).

    The cell's coordinates are rotated and reflected level by level from the
    highest bit down, Gray-coded across dimensions, and their bits interleaved.
    Each step is one projection, so no expression is repeated in another.
    """
    xs = [f"_h{i}" for i in range(len(dims))]
    df = df.withColumns({x: F.col(d).cast("long") for x, d in zip(xs, dims, strict=True)})
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for x in xs:
            first, this = F.col(xs[0]), F.col(x)
            set_ = this.bitwiseAND(F.lit(bit)) != 0
            swap = first.bitwiseXOR(this).bitwiseAND(F.lit(low))
            step = {xs[0]: F.when(set_, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if x != xs[0]:
                step[x] = F.when(set_, this).otherwise(this.bitwiseXOR(swap))
            df = df.withColumns(step)
    for a, b in zip(xs, xs[1:]):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    flip = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(xs[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_flip", flip)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for x in xs:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(x).bitwiseXOR(F.col("_flip")), level).bitwiseAND(F.lit(1)))
    return df.withColumn(out, index).drop(*xs, "_flip")


def cut_runs(df: DataFrame, order: Sequence[Column], shards: int = SHARDS, name: str = "shards") -> DataFrame:
    """``df`` with ``shard`` and ``slot``: equal runs, at most one row apart, of the given order.

    Rows are range-partitioned on the whole order, so a hot cell or a group of
    copies spreads over many tasks; a row's rank is its place in its partition
    plus the rows of earlier partitions (one number a partition).
    """
    rows = in_order(df, order, name)
    every = Window.partitionBy(F.lit(0))
    sizes = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select(F.col("_pid").alias("_of"), (F.sum("_rows").over(every.orderBy("_pid")) - F.col("_rows")).alias("_start"), F.sum("_rows").over(every).alias("_total"))
    ranked = rows.join(F.broadcast(starts), F.col("_pid") == F.col("_of")).withColumn("_rank", F.col("_start") + F.col("_idx"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((_rank * {shards}) div _total as int)"))
    slot = F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", slot.cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dims: Sequence[str] = ("lang", "source"), shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot``, ``grown_shard`` (null) and ``hilbert``.

    The curve runs over the string columns ``dims`` (cut points between their
    values) and the size class. On one cell rows lie by crc and id, so equal
    texts are neighbours. Null dimensions and texts have class 0 and the
    smallest size; repeated rows get slots of their own; an empty table gives
    an empty result. Columns of ``docs`` with the new names are replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"]
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    txt = F.col(f"`{text}`")
    sized = own.withColumns({"size": text_size(txt), "text_crc32": F.coalesce(F.crc32(txt), F.lit(0)).cast("long")})
    classes = {f"_d{i}": value_class(F.col(f"`{d}`"), cut_points(own, d)) for i, d in enumerate(dims)}
    classes["_size"] = log_class(F.col("size"))
    placed = hilbert_index(sized.withColumns(classes), list(classes)).drop(*classes)
    runs = cut_runs(placed, [F.col("hilbert"), F.col("text_crc32"), F.col(f"`{doc_id}`")], shards)
    return runs.withColumns({"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")})


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard and slot of every row of ``docs`` (doc_id, text, lang, source), without the texts.

    Sizes and checksums are taken at the scan, so no text is shuffled. Nulls
    are classed and sized as ``assign`` states; rows without an id come first
    on their place of the curve, repeated rows get slots of their own, and an
    empty table gives an empty result.
    """
    sized = docs.select("doc_id", "lang", "source", text_size(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    classes = {f"_d{i}": value_class(F.col(d), cut_points(docs, d)) for i, d in enumerate(("lang", "source"))}
    classes["_size"] = log_class(F.col("size"))
    placed = hilbert_index(sized.withColumns(classes), list(classes)).select("doc_id", "size", "text_crc32", "hilbert")
    runs = cut_runs(placed, [F.col("hilbert"), F.col("text_crc32"), F.col("doc_id")], shards)
    return runs.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
