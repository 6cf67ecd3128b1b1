"""Running offsets and global ranks without a one-partition window.

``in_order`` and ``running_totals`` work for any order: rows are range-
partitioned on the whole sort key, summed inside their partition, and what
earlier partitions hold of a key is added (fewer rows than partitions).

A window over all rows of a key (or over the whole table when there is no key)
puts that key into one task. Here the order is cut into blocks by a monotone
``block`` expression: block totals are summed first (a small table), their
prefix is joined back, and the final window runs per (key, block) only. No
window ever holds more than one block of rows, so a hot key is split as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkiln.session import materialize


def running_sum(
    df: DataFrame,
    value: str | Column,
    order_cols: Sequence[str],
    block: Column,
    partition_cols: Sequence[str] = (),
    out: str = "offset",
    inclusive: bool = False,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows before this one (or up to it).

    ``order_cols`` must order rows uniquely within ``partition_cols``;
    ``block`` must be non-decreasing along that order. Rows per block bound the
    work of one window task; the number of blocks bounds the small prefix table.
    """
    pcols = list(partition_cols)
    val = value if isinstance(value, Column) else F.col(value)
    upper = 0 if inclusive else -1
    blk = Window.partitionBy(*pcols, "_blk")
    # one exchange on (keys, block): running sum within the block and the block total
    d = (
        df.withColumn("_blk", block)
        .withColumn("_val", val.cast("bigint"))
        .withColumn("_within", F.coalesce(F.sum("_val").over(blk.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, upper)), F.lit(0).cast("bigint")))
        .withColumn("_blk_total", F.sum("_val").over(blk))
    )
    # block totals come from the same exchange (reused), so upstream work runs once
    totals = d.groupBy(*pcols, "_blk").agg(F.first("_blk_total").alias("_blk_total"))
    wb = Window.partitionBy(*pcols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *pcols, "_blk", F.coalesce(F.sum("_blk_total").over(wb), F.lit(0).cast("bigint")).alias("_blk_base")
    )
    bases = bases.select(*[F.col(c).alias(f"_b_{c}") for c in pcols], F.col("_blk").alias("_b_blk"), "_blk_base")
    on = d["_blk"].eqNullSafe(F.col("_b_blk"))
    for c in pcols:
        on = on & d[c].eqNullSafe(F.col(f"_b_{c}"))
    joined = d.join(bases, on, "inner").drop("_b_blk", *[f"_b_{c}" for c in pcols])
    return joined.withColumn(out, (F.col("_blk_base") + F.col("_within")).cast("bigint")).drop(
        "_blk", "_blk_base", "_val", "_within", "_blk_total"
    )


def partitions_for(df: DataFrame) -> list[int]:
    """``[n]`` where the inputs' bytes call for more partitions than the session's
    number, at the advisory size each; otherwise empty (the session's number, which
    AQE may lower). Read from the plan's statistics, without a job."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    advisory = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = sum(x for x in sizes if x < 1 << 60) // advisory + 1  # an unknown size is stated as the largest number
    return [n] if n > least else []


def in_order(df: DataFrame, order: Sequence[str | Column], name: str = "ordered") -> DataFrame:
    """Rows in the global order of ``order``, cut to a table with ``_pid`` and ``_idx``.

    ``_pid`` numbers the range partitions in order and ``_idx`` the rows inside
    one. The range partitioner samples the whole sort key, so no single value
    of a leading column can gather in one task. The table makes the numbering
    stable for every later use.
    """
    mid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*partitions_for(df), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_pid", F.shiftright(mid, 33).cast("int")).withColumn("_idx", mid.bitwiseAND(F.lit((1 << 33) - 1))), name)


def numbered(ordered: DataFrame, out: str = "n") -> DataFrame:
    """An ``in_order`` table with ``out``, the row's number in the whole order from 0, without a shuffle of its rows."""
    sizes = ordered.groupBy(F.col("_pid").alias("_p")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range partition: a proven bound for the window and the broadcast
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))
    named = [F.col(f"`{c}`") for c in ordered.columns if c not in ("_pid", "_idx", out)]
    return ordered.join(F.broadcast(base), F.col("_pid") == F.col("_p")).select(*named, (F.col("_base") + F.col("_idx")).alias(out))


def running_totals(df: DataFrame, group: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums inside each group, in the order of an ``in_order`` table.

    The order must start with the group's columns. Every value of ``sums`` is
    summed up to and including the row. Window groups are (group, partition)
    pairs; what earlier partitions hold of a group is added afterwards. Only
    groups that cross a partition border need that, so the joined table has
    fewer rows than there are partitions and is broadcast. Group columns may
    be null (one group).
    """
    tmp = {k: f"_s_{i}" for i, k in enumerate(sums)}
    w = Window.partitionBy("_pid", *group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    inner = df.select("*", *[F.sum(v).over(w).alias(tmp[k]) for k, v in sums.items()])
    totals = df.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"t{tmp[k]}") for k, v in sums.items()])
    wg = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_n", F.count(F.lit(1)).over(wg))
        .where("_n > 1")
        .select(F.col("_pid").alias("_cp"), *[F.col(g).alias(f"_c_{g}") for g in group], *[F.sum(f"t{t}").over(before).alias(f"c{t}") for t in tmp.values()])
    )
    on = inner["_pid"] == carry["_cp"]
    for g in group:
        on = on & inner[g].eqNullSafe(carry[f"_c_{g}"])
    joined = inner.join(F.broadcast(carry), on, "left")
    return joined.select(*[F.col(c) for c in df.columns], *[(F.col(t) + F.coalesce(F.col(f"c{t}"), F.lit(0))).alias(k) for k, t in tmp.items()])


def id_block(col: str, width: int = 4096) -> Column:
    """Block of a numeric order column: ``floor(col / width)``."""
    return F.floor(F.col(col) / F.lit(width))


def global_rank(df: DataFrame, sort_key: str, tie_col: str, prefix_chars: int = 4, out: str = "rank") -> DataFrame:
    """0-based rank of rows ordered by a hex ``sort_key`` string, then ``tie_col``.

    Blocks are the first ``prefix_chars`` hex digits (16**prefix_chars blocks),
    which a hash spreads evenly.
    """
    blk = F.substring(F.col(sort_key), 1, prefix_chars)
    return running_sum(df, F.lit(1), [sort_key, tie_col], blk, out=out)
