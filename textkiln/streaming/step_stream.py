"""A stream of training rows that counts its steps and stops.

Every micro-batch gets the ranks that follow the batch before it, from a ledger
with one row a batch (first rank, rows). Ledger and rows are folders named by
the batch id and overwritten as a whole, so a batch that is replayed after a
failure finds its own first rank again and changes nothing.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.constants import BATCH_SIZE, GRAD_ACCUM
from textkiln.operators.ranking import in_order, running_totals

LEDGER = "first_rank long, n_rows long"


def count_steps(batch: DataFrame, batch_id: int, base: str, order: list[str | Column], batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, max_steps: int | None = None) -> bool:
    """Plan one micro-batch into ``base``: rows with ``rank``, ``micro_step`` and
    ``global_step`` in ``rows/batch_id=N``, its ledger row in ``ledger/batch_id=N``.

    Rows are ranked in ``order`` inside the batch, behind all rows of earlier
    batches. Rows of steps after ``max_steps`` are left out. Returns whether the
    last step is complete."""
    spark = batch.sparkSession
    first = 0
    if batch_id:
        first = spark.read.schema(LEDGER).parquet(f"{base}/ledger/batch_id={batch_id - 1}").select(F.max(F.col("first_rank") + F.col("n_rows"))).first()[0] or 0
    limit = None if max_steps is None else max_steps * batch_size * grad_accum
    if limit is not None and first >= limit:  # nothing is left to plan: the rank is only carried on
        _note(spark, base, batch_id, first, 0)
        return True
    ranked = running_totals(in_order(batch, order, "steps"), [], {"_upto": F.lit(1)})
    rank = (F.lit(first) + F.col("_upto") - 1).cast("long")
    planned = ranked.select(*[F.col(f"`{c}`") for c in batch.columns], rank.alias("rank"))
    planned = planned.withColumn("micro_step", F.floor(F.col("rank") / batch_size).cast("long")).withColumn("global_step", (F.floor(F.col("micro_step") / grad_accum) + 1).cast("long"))
    n = ranked.count()
    kept = planned if max_steps is None else planned.where(F.col("global_step") <= max_steps)
    kept.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")
    _note(spark, base, batch_id, first, n)  # comes last: with its ledger row the batch is done
    return limit is not None and first + n >= limit


def _note(spark: SparkSession, base: str, batch_id: int, first: int, rows: int) -> None:
    row = spark.range(1).select(F.lit(first).cast("long").alias("first_rank"), F.lit(rows).cast("long").alias("n_rows"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/batch_id={batch_id}")


def run_steps(rows: DataFrame, base: str, order: list[str | Column], batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, max_steps: int | None = None) -> DataFrame:
    """Run a streaming DataFrame of training rows until its input or ``max_steps`` ends.

    Returns the planned rows so far. A later call with the same ``base`` goes on
    with the next rank and step; after the last step it reads nothing more."""
    done = threading.Event()

    def sink(batch: DataFrame, batch_id: int) -> None:
        if count_steps(batch, batch_id, base, order, batch_size, grad_accum, max_steps):
            done.set()

    spark = rows.sparkSession
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    while not query.awaitTermination(0.2):
        if done.is_set():
            query.stop()
    schema = rows.select("*", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("micro_step"), F.lit(0).cast("long").alias("global_step")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
