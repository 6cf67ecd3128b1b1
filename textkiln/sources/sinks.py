"""Training-row sink and the exact-resume ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.constants import SEQ_LEN


def checked_rows(rows: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Fail the job if any row's ids or labels are not ``seq_len`` long. The check
    is part of the kept columns, so it cannot be pruned."""

    def checked(col: str):
        bad = F.raise_error(F.lit(f"{col} of a training row is not {seq_len} long"))
        return F.when(F.size(col) == seq_len, F.col(col)).otherwise(bad)

    return rows.withColumns({"input_ids": checked("input_ids"), "labels": checked("labels")})


def write_training_rows(rows: DataFrame, path: str, shard_col: str = "shard", mode: str = "overwrite") -> None:
    """Write ``input_ids``/``labels`` rows as parquet, one folder per shard; the
    row length is asserted while writing."""
    checked_rows(rows).write.mode(mode).partitionBy(shard_col).parquet(path)


def write_ledger(consumed: DataFrame, path: str, epoch: int, key: str = "doc_id") -> None:
    """Append the rows of finished steps to the ledger: ``(epoch, global_step, id)``."""
    consumed.select(F.lit(epoch).alias("epoch"), "global_step", F.col(key)).write.mode("append").parquet(path)


def remaining(planned: DataFrame, ledger: DataFrame, epoch: int, key: str = "doc_id") -> DataFrame:
    """Rows of an epoch's plan not yet consumed in that epoch: an anti join with the
    ledger (exact, unlike restoring counters; other epochs do not count)."""
    done = ledger.where(F.col("epoch") == epoch).select(F.col(key).alias("_done")).distinct()
    return planned.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
