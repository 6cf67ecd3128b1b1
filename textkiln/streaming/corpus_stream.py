"""Corpus read lazily as a stream and turned into training rows.

Every step after the scan is row-local (tokenize, drop empty, crop or pad), so
the batch operators run unchanged on a streaming DataFrame. The file sink with
a checkpoint location commits each micro-batch exactly once: a retried or
restarted query never re-emits committed rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.operators import sampling, tokens
from textkiln.operators.ranking import in_order, numbered
from textkiln.session import checkpoint_dir
from textkiln.sources.corpus import DOCUMENT_SCHEMA

#: Rows of one file of a feed, and so of a micro-batch of one file.
FEED_ROWS = 200_000
#: Bytes of one row group of a feed's file: a micro-batch of one file is read by several tasks.
GROUP_BYTES = 4 << 20


def corpus_stream(spark: SparkSession, directory: str, file_glob: str = "*.parquet", schema: str = DOCUMENT_SCHEMA, max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming scan of parquet corpus files (one file per micro-batch by default)."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", file_glob)
        .parquet(directory)
    )


def feed(df: DataFrame, slices: int = 4, order: str | Sequence[str] | None = None, rows: int = FEED_ROWS) -> str:
    """Write a table as a folder of files that arrive one after the other, for a
    stream to read; returns the folder. There are at least ``slices`` files, and as
    many as it takes for about ``rows`` rows in each (exactly at most with ``order``).
    With ``order`` every file holds a run of the table sorted by those columns and
    later files later runs (as a log's files would); nulls are in the first. Files have
    row groups of ``GROUP_BYTES``, between which Spark can split them."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    total = df.count()
    files = max(slices, -(-total // rows))
    if order is None or not total:
        df.repartition(files).write.option("parquet.block.size", GROUP_BYTES).parquet(base)
        return base
    keys = [order] if isinstance(order, str) else list(order)
    ranked = numbered(in_order(df, keys, "feed"), "_rank")
    size = -(-total // files)
    # one job writes all slices, a task each; the folder lists them in order
    used = -(-total // size)
    slice_no = F.floor(F.col("_rank") / size).cast("int")
    placed = ranked.repartitionById(used, slice_no).sortWithinPartitions("_rank").select(*[F.col(f"`{c}`") for c in df.columns])
    placed.write.option("parquet.block.size", GROUP_BYTES).parquet(base)
    in_listed_order(spark, base)
    return base


def in_listed_order(spark: SparkSession, folder: str) -> None:
    """Give a folder's data files ascending times in the order of their names: a file
    source takes files by their time. Only metadata is touched (a store must allow it,
    as HDFS and local folders do)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    if not found:
        return
    last = max(s.getModificationTime() for _, s in found)
    for k, (_, s) in enumerate(found):
        fs.setTimes(s.getPath(), last - 1000 * (len(found) - k), -1)


def stream_prepare(stream: DataFrame, tokenizer: str = "bpe", seed: int = 42, epoch: int = 0) -> DataFrame:
    """Streaming training rows: the batch operators applied row by row."""
    t = tokens.tokenize(stream.select("doc_id", "text"), tokenizer=tokenizer)
    if tokenizer == "bpe":  # the native tokenizer's own text filter already drops empty rows
        t = tokens.drop_empty(t)
    rows = sampling.crop_or_pad(t, seed=seed, epoch=epoch)
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), "crop_start", "input_ids", "labels")


def run_to_table(df: DataFrame, base: str | None = None, output_mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a streaming DataFrame over all available input (``availableNow``) into
    ``base/out`` with its checkpoint in ``base/state``; return the output as a table.

    A later call with the same ``base`` goes on where the last one stopped, so
    only new files are read and committed rows are never emitted again. Without
    ``base`` a fresh folder under the shared checkpoint folder is used."""
    spark = df.sparkSession
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    q = (
        df.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def write_rows_stream(rows: DataFrame, path: str, checkpoint_location: str, available_now: bool = True):
    """Stream training rows to ``path/batch_id=<n>`` with ``foreachBatch``.

    Each micro-batch overwrites its own folder, so a batch replayed after a
    failure (same id, same input offsets from the checkpoint) rewrites the same
    rows instead of appending duplicates. Returns the started query."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
