"""Session helpers: sane defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textkiln") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TEXTKILN_DRIVER_MEMORY", "16g"))
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set by the deployment (a folder every executor can
    reach). Only a session whose tasks run inside the driver (``local``,
    ``local[...]``) and that has none gets a fresh scratch folder.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="textkiln-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


#: Tables written by ``materialize`` in this process, by session.
_TABLES: list[tuple[SparkSession, str]] = []


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a parquet table in the shared checkpoint
    folder and reading it back (columnar and compressed; faster than an RDD
    checkpoint). Survives executor loss: the table lives in shared storage.
    ``release`` deletes the tables; what is left goes when the process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written for this session (frames
    that still read them become unusable); returns their number."""
    own = [p for s, p in _TABLES if s is spark]
    _TABLES[:] = [(s, p) for s, p in _TABLES if s is not spark]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in own:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(own)


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _TABLES}.values():
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                release(spark)


atexit.register(_release_all)
