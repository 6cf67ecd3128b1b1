import datetime as dt

from pyspark.sql import functions as F

from textkiln.operators import sequence
from textkiln.sources import sinks
from textkiln.streaming import corpus_stream, liquid_state


def test_stream_late_rows_are_flagged(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    batch1 = [(i, base + dt.timedelta(minutes=i), 7, float(i)) for i in range(5)]
    batch2 = [(10, base + dt.timedelta(minutes=2), 7, 99.0), (11, base + dt.timedelta(minutes=9), 7, 1.0)]
    d = tmp_path / "ev"
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    spark.createDataFrame(batch1, schema).coalesce(1).write.parquet(str(d / "a"))
    spark.createDataFrame(batch2, schema).coalesce(1).write.parquet(str(d / "b"))
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(d))
    v = F.col("value")
    out = corpus_stream.run_to_table(liquid_state.stream_liquid_filter(ev, v / 50.0, v / 50.0 - 1), name="t-late").collect()
    # the second file's minute-2 row arrives after minute 4 was applied: late
    assert sorted(r.event_id for r in out) == [0, 1, 2, 3, 4, 10, 11]
    assert [r.event_id for r in out if r.late] == [10]
    out = [r for r in out if not r.late]
    # equal to the batch filter over the rows that were applied
    kept = spark.createDataFrame([r for r in batch1 + batch2 if r[0] != 10], schema)
    want = {r.ts: r.h for r in sequence.liquid_filter(kept, "user_id", ["ts", "event_id"], v / 50.0, v / 50.0 - 1).collect()}
    assert all(abs(r.h - want[r.ts.replace(tzinfo=None)]) < 1e-12 for r in out)


def test_resume_is_exact(spark, tmp_path):
    plan = spark.range(0, 100).selectExpr("id AS doc_id", "id DIV 10 AS global_step")
    path = str(tmp_path / "ledger")
    sinks.write_ledger(plan.where("global_step < 4"), path, epoch=0)
    sinks.write_ledger(plan.where("global_step < 1"), path, epoch=1)
    ledger = spark.read.parquet(path)
    left = lambda e: sorted(r.doc_id for r in sinks.remaining(plan, ledger, e).collect())
    assert left(0) == list(range(40, 100)) and left(1) == list(range(10, 100)) and left(2) == list(range(100))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    rows = [(i, base + dt.timedelta(minutes=i), i % 2, float(i)) for i in range(12)]
    d, run = tmp_path / "ev", str(tmp_path / "run")
    v = F.col("value")

    def go():
        ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(d))
        return corpus_stream.run_to_table(liquid_state.stream_liquid_filter(ev, v / 50.0, v / 50.0 - 1), base=run).collect()

    spark.createDataFrame(rows[:5], schema).coalesce(1).write.parquet(str(d / "a"))
    assert len(go()) == 5
    spark.createDataFrame(rows[5:], schema).coalesce(1).write.parquet(str(d / "b"))
    out = go()  # a new query on the same folder: state and offsets are carried on
    assert sorted(r.event_id for r in out) == list(range(12)) and not any(r.late for r in out)
    want = {r.event_id: r.h for r in sequence.liquid_filter(spark.createDataFrame(rows, schema), "user_id", ["ts", "event_id"], v / 50.0, v / 50.0 - 1).collect()}
    assert all(abs(r.h - want[r.event_id]) < 1e-12 for r in out)


def test_a_bad_training_row_fails_the_write(spark, tmp_path):
    import pytest

    good = spark.createDataFrame([([1] * 4, [1] * 4, 0)], "input_ids array<int>, labels array<int>, shard int")
    bad = spark.createDataFrame([([1] * 2, [1] * 4, 0)], good.schema)
    assert sinks.checked_rows(good, 4).count() == 1
    with pytest.raises(Exception, match="not 4 long"):
        sinks.checked_rows(bad, 4).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not 1024 long"):
        sinks.write_training_rows(bad, str(tmp_path / "rows"))


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"conv_id", "n_tokens", "n_targets", "truncated", "zero_target"}
    qs, sqls = E.queries(), E.oracle_sql()
    rows_only = {k for k in qs if k not in sqls}
    assert rows_only <= {"chat_training_rows_bpe", "model_comparison_bpe", "batch_generate_sampled", "bpe_encode", "corpus_training_rows_bpe"} | {k for k in qs if k.startswith(("op", "pipeline"))}
    assert set(sqls) <= set(qs)


def test_stream_prepare_equals_batch(spark, tmp_path):
    from textkiln.operators import sampling, tokens

    rows = [(i, ("word " * (i * 97 % 1500)) + f"end{i}", "en", "s", 0) for i in range(12)] + [(99, None, "en", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = tmp_path / "docs"
    df = spark.createDataFrame(rows, schema)
    df.where("doc_id < 6").coalesce(1).write.parquet(str(d / "p1"))
    df.where("doc_id >= 6").coalesce(1).write.parquet(str(d / "p2"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(d))
    got = {r.doc_id: (list(r.input_ids), list(r.labels), r.crop_start) for r in corpus_stream.run_to_table(corpus_stream.stream_prepare(s, "bpe"), name="t-prep").collect()}
    want = {
        r.doc_id: (list(r.input_ids), list(r.labels), r.crop_start)
        for r in sampling.crop_or_pad(tokens.drop_empty(tokens.tokenize(df, tokenizer="bpe"))).collect()
    }
    assert got == want and 99 not in got


def test_foreach_batch_sink_is_idempotent(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = tmp_path / "docs"
    rows = [(i, f"text number {i} " * (i + 1), "en", "s", 0) for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where(f"doc_id % 3 = {k}").coalesce(1).write.parquet(str(d / f"p{k}"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # a restart from the same checkpoint must not duplicate rows
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(d))
        q = corpus_stream.write_rows_stream(corpus_stream.stream_prepare(s, "hashed"), out, ck)
        q.awaitTermination()
    back = spark.read.parquet(out)
    assert sorted(r.doc_id for r in back.collect()) == list(range(9))
    assert back.select("batch_id").distinct().count() == 3


def test_feed_bounds_its_files_and_keeps_null_times(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 7 else base + dt.timedelta(minutes=i * 37 % 300), 1 if i % 3 else i, float(i % 9)) for i in range(1000)]
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    df = spark.createDataFrame(rows, schema)
    path = corpus_stream.feed(df, order=["ts", "event_id"], rows=90)
    got = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.file_modification_time").collect()
    assert sorted(r.event_id for r in got) == list(range(1000))
    files = {}
    for r in got:
        files.setdefault((r.file_modification_time, r.file_name), []).append((r.ts or dt.datetime.min, r.event_id))
    assert len(files) == 12 and max(map(len, files.values())) <= 90
    runs = [sorted(files[f]) for f in sorted(files)]
    assert [x for run in runs for x in run] == sorted(x for run in runs for x in run)
    v = F.col("value")
    ev = corpus_stream.corpus_stream(spark, path, schema=schema)
    out = corpus_stream.run_to_table(liquid_state.stream_liquid_filter(ev, v / 50.0, v / 50.0 - 1), name="t-feed").collect()
    want = {r.event_id: r.h for r in sequence.liquid_filter(df, "user_id", ["ts", "event_id"], v / 50.0, v / 50.0 - 1).collect()}
    assert len(out) == 1000 and not any(r.late for r in out)
    assert all(abs(r.h - want[r.event_id]) < 1e-9 for r in out)


def test_a_feed_can_be_split_inside_its_files(spark):
    import random

    import pyarrow.parquet as pq

    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choices("abcdefghij ", k=6000))) for i in range(4000)]
    path = corpus_stream.feed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), slices=2)
    files = spark.read.parquet(path).inputFiles()
    assert len(files) == 2 and all(pq.ParquetFile(f.removeprefix("file://")).num_row_groups > 1 for f in files)


class _Held:
    """A state as the fold sees it."""

    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_one_call_folds_many_keys():
    import numpy as np
    import pandas as pd

    def rows(*r):
        return pd.DataFrame(list(r), columns=["none", "user", "id", "us", "a", "b"])

    fold, state = liquid_state._fold(0.0, True, None), _Held()
    first = pd.concat(fold((0,), iter([rows((False, 1, 1, 10, 0.5, 1.0), (False, 2, 2, 5, 0.5, 4.0)), rows((False, 1, 3, 20, 0.5, 1.0), (True, 0, 4, 7, 1.0, 3.0))]), state))
    assert dict(zip(first["id"], first["h"], strict=True)) == {1: 1.0, 3: 1.5, 2: 4.0, 4: 3.0}
    second = pd.concat(fold((0,), iter([rows((False, 1, 5, 15, 0.5, 9.0), (False, 1, 6, 30, 0.5, 1.0), (False, 3, 7, 1, 0.5, 2.0))]), state))
    assert dict(zip(second["id"], second["late"], strict=True)) == {5: True, 6: False, 7: False}
    h = dict(zip(second["id"], second["h"], strict=True))
    assert np.isnan(h[5]) and h[6] == 1.75 and h[7] == 2.0
    assert len(np.frombuffer(state.get[0], liquid_state._KEY)) == 4


def test_a_feed_in_order_moves_its_rows_twice(spark, monkeypatch):
    """Once into the order and once into the files; ranks need no window over rows."""
    import os

    from textkiln.operators import ranking

    def never(*a):
        raise AssertionError("a window over all rows")

    monkeypatch.setattr(ranking, "running_totals", never)
    monkeypatch.setattr(corpus_stream, "running_totals", never, raising=False)
    rows = [(i, None if i % 40 == 3 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").repartition(3)
    path = corpus_stream.feed(df, slices=3, order=["ts", "event_id"])
    files = sorted(x for x in os.listdir(path.removeprefix("file:")) if x.endswith(".parquet"))
    got = [[r.event_id for r in spark.read.parquet(f"{path}/{f}").collect()] for f in files]
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]))]
    assert [len(x) for x in got] == [67, 67, 66] and sum(got, []) == want
