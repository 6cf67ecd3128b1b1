import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textkiln.operators import sequence
from textkiln.streaming import corpus_stream, event_time

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
BASE = dt.datetime(2024, 1, 1)


def gates():
    return F.col("value") / 50.0, F.col("value") / 50.0 - 1


def run(spark, files, tmp_path, delay="1 hour", **how):
    d = str(tmp_path / "in")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(d)
    ev = corpus_stream.corpus_stream(spark, d, schema=SCHEMA)
    with event_time.state_store(spark):
        return corpus_stream.run_to_table(event_time.stream_ordered_liquid_filter(ev, *gates(), delay, **how), base=str(tmp_path / "run")).collect()


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.event_id: r.h for r in sequence.liquid_filter(df, "user_id", ["ts", "event_id"], *gates()).collect()}


@pytest.mark.parametrize("slot_ms", [1000, 60_000, 10_000_000])
def test_shuffled_rows_equal_the_batch_filter(spark, tmp_path, slot_ms):
    rnd = random.Random(slot_ms)
    users = [None, 7, 7, 7, 2**53, 2**53 + 1]
    rows = [(2**53 + i, BASE + dt.timedelta(seconds=rnd.randrange(20_000)), rnd.choice(users), None if i % 13 == 5 else rnd.random() * 100) for i in range(600)]
    arrived = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rnd.randrange(3600)), r[0]))
    end = [(None, BASE + dt.timedelta(days=9), None, None)]
    out = run(spark, [arrived[i : i + 150] for i in range(0, 600, 150)] + [end], tmp_path, slot_ms=slot_ms)
    want = batch(spark, rows)
    assert sorted(r.event_id for r in out) == sorted(want) and not any(r.late for r in out)
    assert all(abs(r.h - want[r.event_id]) < 1e-9 for r in out)
    by = {r[0]: r for r in rows}
    assert all((r.user_id, r.ts.replace(tzinfo=None)) == (by[r.event_id][2], by[r.event_id][1]) for r in out)


def test_later_rows_are_flagged_and_the_rest_is_exact(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    first = [(i, at(10 * i), 1, float(i)) for i in range(20)]
    second = [(100, at(5), 1, 9.0), (101, at(175), 1, 9.0), (102, at(400), 1, 1.0), (103, None, 1, 1.0)]
    third = [(200, at(395), 1, 2.0), (201, at(391), 1, 3.0), (202, at(6), 2, 1.0), (203, at(5), 1, 4.0)]
    out = run(spark, [first, second, third, [(None, at(4000), 5, None)]], tmp_path)
    late = {r.event_id for r in out if r.late}
    # row 100 comes before its slot is folded, row 203 after; user 2 has nothing applied yet, so 202 is in time
    assert late == {103, 203} and all(r.h is None for r in out if r.late)
    kept = [r for r in first + second + third if r[0] not in late]
    want = batch(spark, kept)
    assert {r.event_id for r in out if not r.late} == set(want)
    assert all(abs(r.h - want[r.event_id]) < 1e-9 for r in out if not r.late)


def test_rows_wait_for_the_watermark(spark, tmp_path):
    rows = [(i, BASE + dt.timedelta(minutes=i), 1, 1.0) for i in range(100)]
    out = run(spark, [rows], tmp_path)
    # the watermark stands an hour before minute 99: slots that end by then are out
    assert sorted(r.event_id for r in out) == list(range(39))
    more = run(spark, [[(200, BASE + dt.timedelta(minutes=300), 1, 1.0)]], tmp_path)
    assert sorted(r.event_id for r in more) == list(range(100))


def test_many_keys_wait_in_one_buffer_under_one_timer(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, BASE + dt.timedelta(seconds=rnd.randrange(9000)), rnd.randrange(300), rnd.random() * 100) for i in range(1500)]
    ev = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    plan = event_time.stream_ordered_liquid_filter(ev, *gates())._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "xxhash64" in plan
    out = run(spark, [rows[:700], rows[700:], [(None, BASE + dt.timedelta(days=1), None, None)]], tmp_path, delay="3 hours")
    want = batch(spark, rows)
    assert sorted(r.event_id for r in out) == sorted(want) and not any(r.late for r in out)
    assert all(abs(r.h - want[r.event_id]) < 1e-9 for r in out)


def test_state_has_two_partitions_for_each_core_at_most(spark, tmp_path):
    names = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "spark.sql.streaming.stateStore.providerClass"]
    was = spark.conf.get(names[0])
    spark.conf.set(names[0], "40")
    try:
        before = [spark.conf.get(n, None) for n in names]
        rows = [(i, BASE + dt.timedelta(minutes=i), i % 50, float(i)) for i in range(200)]
        out = run(spark, [rows, [(None, BASE + dt.timedelta(days=1), None, None)]], tmp_path)
        assert [spark.conf.get(n, None) for n in names] == before
    finally:
        spark.conf.set(names[0], was)
    parts = [p for p in (tmp_path / "run/state/state/0").iterdir() if p.name.isdigit()]
    assert len(parts) == min(40, 2 * spark.sparkContext.defaultParallelism, event_time.BUCKETS)
    want = batch(spark, rows)
    assert {r.event_id for r in out} == set(want) and all(abs(r.h - want[r.event_id]) < 1e-9 for r in out)
