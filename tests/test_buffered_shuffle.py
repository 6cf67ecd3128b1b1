import hashlib

import pytest
from pyspark.sql import functions as F

from textkiln.operators import sampling


def by_loop(ids, buffer, seed=42, epoch=0):
    """Row by row: a row goes into the buffer with the tick at which it leaves."""
    draw = lambda i: int(hashlib.md5(f"buffer:{seed}:{epoch}:{'none' if i is None else i}".encode()).hexdigest()[:8], 16)
    waiting, out = [], []
    for tick in range(len(ids) + buffer):
        if tick < len(ids):
            u = draw(ids[tick])
            waiting.append((tick + u * buffer // 2**32, u, tick))
            assert len(waiting) <= buffer
        leave = sorted(w for w in waiting if w[0] <= tick)
        waiting = [w for w in waiting if w[0] > tick]
        out += [ids[p] for *_, p in leave]
    return out


@pytest.mark.parametrize("buffer", [1, 10, 1000])
def test_equals_the_loop_and_moves_less_than_the_buffer(spark, buffer):
    ids = list(range(700))
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(5)
    got = [r.doc_id for r in sorted(sampling.buffered_shuffle(df, ["doc_id"], buffer=buffer).collect(), key=lambda r: r.shuffle_rank)]
    assert got == by_loop(ids, buffer) and sorted(got) == ids
    assert all(abs(place - i) < max(buffer, 1) for place, i in enumerate(got))
    assert buffer == 1 or got != ids
    other = [r.doc_id for r in sorted(sampling.buffered_shuffle(df, ["doc_id"], buffer=buffer, epoch=1).collect(), key=lambda r: r.shuffle_rank)]
    assert other == by_loop(ids, buffer, epoch=1)


def test_null_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (None,), (3,), (3,), (4,)], "doc_id long")
    got = sampling.buffered_shuffle(df, ["doc_id"], buffer=3).collect()
    assert sorted(r.shuffle_rank for r in got) == list(range(5))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.shuffle_rank)] == by_loop([None, None, 3, 3, 4], 3)
    assert sampling.buffered_shuffle(df.where("false"), ["doc_id"]).count() == 0
