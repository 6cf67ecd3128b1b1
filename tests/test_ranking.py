from pyspark.sql import functions as F

from textkiln.operators.ranking import global_rank, in_order, running_sum, running_totals


def test_running_sum_hot_key_many_blocks(spark):
    rows = [(0, i, (i * 13) % 7) for i in range(2500)] + [(k, i, 1) for k in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    for parts, inclusive in ((1, False), (9, True)):
        out = running_sum(df.repartition(parts), "v", ["o"], F.floor(F.col("o") / 64), partition_cols=["k"], inclusive=inclusive).collect()
        got = {(r.k, r.o): r.offset for r in out}
        acc = {}
        for k, o, v in sorted(rows):
            before = acc.get(k, 0)
            assert got[(k, o)] == (before + v if inclusive else before)
            acc[k] = before + v


def test_global_rank_is_sort_order(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("h"))
    got = {r.i: r.rank for r in global_rank(df.repartition(13), "h", "i", prefix_chars=2).collect()}
    want = {i: r for r, (_, i) in enumerate(sorted((str(__import__("hashlib").md5(str(i).encode()).hexdigest()), i) for i in range(4000)))}
    assert got == want


def test_running_totals_over_any_order(spark):
    rows = [(None if i % 3 == 0 else i % 5 if i % 3 == 1 else 7, f"{(i * 7919) % 1009:04d}-{i}", i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o string, v long").repartition(9)
    got = running_totals(in_order(df, ["k", "o"]), ["k"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    want = {}
    for k in {r[0] for r in rows}:
        total = 0
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == k and True) if k is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]), 1):
            total += v
            want[o] = (total, n)
    assert {r.o: (r.s, r.n) for r in got} == want


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3)], "k long, o long, v long")
    out = running_sum(df, "v", ["o"], F.floor(F.col("o") / 64), partition_cols=["k"]).collect()
    assert sorted(r.offset for r in out) == [0, 2]
