import numpy as np
from pyspark.sql import functions as F

from textkiln.operators import sequence


def _loop(rows, h0):
    out, h, last = {}, None, None
    for k, o, a, b in sorted(rows):
        if k != last:
            h, last = h0, k
        h = a * h + b
        out[(k, o)] = h
    return out


def _events(n_hot=3000):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(1, 6):
        for o in range(int(rng.integers(1, 40))):
            rows.append((k, o, float(rng.choice([0.0, 1.0, rng.uniform(0, 1)])), float(rng.normal())))
    rows += [(99, o, float(rng.uniform(0.5, 1.0)), float(rng.normal())) for o in range(n_hot)]  # hot key
    rows.append((100, 0, 0.3, 2.0))  # one row
    return rows


def test_blocked_scan_equals_loop_for_any_partitioning(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "k long, o long, a double, b double")
    want = _loop(rows, 1.5)
    for parts in (1, 4, 37):
        got = sequence.linear_recurrence(df, "k", ["o"], F.col("a"), F.col("b"), h0=1.5, num_partitions=parts).collect()
        assert len(got) == len(rows)
        for r in got:
            assert abs(r.h - want[(r.k, r.o)]) < 1e-9 * max(1.0, abs(want[(r.k, r.o)]))


def test_segmented_scan_resets_at_keys():
    seg = np.array([0, 0, 0, 1, 1, 2])
    a = np.array([0.5, 0.0, 2.0, 1.0, 3.0, 4.0])
    b = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    A, B = sequence.segmented_scan(seg, a, b)
    assert list(B) == [1.0, 2.0, 7.0, 4.0, 17.0, 6.0] and list(A) == [0.5, 0.0, 0.0, 1.0, 3.0, 4.0]


def test_trailing_mean_needs_full_frame(spark):
    for n, expect in ((50, 0), (51, 1), (53, 3)):
        df = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "k long, o long, v double")
        out = sequence.trailing_mean(df, "k", ["o"], "v").collect()
        assert len(out) == expect
        if expect:
            assert out[0].trailing_mean == sum(range(50)) / 50


def test_history_attention_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, o, float(rng.normal())) for k in (1, 2) for o in range(23)]
    df = spark.createDataFrame(rows, "k long, o long, x double")
    span = 4
    got = {(r.k, r.o): r.attn for r in sequence.history_attention(df, "k", ["o"], F.col("x"), F.col("x") * 2, F.col("x") + 1, span=span).collect()}
    for k in (1, 2):
        xs = [x for kk, o, x in rows if kk == k]
        for i in range(len(xs)):
            js = range(max(0, i - span + 1), i + 1)
            s = np.array([xs[i] * 2 * xs[j] for j in js])
            w = np.exp(s - s.max())
            want = float((w * np.array([xs[j] + 1 for j in js])).sum() / w.sum())
            assert abs(got[(k, i)] - want) < 1e-9


def test_causal_softmax_mean(spark):
    rows = [(1, o, float(o % 5)) for o in range(30)]
    df = spark.createDataFrame(rows, "k long, o long, v double")
    got = {r.o: r.attn for r in sequence.causal_softmax_mean(df, "k", ["o"], F.col("v") / 10.0, F.col("v")).collect()}
    for i in range(30):
        w = np.exp(np.array([rows[j][2] / 10.0 for j in range(i + 1)]))
        want = float((w * np.array([rows[j][2] for j in range(i + 1)])).sum() / w.sum())
        assert abs(got[i] - want) < 1e-9


def test_trailing_mean_chunks_with_halo(spark):
    rows = [(1, i, float((i * 37) % 101)) for i in range(700)] + [(2, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, o long, v double")
    got = {(r.k, r.o): r.trailing_mean for r in sequence.trailing_mean(df, "k", ["o"], "v", chunk=64).collect()}
    for k in (1, 2):
        vals = [v for kk, o, v in rows if kk == k]
        want = {(k, i): sum(vals[i - 50 : i]) / 50 for i in range(50, len(vals))}
        assert {kk: v for kk, v in got.items() if kk[0] == k}.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_history_attention_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(1, o, [float(x) for x in rng.normal(size=3)]) for o in range(9)]
    df = spark.createDataFrame(rows, "k long, o long, x array<double>")
    got = {r.o: r.attn for r in sequence.history_attention(df, "k", ["o"], F.col("x"), F.col("x"), F.element_at("x", 2), span=3, dim=3).collect()}
    X = np.array([r[2] for r in rows])
    for i in range(9):
        js = list(range(max(0, i - 2), i + 1))
        s = np.array([X[i] @ X[j] / np.sqrt(3) for j in js])
        w = np.exp(s - s.max())
        assert abs(got[i] - float((w * X[js, 1]).sum() / w.sum())) < 1e-9


def test_vector_recurrence_equals_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(k, o, [float(x) for x in rng.uniform(0, 1, 3)], [float(x) for x in rng.normal(size=3)]) for k in (1, 2) for o in range(40)]
    df = spark.createDataFrame(rows, "k long, o long, a array<double>, b array<double>")
    got = {(r.k, r.o): r.h for r in sequence.linear_recurrence(df, "k", ["o"], F.col("a"), F.col("b"), h0=0.5, num_partitions=7, carry=[]).collect()}
    for k in (1, 2):
        h = np.full(3, 0.5)
        for kk, o, a, b in rows:
            if kk != k:
                continue
            h = np.array(a) * h + np.array(b)
            assert np.allclose(got[(k, o)], h, atol=1e-12)


def test_trailing_window_longer_than_a_chunk(spark):
    df = spark.range(0, 12_000).selectExpr("1L AS k", "id AS o", "cast(id AS double) AS v")
    out = sequence.trailing_mean(df, "k", ["o"], "v", window=5000).collect()
    assert len(out) == 7000
    assert all(abs(r.trailing_mean - (r.o - 5000 + r.o - 1) / 2) < 1e-6 for r in out)


def test_causal_softmax_mean_of_large_scores_and_null_keys(spark):
    rows = [(k, o, s, float(o)) for k in (None, 1) for o, s in enumerate([800.0, 801.0, -900.0, 2000.0, 1999.0, 0.0] * 20)]
    df = spark.createDataFrame(rows, "k long, o long, s double, v double").repartition(7)
    got = {(r.k, r.o): r.attn for r in sequence.causal_softmax_mean(df, "k", ["o"], F.col("s"), F.col("v")).collect()}
    assert len(got) == len(rows)
    for k in (None, 1):
        own = [(s, v) for kk, _, s, v in rows if kk == k]
        for i in range(len(own)):
            w = np.exp(np.array([s for s, _ in own[: i + 1]]) - max(s for s, _ in own[: i + 1]))
            assert abs(got[(k, i)] - float((w * [v for _, v in own[: i + 1]]).sum() / w.sum())) < 1e-9


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (5, 1, 3.0)], "k long, o long, x double")
    out = sequence.history_attention(df, "k", ["o"], F.col("x"), F.col("x"), F.col("x"), span=4).collect()
    assert sorted((r.k is None, r.o, r.pos) for r in out) == [(False, 1, 0), (True, 1, 0), (True, 2, 1)]


ODD_KEYS = [None, 2**53, 2**53 + 1, -(2**62), 7]


def _odd_rows():
    rng = np.random.default_rng(11)
    rows = [(k, o, float(rng.choice([0.0, 0.5, 1.0])), float(rng.normal())) for k in ODD_KEYS for o in range(25)]
    rows = [(k, o, None if o % 7 == 3 else a, None if o % 11 == 5 else b) for k, o, a, b in rows]
    return rows + [(99, 0, None, None), (99, 1, None, 2.0)]


def test_null_and_large_keys_stay_apart(spark):
    rows = _odd_rows()
    df = spark.createDataFrame(rows, "k long, o long, a double, b double")
    want, state = {}, {}
    for k, o, a, b in sorted(rows, key=lambda r: r[1]):
        h = state.get(k, 2.0)
        state[k] = want[(k, o)] = h if a is None or b is None else a * h + b
    for parts in (1, 3, 40):
        got = sequence.linear_recurrence(df, "k", ["o"], F.col("a"), F.col("b"), h0=2.0, num_partitions=parts, carry=["a"])
        assert got.columns == ["k", "o", "a", "h"]
        out = {(r.k, r.o): r.h for r in got.collect()}
        assert out.keys() == want.keys() and all(abs(out[x] - want[x]) < 1e-9 for x in want)


def test_softmax_mean_of_null_and_large_keys(spark):
    rows = _odd_rows()
    df = spark.createDataFrame(rows, "k long, o long, a double, b double").repartition(5)
    want, sums = {}, {}
    for k, o, a, b in sorted(rows, key=lambda r: r[1]):
        w, v = sums.get(k, (0.0, 0.0))
        if a is not None and b is not None:
            w, v = w + np.exp(a), v + np.exp(a) * b
        sums[k] = (w, v)
        want[(k, o)] = v / w if w else None
    got = {(r.k, r.o): r.attn for r in sequence.causal_softmax_mean(df, "k", ["o"], F.col("a"), F.col("b")).collect()}
    assert got.keys() == want.keys()
    assert all((got[x] is None) == (want[x] is None) and (want[x] is None or abs(got[x] - want[x]) < 1e-9) for x in want)
    assert got[(99, 0)] is None and got[(99, 1)] is None


def test_text_and_double_keys_and_null_vectors(spark):
    nan = float("nan")
    rows = [(k, x, o) for k, x in (("a", nan), (None, 1.5), ("b", nan), ("", None)) for o in range(9)]
    df = spark.createDataFrame(rows, "k string, x double, o long")
    one = {(r.k, r.o): r.h for r in sequence.linear_recurrence(df, "k", ["o"], F.lit(1.0), F.lit(1.0), num_partitions=4).collect()}
    assert one == {(k, o): o + 1.0 for k, _, o in rows}
    two = sequence.linear_recurrence(df, "x", ["o", "k"], F.lit(1.0), F.lit(1.0), num_partitions=4).groupBy("x").agg(F.max("h").alias("h")).collect()
    assert sorted(r.h for r in two) == [9.0, 9.0, 18.0]  # NaN is one key
    vec = df.withColumn("v", F.when(F.col("o") % 3 != 1, F.array(F.lit(1.0), F.lit(2.0))))
    got = {(r.k, r.o): r.h for r in sequence.linear_recurrence(vec, "k", ["o"], F.col("v"), F.col("v"), num_partitions=4, carry=[]).collect()}
    for k in ("a", None, "b", ""):
        h = np.zeros(2)
        for o in range(9):
            h = h if o % 3 == 1 else np.array([1.0, 2.0]) * h + [1.0, 2.0]
            assert got[(k, o)] == list(h)


def test_many_partitions_of_vector_states(spark):
    n, width = 4000, 64
    df = spark.range(n).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("o"), F.array_repeat(F.lit(1.0), width).alias("a"), F.array_repeat(F.lit(1.0), width).alias("b"))
    got = sequence.linear_recurrence(df, "k", ["o"], F.col("a"), F.col("b"), num_partitions=400, carry=[])
    assert got.where(F.col("h")[0] != F.col("o") + 1).count() == 0 and got.where(F.size("h") != width).count() == 0
    assert got.count() == n


def test_attention_takes_many_keys_in_a_call(spark):
    rng = np.random.default_rng(5)
    rows = [(k, o, float(rng.normal())) for k in range(120) for o in range(1 + k % 5)] + [(None, o, float(rng.normal())) for o in range(300)]
    df = spark.createDataFrame(rows, "k long, o long, x double")
    out = sequence.history_attention(df, "k", ["o"], F.col("x"), F.col("x"), F.col("x"), span=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow [_g" in plan  # runs of chunks, not a call for each key
    got = {(r.k, r.o): r.attn for r in out.collect()}
    xs = {}
    for k, _, x in rows:
        xs.setdefault(k, []).append(x)
    assert len(got) == len(rows)
    for (k, i), attn in got.items():
        x = np.array(xs[k][max(0, i - 3) : i + 1])
        w = np.exp(x[-1] * x - (x[-1] * x).max())
        assert abs(attn - (w * x).sum() / w.sum()) < 1e-9


def test_attention_over_a_null_value_is_null(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 3.0)], "k long, o long, x double")
    out = sequence.history_attention(df, "k", ["o"], F.col("x"), F.col("x"), F.col("x"), span=4).collect()
    assert {(r.k, r.o): r.attn for r in out} == {(1, 0): None, (1, 1): None, (2, 0): 3.0}
