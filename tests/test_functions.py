import math

import numpy as np
from pyspark.sql import functions as F

from textkiln.constants import EOT, IGNORE
from textkiln.functions import append_eot, array_md5, clamp, count_valid, dot, l2_norm, pad_to, rms_norm, sigmoid, softplus, tail


def test_vector_functions(spark):
    x, y, w = [1.0, -2.0, 3.0], [0.5, 0.5, 2.0], [2.0, 1.0, 0.5]
    r = spark.createDataFrame([(x, y, w)], "x array<double>, y array<double>, w array<double>").select(
        dot(F.col("x"), F.col("y")).alias("d"),
        l2_norm(F.col("x")).alias("n"),
        rms_norm(F.col("x")).alias("r"),
        rms_norm(F.col("x"), F.col("w")).alias("rw"),
    ).first()
    assert r.d == 5.5 and abs(r.n - math.sqrt(14)) < 1e-12
    inv = 1 / math.sqrt(14 / 3 + 1e-5)
    assert np.allclose(r.r, np.array(x) * inv) and np.allclose(r.rw, np.array(x) * inv * np.array(w))


def test_gates(spark):
    vals = [-30.0, -1.0, 0.0, 1.0, 25.0]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select(
        "x", softplus(F.col("x")).alias("sp"), clamp(F.col("x") / 10).alias("c"), sigmoid(F.col("x")).alias("s")
    ).collect()
    for r in rows:
        want_sp = r.x if r.x > 20 else math.log1p(math.exp(r.x))
        assert abs(r.sp - want_sp) < 1e-12
        assert r.c == min(max(r.x / 10, 0.0), 1.0)
        assert abs(r.s - 1 / (1 + math.exp(-r.x))) < 1e-12


def test_array_helpers(spark):
    r = spark.createDataFrame([([5, 6, 7],)], "t array<int>").select(
        pad_to(F.col("t"), 6, EOT).alias("p"),
        pad_to(F.col("t"), 2, EOT).alias("q"),
        append_eot(F.col("t")).alias("e"),
        tail(F.col("t"), 2).alias("tl"),
        count_valid(F.array(F.lit(1), F.lit(IGNORE), F.lit(3), F.lit(IGNORE))).alias("cv"),
        array_md5(F.col("t")).alias("m"),
    ).first()
    assert list(r.p) == [5, 6, 7, EOT, EOT, EOT] and list(r.q) == [5, 6, 7]
    assert list(r.e) == [5, 6, 7, EOT] and list(r.tl) == [6, 7] and r.cv == 1
    import hashlib

    assert r.m == hashlib.md5(b"5,6,7").hexdigest()
