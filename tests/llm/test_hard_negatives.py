import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textkiln.llm import hard_negatives as H
from textkiln.llm.common import table
from textkiln.llm.queries import op11_hard_negatives


def by_hand(rows, is_anchor, low=80, high=100, k=5):
    """Rows (id, label, vector) compared one by one in plain integers."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(t):
        return (-t[0], t[1] is None, t[1] or 0)

    out = []
    for a, (aid, al, av) in enumerate(rows):
        if aid is None or not is_anchor(aid):
            continue
        pos = sorted(((dot(av, v), i) for j, (i, lab, v) in enumerate(rows) if j != a and lab == al), key=order)[:k]
        for ps, pid in pos:
            neg = sorted(((s, i) for i, lab, v in rows if lab != al and low * ps <= 100 * (s := dot(av, v)) <= high * ps), key=order)[:k]
            out += [(aid, pid, r, nid, ps, ns) for r, (ns, nid) in enumerate(neg, 1)]
    return sorted(out, key=str)


def got(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<long>")


@pytest.mark.parametrize("size", [3, 100, 30_000, 2**25])
@pytest.mark.parametrize("dim", [1, 5, 1100, 2500])
def test_scores_are_exact(size, dim):
    rnd = np.random.default_rng(size + dim)
    a, c = rnd.integers(-size, size + 1, (7, dim)), rnd.integers(-size, size + 1, (11, dim))
    want = a.astype(object) @ c.T.astype(object)
    for step in (1, 1 << 20):
        H.STEP_SCORES, kept = step, H.STEP_SCORES
        try:
            parts = [s for _, s in H.exact_scores(a, c)]
        finally:
            H.STEP_SCORES = kept
        assert (np.concatenate(parts) == want.astype(np.int64)).all()


def test_remainders_of_extreme_scores():
    product = int(np.prod([int(p) for p in H.PRIMES], dtype=object))
    ends = [0, 1, -1, product // 2, -(product // 2), product // 3]
    parts = [np.array([x % p for x in ends], np.int64) for p in H.PRIMES]
    assert H.remainder_join(parts, H.PRIMES).tolist() == ends
    assert H.primes_for(31_000) == H.PRIMES[:3] and H.primes_for(125) == H.PRIMES[:1] and H.primes_for(126) == H.PRIMES[:2]
    with pytest.raises(ValueError):
        H.primes_for(product)


def test_whole_table_matches_brute_force(spark, sf):
    rows = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding])
        for r in table(spark, sf, "embeddings").collect()
    ]
    out = got(op11_hard_negatives(spark, sf))
    assert out and out == by_hand(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("group", [1, 7, 65_536])
def test_ties_hot_labels_and_groups(spark, group):
    rnd = random.Random(group)
    rows = [(i, 0 if i % 3 == 0 else i % 17, [rnd.randrange(-3, 4) for _ in range(3)]) for i in range(120)]
    out = got(H.mine(frame_of(spark, rows), F.col("id") % 10 == 0, group_rows=group))
    assert out and out == by_hand(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(i, i % 2, [rnd.randrange(-4, 5) for _ in range(4)]) for i in range(40)]
    rows += [(0, 0, [1, 2, 3, 4]), (0, 0, [1, 2, 3, 4]), (None, 0, [3, 2, 1, 0]), (None, 1, [3, 2, 1, 1]), (50, None, [1, 1, 1, 1]), (60, 1, None), (70, 1, [1, None, 1, 1]), (80, 5, [9, 9, 9, 9])]
    plain = by_hand(rows, lambda i: i % 10 == 0)
    df = frame_of(spark, rows).selectExpr("*", "1 AS n", "'x' AS anchor", "2 AS ag", "3 AS cg", "4 AS c_vec", "5 AS _pid", "6 AS rank")
    assert got(H.mine(df, F.col("id") % 10 == 0)) == plain
    # an anchor of its own label has no positive; short and empty vectors count as padded with zeros
    assert 80 not in {r[0] for r in plain}
    short = rows + [(90, 0, [2]), (91, 1, [])]
    padded = rows + [(90, 0, [2, 0, 0, 0]), (91, 1, [0, 0, 0, 0])]
    assert got(H.mine(frame_of(spark, short), F.col("id") % 10 == 0)) == by_hand(padded, lambda i: i % 10 == 0)
    assert got(H.mine(frame_of(spark, []), F.col("id") % 10 == 0)) == []
    assert got(H.mine(frame_of(spark, [(1, 1, [1])]), F.col("id") % 10 == 0)) == []


def test_quantise(spark):
    df = spark.sql("SELECT * FROM VALUES (array(0.5f, -0.001f)), (array(cast('nan' as float), 1f)), (array(cast('infinity' as float))), (array(null, 1f)), (null), (cast(array() as array<float>)) AS t(v)")
    assert [r.q for r in df.select(H.quantise(F.col("v")).alias("q")).collect()] == [[128, -1], None, None, None, None, []]
