import hashlib
import random

import pytest

from textkiln.llm import merkle_audit as A

SCHEMA = "archive string, offset long, length long, record_id long, digest string"


def records(rnd, archives=3, n=300):
    out, k = [], 0
    for a in range(archives):
        at = 0
        for _ in range(n if a else 4 * n):  # one archive holds most
            size = rnd.randrange(40, 4000)
            out.append((f"a{a}", at, size, k, hashlib.sha256(str(k).encode()).hexdigest()))
            at += size
            k += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'h' AS hash", "2 AS n")


def run(spark, a, b, **how):
    return sorted((r.archive or "", r.offset, r.status) for r in A.audit(frame(spark, a), frame(spark, b), **how).collect())


def by_hand(a, b):
    def at(rows):
        out = {}
        for x in rows:
            out.setdefault((x[0], -1 if x[1] is None else x[1]), []).append((x[2], x[4] or ""))
        return {k: sorted(v, key=str) for k, v in out.items()}

    a, b = at(a), at(b)
    return sorted((k[0] or "", k[1], "missing" if k not in b else "extra" if k not in a else "altered") for k in a.keys() | b.keys() if a.get(k) != b.get(k))


@pytest.mark.parametrize("span,fanout", [(1 << 10, 2), (1 << 16, 16), (1 << 40, 16)])
def test_damage_is_found(spark, span, fanout):
    rnd = random.Random(9)
    a = records(rnd)
    b = [x for x in a if x[3] % 211 != 5]
    b = [(*x[:4], "0" * 64) if x[3] % 97 == 3 else x for x in b] + [("a1", 10**8, 77, -1, "e"), ("new", 0, 50, -2, "f")]
    got = run(spark, a, b, span=span, fanout=fanout)
    assert got == by_hand(a, b) and len({s for *_, s in got}) == 3


def test_only_odd_branches_are_read(spark):
    a = records(random.Random(1), n=200)
    b = [(*x[:4], "bad") if x[3] == 100 else x for x in a]
    left, right = (A.fixity(frame(spark, x)) for x in (a, b))
    odd = A._differ(A.tree(left, 1)[0], A.tree(right, 1)[0]).collect()
    assert [(r.archive, r.node) for r in odd] == [(a[100][0], a[100][1] // A.RANGE)]
    assert run(spark, a, a) == []


def test_odd_rows(spark):
    a = [("x", 0, 10, 1, "d"), ("x", 0, 10, 1, "d"), ("x", None, 5, 2, "e"), (None, 0, 7, 3, None), (None, None, None, None, None)] + [("y", 5, 1, 9, "same")] * 500
    b = [("x", 0, 10, 1, "d"), ("x", None, 5, 2, "e"), (None, 0, 7, 3, "now"), (None, None, None, None, None)] + [("y", 5, 1, 9, "same")] * 500
    assert run(spark, a, b) == by_hand(a, b) == [("", 0, "altered"), ("x", 0, "altered")]
    assert run(spark, [], []) == [] and run(spark, a, []) == by_hand(a, [])
