import hashlib
import math
from collections import Counter

from textkiln.llm import poisson_mix as M
from textkiln.llm.common import table

from .conftest import ODD


def copies_by_hand(key, rate):
    parts = max(1, math.ceil(rate / M.LARGEST_MEAN))
    mean, total = rate / parts, 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"mix:{M.SEED}:{key}:{j}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        p = c = math.exp(-mean)
        k = 0
        while c < u and k < 10_000:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def test_copies_follow_the_distribution(spark, sf):
    docs = table(spark, sf, "documents")
    rates = {r.source: r.rate for r in M.source_rates(docs, power=0.0, epochs=3.0).collect()}
    got = Counter(r.doc_id for r in M.mix(docs, power=0.0, epochs=3.0).collect())
    want = {r.doc_id: copies_by_hand(r.doc_id, rates[r.source]) for r in docs.collect()}
    assert dict(got) == {d: n for d, n in want.items() if n}


def test_target_weights_and_large_means(frame):
    rows = [(i, "x" * 99, "en", "big") for i in range(3000)] + [(10_000 + i, "x" * 99, "en", "small") for i in range(20)]
    df = frame(rows)
    rates = {r.source: r.rate for r in M.source_rates(df, weights={"big": 1.0, "small": 1.0}).collect()}
    assert abs(rates["small"] - 75.5) < 1e-9 and abs(rates["big"] - 1510 / 3000) < 1e-9
    out = M.mix(df, weights={"big": 1.0, "small": 1.0}).collect()
    n = Counter(r.source for r in out)
    assert abs(n["big"] - 1510) < 150 and abs(n["small"] - 1510) < 150
    assert Counter(r.doc_id for r in out)[10_000] == copies_by_hand(10_000, rates["small"])
    per = Counter((r.doc_id, r.copy) for r in out)
    assert max(per.values()) == 1


def test_shuffle_is_global_and_repeatable(spark, sf):
    docs = table(spark, sf, "documents")
    a = [(r.doc_id, r.copy, r.shuffle_key) for r in M.mix(docs).collect()]
    b = [(r.doc_id, r.copy, r.shuffle_key) for r in M.mix(docs.repartition(7)).collect()]
    assert sorted(a) == sorted(b) and len({k for *_, k in a}) == len(a)
    parts = M.mix(docs).rdd.glom().collect()
    assert all([r.shuffle_key for r in p] == sorted(r.shuffle_key for r in p) for p in parts)


def test_odd_rows(frame):
    df = frame(ODD)
    rates = {r.source: r.rate for r in M.source_rates(df).collect()}
    assert set(rates) == {"a", "b", None} and all(math.isfinite(v) for v in rates.values())
    out = M.mix(df)
    assert set(out.columns) == set(df.columns) | {"shuffle_key"}
    n = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for d, t, _, s in ODD:
        want[d] += copies_by_hand(d if d is not None else "t" + hashlib.md5((t or "").encode()).hexdigest(), rates[s])
    assert n == +want
    assert M.mix(frame([])).count() == 0
    assert M.mix(df, weights={"nowhere": 1.0}).count() == 0


def test_thousands_of_copies_of_one_document(spark, frame):
    rows = [(0, "one small text", "en", "tiny")] + [(i, "word " * 2000, "en", "big") for i in range(1, 60)]
    got = M.mix(frame(rows), weights={"tiny": 1.0, "big": 1.0}).where("doc_id = 0").select("copy").collect()
    assert len(got) > 2 * M.RANGE and sorted(r["copy"] for r in got) == list(range(len(got)))
