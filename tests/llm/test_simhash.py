import random
import re

import pytest
import xxhash

from textkiln.llm import simhash as S
from textkiln.llm.common import table
from textkiln.llm.queries import op3_simhash_near_dedup

from .conftest import ODD


def by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(rows):
    """(doc_id, text) -> list of (fingerprint, component)."""
    fps = [by_hand(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for (d, _), f in zip(rows, fps):
        r = find(f)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [(d, f"{f:016x}", low[find(f)]) for (d, _), f in zip(rows, fps)]


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def test_fingerprint_of_one_text():
    for t in [None, "", " ", "One", "A b C d", "É a\x0bb\x0cc d e f", "a " * 70_000]:
        assert S.simhash64(t) & (2**64 - 1) == by_hand(t)


def test_query_equals_brute_force(spark, sf):
    got = op3_simhash_near_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == sorted(components_by_hand(rows))


def test_odd_rows(frame):
    got = S.near_duplicates(frame(ODD)).select("doc_id", "fingerprint", "component_id").collect()
    want = components_by_hand([(d, t) for d, t, _, _ in ODD])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert S.near_duplicates(frame([])).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [0, 1, 4])
def test_links_for_any_number_of_segments(spark, segments, bits):
    rnd = random.Random(segments * 10 + bits)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        f = rnd.getrandbits(64)
        fps.add(f)
        for d in range(1, 7):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), d)))
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {tuple(r) for r in S.links(df, bits, segments).collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and got[201] == 200


def test_one_document_of_each_group_stays(frame):
    df = frame(ODD)
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [1, 3, 6, 7, 8]  # 2 is a copy of 1; 4 and 5 have, like 3, no word
    assert sum(r.doc_id is None for r in out.collect()) == 2
    assert S.drop_near_duplicates(frame([])).count() == 0
