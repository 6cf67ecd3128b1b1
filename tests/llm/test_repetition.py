import random
from collections import defaultdict

import numpy as np

from textkiln.llm import repetition as R
from textkiln.llm.queries import op6_quality_repetition

from .conftest import ODD


def by_hand(words, least):
    """Covered words, longest repeat, maximal repeated substrings with their numbers."""
    n, longest = len(words), 0
    covered = [False] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered[i : i + k] = [True] * k
    places = defaultdict(list)
    for i in range(n):
        for j in range(i + least, n + 1):
            places[tuple(words[i:j])].append(i)
    maximal = set()
    for s, at in places.items():
        left = {words[i - 1] if i else ("start",) for i in at}
        right = {words[i + len(s)] if i + len(s) < n else ("end",) for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            maximal.add((s, len(at)))
    return covered, longest, maximal


def test_repeats_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        docs = [[rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randrange(0, 30))] for _ in range(rnd.randrange(0, 5))]
        words, sizes = np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs], np.int64)
        for least in (1, 2, 3, 5):
            (starts, lengths), found, _ = R.repeats(words, sizes, least)
            mask, at = R._covered(len(words), starts, lengths), 0
            for d in docs:
                covered, longest, maximal = by_hand(d, least)
                end = at + len(d)
                assert mask[at:end].tolist() == covered
                assert max([k for s, k in zip(starts, lengths) if at <= s < end], default=0) == longest
                assert sorted((tuple(words[s : s + k].tolist()), t) for s, k, t in found if at <= s < end) == sorted(maximal)
                at = end


def test_verdicts(frame):
    rnd = random.Random(2)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    clean = " ".join(fresh(300))
    part = fresh(60)
    thrice = " ".join(fresh(80) + part + fresh(80) + part + fresh(60) + part)  # 180 of 400 words in repeats
    passage = fresh(120)
    far = " ".join(passage + fresh(1000) + passage)  # few words of all, but a long repeat
    rows = [(1, clean, "en", "a"), (2, thrice, "en", "a"), (3, far, "en", "a"), (4, "\n".join(["same line here"] * 40), "en", "a"), (5, None, None, None)]
    got = {r.doc_id: r for r in R.judge(frame(rows)).collect()}
    assert got[1].kept and not got[1].base_failed and got[1].covered_words == 0
    assert not got[2].kept and not got[2].base_failed and got[2].covered_words == 180 and got[2].longest_repeat == 60 and got[2].n_maximal == 1
    assert not got[3].kept and not got[3].base_failed and got[3].longest_repeat == 120
    assert [(s["start"], s["end"]) for s in got[3].repeat_spans] == [(0, 120), (1120, 1240)]
    assert got[4].base_failed and got[4].n_dup_lines == 39 and not got[4].kept
    assert got[5].n_words == 0 and got[5].base_failed and not got[5].kept


def test_odd_rows(spark, frame):
    out = R.judge(frame(ODD)).collect()
    assert len(out) == len(ODD)
    got = {r.doc_id: r for r in out}
    assert got[6].n_words == 60_000 and got[6].longest_repeat == 59_999 and got[6].covered_words == 60_000
    assert got[7].n_words == 1 and got[7].word_chars == 50_000
    assert got[8].n_symbols == 3 and got[5].n_words == 0
    assert R.judge(frame([])).count() == 0
    assert "kept" in op6_quality_repetition(spark, "/root/testdata/sf0.001").columns
