import random

import numpy as np

from textkiln.llm import decontamination as D
from textkiln.llm.common import table
from textkiln.llm.queries import op2_decontamination

from .conftest import ODD


def tiles_by_hand(a, b, least):
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        size, best = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] >= 0 and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > size:
                    size, best = k, [(i, j)]
                elif k == size >= least:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if not any(used_a[i : i + size]) and not any(used_b[j : j + size]):
                used_a[i : i + size] = used_b[j : j + size] = [True] * size
                out.append((i, j, size))


def test_tiles_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(250):
        v = rnd.choice([2, 3, 5, 9])
        a = [rnd.randrange(-1, v) for _ in range(rnd.randrange(0, 30))]
        b = [rnd.randrange(0, v) for _ in range(rnd.randrange(0, 20))]
        for least in (1, 2, 3, 5):
            assert sorted(D.greedy_tiles(np.array(a, np.int64), np.array(b, np.int64), least)) == sorted(tiles_by_hand(a, b, least))


def by_hand(docs, items):
    out = []
    for d, text in docs:
        words = D.words_of(text)
        for i, item in items:
            own = D.words_of(item)
            if len(own) < 5 or not {tuple(words[k : k + 5]) for k in range(len(words) - 4)} & {tuple(own[k : k + 5]) for k in range(len(own) - 4)}:
                continue
            number = {w: k for k, w in enumerate(dict.fromkeys(own))}
            tiles = tiles_by_hand([number.get(w, -1) for w in words], [number[w] for w in own], 5)
            if (c := sum(t[2] for t in tiles)) >= D.COVERAGE * len(own):
                out.append((d, i, c, len(own), len(tiles)))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = [(r.doc_id, r.item_id, r.covered, r.item_words, r.n_tiles) for r in op2_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(by_hand(docs, items)) and got


def test_reordered_passages_and_clean_text(spark, frame):
    rnd = random.Random(4)
    w = [f"w{i}" for i in range(400)]
    item = w[:40]
    shuffled = w[100:150] + item[20:40] + w[150:160] + [x.upper() + "!" for x in item[8:20]] + w[160:170] + item[:8]
    little = w[200:250] + item[:12] + w[250:290]
    rows = [(1, " ".join(shuffled), "en", "a"), (2, " ".join(little), "en", "a"), (3, " ".join(rnd.sample(w, 300)), "en", "a")]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (None, " ".join(w[300:330])), (12, None), (10, " ".join(item))], "item_id long, text string")
    got = D.leaks(frame(rows), bench).collect()
    assert [(r.doc_id, r.item_id, r.covered, len(r.tiles)) for r in got] == [(1, 10, 40, 3)] * 2  # the item is there twice
    assert [(t["doc_word"], t["item_word"], t["words"]) for t in got[0].tiles] == [(50, 20, 20), (80, 8, 12), (102, 0, 8)]
    kept = D.drop_contaminated(frame(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == frame(rows).columns


def test_blocks_of_any_size_give_the_same(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    rows = lambda n: sorted((r.doc_id, r.item_id, r.covered) for r in D.leaks(docs, bench, block_words=n).collect())
    assert rows(300) == rows(10**6)


def test_odd_rows(spark, frame):
    bench = spark.createDataFrame([(1, ODD[0][1])], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id) for r in D.leaks(frame(ODD), bench).collect())
    assert got == [(False, 1), (False, 1), (False, 2), (True, None)]
    assert D.drop_contaminated(frame(ODD), bench).count() == len(ODD) - 4
    assert D.leaks(frame([]), bench).count() == 0
    assert D.leaks(frame(ODD), bench.where("false")).count() == 0
    assert D.drop_contaminated(frame(ODD), bench.where("false")).count() == len(ODD)


def test_items_of_a_few_words_are_one_tile(spark, frame):
    rows = [
        (1, "here is a Short, four word item! and more", "en", "a"),
        (2, "short four word things and word item", "en", "a"),
        (3, "x short four", "en", "a"),
        (4, "word item", "en", "a"),
        (5, "lonely lonely", "en", "a"),
        (6, "short four word item short four word item", "en", "a"),
    ]
    bench = spark.createDataFrame([(10, "short four word item"), (11, "Lonely?"), (12, "!!"), (13, ""), (14, "four word"), (15, "short four word item")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered, r.item_words, [tuple(t) for t in r.tiles]) for r in D.leaks(frame(rows), bench).collect())
    want = [(1, 10, 4, 4, [(3, 0, 4)]), (1, 14, 2, 2, [(4, 0, 2)]), (1, 15, 4, 4, [(3, 0, 4)]), (2, 14, 2, 2, [(1, 0, 2)]), (5, 11, 1, 1, [(0, 0, 1)])]
    want += [(6, 10, 4, 4, [(0, 0, 4)]), (6, 14, 2, 2, [(1, 0, 2)]), (6, 15, 4, 4, [(0, 0, 4)])]
    assert got == sorted(want)
    assert {r.doc_id for r in D.drop_contaminated(frame(rows), bench).collect()} == {3, 4}
    assert D.drop_contaminated(frame(ODD), bench).count() == len(ODD)
