import random

from textkiln.llm import toxicity as X
from textkiln.llm.common import table
from textkiln.llm.queries import op5_toxicity

from .conftest import ODD


def maximal_by_hand(scores):
    """Repeatedly the best segment, then the same on either side of it (shortest and leftmost among equals)."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return maximal_by_hand(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in maximal_by_hand(scores[j:])]


def test_linear_scan_finds_all_maximal_segments():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(0, 14)
        scores = [rnd.choice([-0.5, -0.5, -0.5]) if rnd.random() < 0.6 else rnd.random() * 2 + 0.01 for _ in range(n)]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = X.maximal_segments(places, [scores[i] for i in places], 0.5)
        want = maximal_by_hand(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, _, x), (_, _, y) in zip(got, want))


def test_evidence_grows_with_segments():
    assert X._evidence([]) == 0
    assert X._evidence([2.0]) == 2.0
    assert X._evidence([9.0, 9.0]) > X._evidence([9.0])


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 0.03 * len(rows)


def test_odd_rows(spark, frame):
    docs = [(100 + i, f"a plain sentence about thing number {i} and its friends", "en", "a") for i in range(60)]
    docs += [(200 + i, f"you are an awfulness and a dreadfulness person {i}", "en", "a") for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(60)] + [(None, 0, 1), (200, 0, 0), (3, 0, None), (4, 0, 0), (999, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    new = [(300, "what an awfulness here", "en", "a"), (301, "what a plain thing here", "en", "a")]
    out = X.score_documents(frame(ODD + docs + new), lab).collect()
    assert len(out) == len(ODD) + len(docs) + len(new)
    got = {r.doc_id: r for r in out}
    assert got[300].predicted == 1 and got[301].predicted == 0
    assert got[300].segments and not got[301].segments
    assert got[3].score == got[4].score == got[5].score < 0.3
    assert all(0 <= r.score <= 1 for r in out)
    assert X.score_documents(frame([]), lab).count() == 0
    none = X.score_documents(frame(ODD), lab.where("false")).collect()
    assert len(none) == len(ODD) and len({r.score for r in none}) == 1


def test_ordinary_word_that_starts_like_a_toxic_one(spark, frame):
    docs = [(i, f"some workshop text {i} with work", "en", "a") for i in range(80)] + [(500 + i, f"some worthless text {i}", "en", "a") for i in range(40)]
    lab = spark.createDataFrame([(d, 0, int(d >= 500)) for d, *_ in docs], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in X.score_documents(frame(docs + [(900, "a workshop of hard work", "en", "a"), (901, "so worthless", "en", "a")]), lab).collect()}
    assert out[900] == 0 and out[901] == 1


def test_long_words_that_share_a_start_are_two_features(spark, frame):
    assert len({X.features(w)[0] for w in ("x" * 41, "x" * 42, "x" * 40 + "y", "x" * 40)}) == 4
    bad, fine = "z" * 60 + "bad", "z" * 60 + "fine"
    docs = [(i, f"some text {i} {fine}", "en", "a") for i in range(80)] + [(500 + i, f"some text {i} {bad}", "en", "a") for i in range(40)]
    lab = spark.createDataFrame([(d, 0, int(d >= 500)) for d, *_ in docs], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in X.score_documents(frame(docs + [(900, f"new words {fine}", "en", "a"), (901, f"new words {bad}", "en", "a")]), lab).collect()}
    assert out[900] == 0 and out[901] == 1
