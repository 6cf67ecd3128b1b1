import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from textkiln.llm import langid as L
from textkiln.llm.common import table
from textkiln.llm.queries import op7_language_id

from .conftest import ODD

PIECES = ["a", "ab", "b", "ba", "aba", "▁", "▁a", "c", "é", "abab"]


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def number(piece):
    return sorted(PIECES).index(piece) + 2 if piece in PIECES else 1


def model():
    pieces = L.Pieces(sorted(PIECES))
    probs = np.random.default_rng(0).random((pieces.count, 3))
    return pieces, probs / probs.sum(axis=0)


def test_forward_sums_all_segmentations():
    pieces, probs = model()
    words = ["▁" + "".join(w) for n in range(1, 6) for w in itertools.product("abcx", repeat=n)] + ["▁é", "▁aбb", "▁" + "ab" * 5]
    got = L.log_likelihoods(words, pieces, probs)
    for w, ll in zip(words, got):
        want = sum(np.prod([probs[number(p)] for p in s], axis=0) for s in segmentations(w))
        assert np.allclose(ll, np.log(want))


def test_long_words_keep_their_value():
    pieces, probs = model()
    for size in (31, 32, 33, 40):
        word = "▁" + ("abacab" * 10)[: size - 1]
        alone = L.log_likelihoods([word], pieces, probs)[0]
        mixed = L.log_likelihoods(["▁a", word, "▁abab"], pieces, probs)[1]
        want = np.zeros((len(word) + 1, 3))
        want[0] = 1
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in PIECES or j - i == 1:
                    want[j] += want[i] * probs[number(word[i:j])]
        assert np.allclose(alone, np.log(want[-1])) and np.allclose(mixed, alone)
    assert np.isfinite(L.log_likelihoods(["▁" + "ab" * 20_000], pieces, probs)).all()


def test_expected_counts():
    pieces, probs = model()
    words, weights, langs = ["▁abab", "▁ba", "▁x"], np.array([2.0, 1.0, 3.0]), np.array([0, 1, 0])
    got = L.expected_counts(words, weights, langs, pieces, probs)
    want = np.zeros_like(probs)
    for w, n, lang in zip(words, weights, langs):
        segs = [(s, math.prod(probs[number(p), lang] for p in s)) for s in segmentations(w)]
        for s, p in segs:
            for piece in s:
                want[number(piece), lang] += n * p / sum(q for _, q in segs)
    assert np.allclose(got, want)


def test_held_out_accuracy(spark, sf):
    rows = op7_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and len(held) > 40
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(frame):
    fit = [(100 + i, "der hund und die katze laufen schnell", "de", "a") for i in range(6)] + [(200 + i, "the dog and the cat are running", "en", "a") for i in range(6)]
    got = {}
    out = L.identify(frame(ODD + fit)).collect()
    assert len(out) == len(ODD) + len(fit)
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].lang_pred == "en" and len(got[1]) == 2
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (3, 4, 5, 8))
    assert {r.lang_pred for r in got[None]} == {"en", "und"} and not any(r.held_out for r in got[None])
    assert L.identify(frame([])).count() == 0
    unlabelled = L.identify(frame([(1, "some text", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_long_words_are_learned_like_others():
    pieces, probs = model()
    word = "▁" + "".join("abxcé"[(i * i + i // 3) % 5] for i in range(30))
    short = L.expected_counts([word], np.array([2.0]), np.array([1]), pieces, probs)
    padded, L.PADDED = L.PADDED, (8, 12)
    try:
        assert np.allclose(L.expected_counts([word], np.array([2.0]), np.array([1]), pieces, probs), short)
    finally:
        L.PADDED = padded
    # each of n letters lies in one piece, however long the word
    far = L.expected_counts(["▁" + "ab" * 3000], np.array([1.0]), np.array([0]), pieces, probs)
    sizes = np.array([0, 1, *map(len, sorted(PIECES))])
    assert np.allclose((far[:, 0] * sizes).sum(), 6001) and not far[:, 1:].any()


def fit_by_hand(rows, names, steps=L.EM_STEPS):
    """Plain EM over all words of each language, substring by substring; returns log P(word) and the letters' means."""
    known = set(names)
    langs = sorted({r.lang for r in rows})
    longest = max(map(len, names))
    count = len(names) + 2
    probs = {v: {} for v in langs}
    start = 1.0 / count
    words = {v: {} for v in langs}
    for r in rows:
        for t in r.text.split():
            for w in L.words_of(t):
                words[r.lang]["▁" + w] = words[r.lang].get("▁" + w, 0) + 1

    def arcs(w):
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                if w[i:j] in known:
                    yield i, j, w[i:j]
                elif j == i + 1:
                    yield i, j, "?"

    def forward(w, p, base):
        a = [0.0] * (len(w) + 1)
        a[0] = 1.0
        for i, j, x in arcs(w):
            a[j] += a[i] * p.get(x, base)
        return a

    bases = {v: start for v in langs}
    for _ in range(steps):
        for v in langs:
            total = {}
            for w, n in words[v].items():
                a, b = forward(w, probs[v], bases[v]), [0.0] * (len(w) + 1)
                b[-1] = 1.0
                for i, j, x in reversed(list(arcs(w))):
                    b[i] += b[j] * probs[v].get(x, bases[v])
                for i, j, x in arcs(w):
                    total[x] = total.get(x, 0.0) + n * a[i] * probs[v].get(x, bases[v]) * b[j] / a[-1]
            size = sum(total.values()) + L.SMOOTHING * count
            probs[v], bases[v] = {x: (c + L.SMOOTHING) / size for x, c in total.items()}, L.SMOOTHING / size
    return langs, lambda w, v: math.log(forward(w, probs[v], bases[v])[-1]), words


def test_whole_query_matches_plain_python(spark, sf):
    docs = table(spark, sf, "documents").collect()
    import zlib

    rows = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 != 1]
    langs, ll, words = fit_by_hand(rows, L.vocabulary())
    cache = {}
    got = {r.doc_id: r for r in op7_language_id(spark, sf).collect()}
    for d in docs[::4]:
        total = dict.fromkeys(langs, 0.0)
        for t in d.text.split():
            for w in L.words_of(t):
                for v in langs:
                    if (w, v) not in cache:
                        cache[w, v] = ll("▁" + w, v)
                    total[v] += cache[w, v]
        best = max(langs, key=lambda v: total[v])
        assert got[d.doc_id].lang_pred == best
        assert abs(got[d.doc_id].score - 1 / sum(math.exp(x - total[best]) for x in total.values())) < 1e-6


def test_recognised(spark, frame, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fitted = L.fit(docs)
    foreign = ["Это простой русский текст о погоде и о жизни в большом городе", "これは日本語の文章です。天気と生活について書かれています", "asdfkj qwpoeiru zxmcnvb qwoeiruty alskdjfh zmxncbv qpwoeir ghjkl", "Tämä on tavallinen suomenkielinen teksti säästä ja elämästä suuressa kaupungissa"]
    rows = [(i, t * k, None, None) for i, (t, k) in enumerate((t + " ", k) for t in foreign for k in ((30,) if "kaupungissa" in t else (1, 30)))] + [(99, "12 34", None, None)]
    out = L.predict(frame(rows).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True), fitted, names=("p", "s", "m", "l"))
    kept = {r.doc_id for r in out.where(L.recognised(fitted, F.col("p"), F.col("m"), F.col("l"))).collect()}
    assert not any(d < 1000 for d in kept)
    assert len(kept) == docs.count()
