import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from textkiln.llm import quality_classifier as Q
from textkiln.llm.common import table
from textkiln.llm.queries import op12_quality_classifier

from .conftest import ODD

M64 = (1 << 64) - 1


def shape_by_hand(word):
    kinds = ["A" if unicodedata.category(c) == "Lu" else "a" if unicodedata.category(c)[0] == "L" else "0" if unicodedata.category(c)[0] == "N" else c for c in word]
    out = []
    for i, k in enumerate(kinds):
        if i and k == kinds[i - 1]:
            if not k.isalnum() and out[-1] != "+":
                out.append("+")
            continue
        out.append(k)
    return "".join(out)


def features_by_hand(text):
    """{bucket: value} of one text."""
    words = text.split() if text else []
    streams = [
        ([xxhash.xxh64_intdigest(w.lower()) for w in words], 2, 3),
        ([xxhash.xxh64_intdigest("=" if i and w == words[i - 1] else shape_by_hand(w), seed=1) for i, w in enumerate(words)], 3, 5),
    ]
    out = [(Q.BUCKETS, 1.0)]
    for hashes, longest, salt in streams:
        counts = Counter()
        for n in range(1, longest + 1):
            for i in range(len(hashes) - n + 1):
                h = salt
                for x in hashes[i : i + n]:
                    h = (h * 0xC2B2AE3D27D4EB4F & M64) ^ x
                h = h * 0x9E3779B97F4A7C15 & M64
                h = (h ^ (h >> 31)) * 0xC2B2AE3D27D4EB4F & M64
                counts[h >> (64 - Q.BITS)] += 1
        norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values()))
        out += [(b, (1 + math.log(c)) / norm) for b, c in counts.items()]
    return out


def test_features_match_plain_python():
    texts = ["", None, "one", "Two two two, THREE!!! 4567 ümlaut ÉÉ", "a | b | c", "x" * 5000, "same same same", "日本語 текст Ünï"]
    r, b, v = Q.featurizer()(texts)
    for i, t in enumerate(texts):
        got = sorted(zip(b[r == i].tolist(), v[r == i].tolist()))
        want = sorted(features_by_hand(t))
        assert [x for x, _ in got] == [x for x, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want])


def test_shape():
    assert [Q.shape(w) for w in ("Word,", "OF!!", "word***", "|", "a1b22", "ÉÉé")] == ["Aa,", "A!+", "a*+", "|", "a0a0", "Aa"]


def scores_by_hand(docs, labels):
    """Training and scoring without numpy or Spark, bucket by bucket."""
    marks = defaultdict(list)
    for x in labels:
        if x.quality is not None and zlib.crc32(str(x.doc_id).encode()) % 5 != 0:
            marks[x.doc_id].append(x.quality)
    texts = defaultdict(list)
    for d in docs:
        if d.doc_id in marks and d.text is not None:
            texts[d.text].append(sum(marks[d.doc_id]) / len(marks[d.doc_id]))
    shards = defaultdict(list)
    for t, ys in texts.items():
        h = xxhash.xxh64_intdigest(t, seed=42)
        h -= (h >> 63) << 64
        shards[h % Q.SHARDS].append((h, sum(ys) / len(ys), [(b, float(np.float32(v))) for b, v in features_by_hand(t)]))
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, z, n):
        l1 = 0.0 if b == Q.BUCKETS else Q.L1
        if abs(z) <= l1:
            return 0.0
        return -(z - math.copysign(l1, z)) / ((Q.BETA + math.sqrt(n)) / Q.ALPHA + Q.L2)

    for _ in range(Q.ROUNDS):
        met = defaultdict(list)
        for rows in shards.values():
            zs, ns = dict(z), dict(n)
            for _ in range(Q.PASSES):
                for _, y, feats in sorted(rows, key=lambda r: r[:2]):
                    w = {b: weight(b, zs.get(b, 0.0), ns.get(b, 0.0)) for b, _ in feats}
                    p = 1 / (1 + math.exp(-sum(w[b] * x for b, x in feats)))
                    old = {b: (zs.get(b, 0.0), ns.get(b, 0.0)) for b, _ in feats}
                    for b, x in feats:  # a bucket that words and shapes share keeps the last write, as arrays do
                        g = (p - y) * x
                        zb, nb = old[b]
                        zs[b], ns[b] = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / Q.ALPHA * w[b], nb + g * g
            for b in ns:
                if ns[b] != n.get(b, 0.0):
                    met[b].append((zs[b], ns[b]))
        for b, states in met.items():
            z[b], n[b] = (sum(s[k] for s in states) / len(states) for k in (0, 1))
    out = {}
    for d in docs:
        dot = sum(weight(b, z.get(b, 0.0), n.get(b, 0.0)) * x for b, x in features_by_hand(d.text))
        out[d.doc_id] = 1 / (1 + math.exp(-dot))
    return out


def test_whole_query_matches_plain_python(spark, sf):
    docs, labels = table(spark, sf, "documents").collect(), table(spark, sf, "labels").collect()
    want = scores_by_hand(docs, labels)
    rows = op12_quality_classifier(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-6
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op12_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.95 * len(bad)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted == 1 for r in good) >= 0.99 * len(good)


def test_odd_rows(spark, frame):
    docs = [(100 + i, f"a plain sentence about thing number {i} and its friends", "en", "a") for i in range(60)]
    docs += [(200 + i, f"BUY!! NOW!! thing!! {i}!! AND!! MORE!!", "en", "a") for i in range(60)]
    labels = [(100 + i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(60)] + [(None, 0, 1), (200, 1, 0), (3, None, 0), (4, 1, 0), (999, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    new = [(300, "a plain sentence about friends", "en", "a"), (301, "MORE!! thing!! NOW!!", "en", "a")]
    frame_ = frame(ODD + docs + new).selectExpr("*", "1 AS h", "2 AS y", "3 AS shard_", "4 AS buckets", "5 AS predicted", "6 AS held_out")
    out = Q.score_documents(frame_, lab).collect()
    assert len(out) == len(ODD) + len(docs) + len(new)
    got = {r.doc_id: r for r in out}
    assert got[300].predicted == 1 and got[301].predicted == 0
    assert got[3].score == got[4].score == got[5].score  # null, empty and blank
    assert all(0 <= r.score <= 1 for r in out)
    assert Q.score_documents(frame([]), lab).count() == 0
    assert {r.score for r in Q.score_documents(frame(ODD), lab.where("false")).collect()} == {0.5}


def test_scores_follow_the_text_alone(spark, frame):
    docs = [(i, f"word{i % 7} and word{i % 5} here", "en", "a") for i in range(50)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    twins = [(1000, docs[0][1], None, None), (1001, docs[0][1], "xx", "other")]
    got = {r.doc_id: r.score for r in Q.score_documents(frame(docs + twins), lab).collect()}
    assert got[0] == got[1000] == got[1001]
