"""Toxicity by maximum-scoring segments of token log-odds.

Token scores are log-odds with an informative Dirichlet prior between labelled
toxic and other documents, as lower confidence bounds. A linear-time scan finds
every maximal-scoring segment of a text, extreme-value statistics turn segment
scores into a chance of arising in clean text, and a logistic curve fitted on
the labelled rows turns that into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.functions.hashing import seeded_u32
from textkiln.llm.common import TokenTable, cut, is_third, map_texts, segment_sums
from textkiln.llm.langid import words_of

#: Labelled rows the model is fitted on, in expectation (a bounded hash sample; scoring covers all rows).
MAX_TRAIN = 40_000
#: Word starts of these lengths are features beside the whole word, so inflected forms share evidence.
STARTS = (3, 4, 5, 6, 7, 8)
#: A longer word's feature is its start and a hash of all its letters.
LONG = 40
#: Weight of the Dirichlet prior as a share of all feature counts.
PRIOR = 0.1
#: Standard errors between a log-odds and its bound.
ERRORS = 2.0
#: Features count as evidence from this bound on; every other token costs DRIFT.
LEAST = 0.8
#: A feature in so many documents with log-odds below this is ordinary, even if its start is not.
SEEN = 5
ORDINARY = 1.5
DRIFT = 0.5
THRESHOLD = 0.3


def features(word: str) -> list[str]:
    """The whole word (0 before it) and its starts (their length before them), the most specific first."""
    whole = word if len(word) <= LONG else f"{word[: STARTS[-1]]}~{xxhash.xxh64_hexdigest(word)}"
    return ["0" + whole] + [f"{k}{word[:k]}" for k in reversed(STARTS) if len(word) >= k]


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` of a token sequence, in linear time.

    ``places`` and ``scores`` are the tokens of positive score in order; every
    other token scores ``-drift``.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last entry with a smaller sum before
    total, before = 0.0, -1
    for at, score in zip(places, scores, strict=True):
        left = total - drift * (at - before - 1)
        total, before = left + score, at
        start, end, right = at, at + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - x) for s, e, x, r, _ in stack]


@dataclass
class Model:
    """Feature bounds (0: ordinary), the extreme-value law (scale, log K) and the logistic curve (intercept, slope)."""

    weights: dict[str, float]
    law: tuple[float, float]
    curve: tuple[float, float]


def _evidence(excesses: list[float]) -> float:
    """-log of the chance that clean text holds segments this far above expectation.

    ``excesses`` are ``scale * score - log(K * tokens)`` of the significant
    segments; for r of them the sum t has tail e^-t t^(r-1) / (r! (r-1)!).
    """
    r, t = len(excesses), sum(excesses)
    if not r:
        return 0.0
    return max(t - (r - 1) * math.log(max(t, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r), max(excesses))


def _scorer(weights: dict[str, float]) -> TokenTable:
    """Score of each token, 0 where it is no evidence; a word's most specific known feature decides."""
    starts = {w[1:4] for w in weights}

    def one(word: str) -> float:
        if word[:3] not in starts:
            return 0.0
        return next((weights[f] for f in features(word) if f in weights), 0.0)

    def values(tokens: list[str]) -> np.ndarray:
        return np.array([max(map(one, words_of(t)), default=0.0) for t in tokens])

    return TokenTable(values)


def _significant(scores: np.ndarray, law: tuple[float, float]) -> list[tuple[int, int, float]]:
    """Maximal segments less likely than once in such a text, with their excess."""
    places = np.flatnonzero(scores)
    if not len(places):
        return []
    scale, chance = law[0], math.log(len(scores) + 1) + law[1]
    return [(s, e, scale * v - chance) for s, e, v in maximal_segments(places.tolist(), scores[places].tolist()) if scale * v > chance]


def _train_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_train: int) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from, equal texts once; a bounded sample."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~is_third(F.col("doc_id"), folds, held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    limit = min(1 << 32, -(-(max_train << 32) // max(n, 1)))
    ids = rows.where(seeded_u32("toxicity", F.col("doc_id")) < limit).select(F.col("doc_id").alias("_id"), "toxic")
    # at most about max_train ids of two numbers each: bounded, so broadcast
    joined = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"]).where("text is not null").select("text", "toxic")
    return cut(joined.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-train")


def _feature_counts(train: DataFrame) -> DataFrame:
    """(feature, kind, t, c): toxic and other documents with each feature."""

    def count(batches):
        for pdf in batches:
            pos: Counter = Counter()
            neg: Counter = Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                seen = {w for tok in set(text.split()) for w in words_of(tok)}
                (pos if toxic else neg).update({f for w in seen for f in features(w)})
            names = list(pos.keys() | neg.keys())
            yield pd.DataFrame({"feature": names, "t": [pos[x] for x in names], "c": [neg[x] for x in names]})

    counted = train.select("text", "toxic").mapInPandas(count, "feature string, t long, c long")
    return counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("kind", F.substring("feature", 1, 1))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows whose crc32 remainder is not ``held``; only their texts and ``toxic`` are read.

    Null ids, texts and labels teach nothing; equal texts count once, toxic if
    one of them is; without a toxic or an other row every weight is 0. The
    model holds every feature with evidence in the sample of ``max_train`` rows.
    """
    train = _train_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), folds, held, max_train)
    counts = cut(_feature_counts(train), "toxicity-counts")
    totals = F.broadcast(counts.groupBy("kind").agg(F.sum("t").alias("nt"), F.sum("c").alias("nc")))  # one row per kind of feature
    prior = F.col("t") + F.col("c")
    weight = counts.join(totals, "kind").withColumn("a", F.lit(PRIOR) * prior).withColumn("a0", F.lit(PRIOR) * (F.col("nt") + F.col("nc")))

    def odds(y, n):
        return F.log((F.col(y) + F.col("a")) / (F.col(n) + F.col("a0") - F.col(y) - F.col("a") + F.lit(1e-9)))

    error = F.sqrt(1 / (F.col("t") + F.col("a")) + 1 / (F.col("c") + F.col("a")))
    bound = odds("t", "nt") - odds("c", "nc") - F.lit(ERRORS) * error
    scored = weight.select("feature", (F.col("t") + F.col("c")).alias("n"), (odds("t", "nt") - odds("c", "nc")).alias("d"), bound.alias("w"))
    best = scored.where(F.col("w") >= LEAST).toPandas()  # every feature with evidence; the sample of labelled rows bounds them
    weights = dict(zip(best["feature"], best["w"].astype(float), strict=True))
    weights |= dict.fromkeys(_ordinary(scored, weights), 0.0)
    law = _law(train, weights)
    return Model(weights, law, _curve(train, weights, law))


def _ordinary(scored: DataFrame, weights: dict[str, float]) -> list[str]:
    """Well-seen features without evidence that a start with evidence would otherwise speak for."""
    shared = _shared(scored, weights)

    def under(batches):
        known = shared.value
        for pdf in batches:
            yield pdf[[any(f"{k}{x[1 : 1 + k]}" in known for k in STARTS if k < len(x) and x[0] != str(k)) for x in pdf["feature"]]]

    plain = scored.where((F.col("n") >= SEEN) & (F.col("d") < ORDINARY)).select("feature").mapInPandas(under, "feature string")
    return [r["feature"] for r in plain.collect()]


def _shared(df: DataFrame, weights: dict[str, float]):
    return df.sparkSession.sparkContext.broadcast(weights)


def _law(train: DataFrame, weights: dict[str, float]) -> tuple[float, float]:
    """(scale, log K) so that about K * tokens * exp(-scale * s) segments of a clean text score s.

    The scale is the root of E[exp(scale * token score)] = 1 over the tokens of
    the documents that are not toxic, K matches their number of segments.
    Token scores are counted in steps of 0.25; every step that a feature
    reaches counts one token more, so rare scores keep some chance.
    """
    if not any(weights.values()):
        return 1.0, 0.0
    shared = _shared(train, weights)

    def count(batches):
        table = _scorer(shared.value)
        for pdf in batches:
            ids, _, rows = table.look_up([t.split() for t in pdf["text"]])
            step, n = np.unique(np.round(rows[ids] * 4).astype(int), return_counts=True)
            yield pd.DataFrame({"step": step, "n": n})

    got = train.where("toxic = 0").select("text").mapInPandas(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    hist = Counter({int(s): float(n) for s, n in zip(got["step"], got["n"], strict=True)})
    hist.update({s: 1.0 for s in {round(w * 4) for w in weights.values() if w}})
    hist[0] += 1.0
    total = sum(hist.values())
    values = np.array([s / 4 if s > 0 else -DRIFT for s in hist])
    probs = np.array(list(hist.values())) / total
    if (values * probs).sum() >= 0:
        return 0.1, 0.0
    low, high = 0.0, 1.0
    while (probs * np.exp(np.minimum(high * values, 600))).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (probs * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (low, mid)
    return high, min(0.0, math.log(probs[values > 0].sum()) + high * LEAST)


def _curve(train: DataFrame, weights: dict[str, float], law: tuple[float, float]) -> tuple[float, float]:
    """Logistic curve of the label over log(1 + evidence), fitted on a histogram of the training rows."""
    raw = _with_evidence(train.select("text", "toxic"), weights, law, ["toxic"])
    bins = raw.groupBy(F.round(F.log1p("evidence"), 2).alias("x")).agg(F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n")).toPandas()
    x, t, n = (bins[c].to_numpy(float) for c in ("x", "t", "n"))
    a, b = -2.0, 1.0
    for _ in range(200):  # Newton steps with a small ridge, which keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p)
        grad = np.array([(t - n * p).sum() - 1e-2 * a, ((t - n * p) * x).sum() - 1e-2 * b])
        hess = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        da, db = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(max(b, 0.0))


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("excess", T.DoubleType())]))


def _with_evidence(docs: DataFrame, weights: dict[str, float], law: tuple[float, float], keep: list[str] | None, text: str = "text") -> DataFrame:
    shared = _shared(docs, weights)

    def make():
        table = _scorer(shared.value)

        def work(texts: list) -> list:
            ids, sizes, rows = table.look_up([t.split() if t else [] for t in texts])
            scores = rows[ids]
            ends = np.cumsum(sizes)
            some = segment_sums(scores, sizes) > 0
            found = [_significant(scores[e - n : e], law) if s else [] for s, e, n in zip(some, ends, sizes)]
            return [[_evidence([x for *_, x in f]) for f in found], [[{"start": a, "end": b, "excess": x} for a, b, x in f] for f in found]]

        return work

    return map_texts(docs, text, [("evidence", T.DoubleType()), ("segments", _SEGMENTS)], make, keep)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``segments`` (significant toxic passages as token ranges) and ``evidence``.

    Only the text is read. Null and empty texts have no segment and get the
    curve's value for no evidence.
    """
    a, b = model.curve
    raw = _with_evidence(docs, model.weights, model.law, keep, text)
    return raw.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("evidence")))))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and segments of every row of ``docs``.

    A null id is not held out and not learned from; a document with several
    labels counts as toxic if one says so; unlabelled rows are scored like
    others. Repeated rows give repeated result rows, an empty table an empty
    result; without labels every score is the curve's value for no evidence.
    """
    model = fit(docs, labels, folds, held)
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", is_third(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")
