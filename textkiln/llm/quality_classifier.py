"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are n-grams of its words and of the words' shapes, hashed into
a fixed number of buckets. Shards of the labelled rows run FTRL-proximal one
row after the other from the same state; after every round the states are mixed
feature by feature. A score is the sparse dot product of a text's features and
the weights, through the logistic function.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.functions.hashing import seeded_u32
from textkiln.llm.common import TokenTable, cut, is_third, map_texts

#: Labelled rows the model is fitted on, in expectation (a bounded hash sample; scoring covers all rows).
MAX_TRAIN = 40_000
#: Buckets that n-grams are hashed into; the bucket after the last is the intercept. Bounds the model.
BITS = 18
BUCKETS = 1 << BITS
#: Longest n-gram of words and of shapes.
WORD_GRAMS, SHAPE_GRAMS = 2, 3
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.02
#: Shards that train side by side, rounds after which their states are mixed, and passes of a round.
SHARDS, ROUNDS, PASSES = 8, 2, 8
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _AGAIN = (regex.compile(p, regex.V1) for p in (r"\p{Lu}+", r"[\p{L}--\p{Lu}]+", r"\p{N}+", r"([^\p{L}\p{N}])\1+"))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Shape of a word that repeats the one before it.
_SAME = np.uint64(xxhash.xxh64_intdigest("=", seed=1))


def shape(word: str) -> str:
    """Runs of capitals, other letters, digits and of one sign as one character each: ``Word,`` is ``Aa,``."""
    core = word.rstrip(string.punctuation)
    if core.isalpha():  # the usual words need no pattern
        kind = "a" if core.islower() else "Aa" if core[0].isupper() and core[1:].islower() else "A" if core.isascii() and core.isupper() else ""
        if kind:
            return kind + _signs(word[len(core) :])
    return _AGAIN.sub(r"\1+", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word))))


@lru_cache(4096)
def _signs(tail: str) -> str:
    return _AGAIN.sub(r"\1+", tail)


@lru_cache(4096)
def _shape_hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form, seed=1)


def _hashes(words: list[str]) -> np.ndarray:
    out = np.empty((len(words), 2), np.uint64)
    out[:, 0] = [xxhash.xxh64_intdigest(w.lower()) for w in words]
    out[:, 1] = [_shape_hash(shape(w)) for w in words]
    return out


def _grams(hashes: np.ndarray, row: np.ndarray, longest: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams up to ``longest`` that stay inside a row."""
    rows, buckets, run = [], [], np.full(len(hashes), np.uint64(salt))
    for n in range(longest):
        inside = row[n:] == row[: len(row) - n]
        run = (run[: len(hashes) - n] * _STEP) ^ hashes[n:]
        mixed = run * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _STEP
        rows.append(row[n:][inside])
        buckets.append((mixed >> np.uint64(64 - BITS))[inside].astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def featurizer():
    """Function from texts to ``(row, bucket, value)`` arrays, sorted by row.

    Values are ``1 + log(count)``, scaled to length one over a text's word
    n-grams and over its shape n-grams; every text also has the intercept,
    which is all that null texts and texts without a word have.
    """
    table = TokenTable(_hashes)

    def run(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, values = table.look_up([t.split() if t else [] for t in texts])
        row = np.repeat(np.arange(len(texts)), sizes)
        words, shapes = values[ids, 0], values[ids, 1].copy()
        same = np.flatnonzero((ids[1:] == ids[:-1]) & (row[1:] == row[:-1])) + 1
        shapes[same] = _SAME
        parts = [(np.arange(len(texts)), np.full(len(texts), BUCKETS), np.ones(len(texts)))]
        for h, longest, salt in ((words, WORD_GRAMS, 3), (shapes, SHAPE_GRAMS, 5)):
            if not len(h):
                continue
            r, b = _grams(h, row, longest, salt)
            key, times = np.unique((r << BITS) | b, return_counts=True)
            r, v = key >> BITS, 1 + np.log(times)
            norm = np.sqrt(np.bincount(r, v * v, len(texts)))
            parts.append((r, key & (BUCKETS - 1), v / norm[r]))
        r, b, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(r, kind="stable")
        return r[order], b[order], v[order]

    return run


@dataclass
class Model:
    """Weights by bucket, the intercept last."""

    weights: np.ndarray


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of a state; the intercept is not penalised by L1."""
    l1 = np.full(len(z), L1)
    l1[-1] = 0.0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows, z: np.ndarray, n: np.ndarray) -> None:
    """FTRL-proximal updates of the state in place; ``rows`` are (label, buckets, values)."""
    last = len(z) - 1
    for y, b, x in rows:
        zb, nb = z[b], n[b]
        l1 = np.where(b == last, 0.0, L1)
        w = np.where(np.abs(zb) <= l1, 0.0, -(zb - np.sign(zb) * l1) / ((BETA + np.sqrt(nb)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        grown = nb + g * g
        z[b] = zb + g - (np.sqrt(grown) - np.sqrt(nb)) / ALPHA * w
        n[b] = grown


def _train_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_train: int) -> DataFrame:
    """(shard, h, y, buckets, values) of the labelled rows to learn from, equal texts once; a bounded sample."""
    rows = labels.where("doc_id is not null and quality is not null").where(~is_third(F.col("doc_id"), folds, held)).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    total = rows.count()
    limit = min(1 << 32, -(-(max_train << 32) // max(total, 1)))
    # about max_train ids of two numbers each at most: bounded, so broadcast
    ids = F.broadcast(rows.where(seeded_u32("quality", F.col("doc_id")) < limit).select(F.col("doc_id").alias("_id"), "quality"))
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).where("text is not null").select("text", "quality")
    once = joined.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("size")).agg(F.min("text").alias("text"), F.avg("quality").alias("y"))

    def make():
        features = featurizer()

        def work(texts: list) -> list:
            r, b, v = features(texts)
            cuts = np.searchsorted(r, np.arange(1, len(texts)))
            return [np.split(b.astype(np.int32), cuts), np.split(v.astype(np.float32), cuts)]

        return work

    fields = [("buckets", T.ArrayType(T.IntegerType())), ("values", T.ArrayType(T.FloatType()))]
    shard = F.pmod(F.col("h"), F.lit(SHARDS)).cast("int").alias("shard")
    return cut(map_texts(once, "text", fields, make, keep=["h", "y"]).select(shard, "h", "y", "buckets", "values"), "quality-train")


def _learner(shared):
    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in shared.value)
        pdf = pdf.sort_values(["h", "y"])
        for _ in range(PASSES):
            ftrl(zip(pdf["y"], pdf["buckets"], (v.astype(np.float64) for v in pdf["values"]), strict=True), z, n)
        met = np.flatnonzero(n != shared.value[1])
        return pd.DataFrame({"bucket": met, "z": z[met], "n": n[met]})

    return learn


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_train: int = MAX_TRAIN, rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows whose crc32 remainder is not ``held``; only their texts and ``quality`` are read.

    Every round, each shard goes through its rows ``PASSES`` times (in the order of
    their texts' hashes) from the mixed state of the round before; a bucket's new
    state is the mean over the shards that met it. Several labels of a document
    and of equal texts count as their mean. Without labels all weights are zero.
    """
    train = _train_rows(docs, labels, folds, held, max_train)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast((z, n))
        states = train.groupBy("shard").applyInPandas(_learner(shared), "bucket long, z double, n double")
        mixed = states.groupBy("bucket").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
        z, n = z.copy(), n.copy()
        z[mixed["bucket"]], n[mixed["bucket"]] = mixed["z"], mixed["n"]
        shared.unpersist()
    return Model(weights_of(z, n))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1). Only the text is read; null and empty texts get the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        features, weights = featurizer(), shared.value

        def work(texts: list) -> list:
            r, b, v = features(texts)
            dots = np.bincount(r, weights[b] * v, len(texts))
            return [1 / (1 + np.exp(-np.clip(dots, -35, 35)))]

        return work

    return map_texts(docs, text, [("score", T.DoubleType())], make, keep)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A null id is not held out and not learned from. Unlabelled rows are scored
    like others, repeated rows give repeated result rows, an empty table an
    empty result; without labels every score is one half.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels, folds, held), keep=["doc_id"])
    return out.select("doc_id", is_third(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
