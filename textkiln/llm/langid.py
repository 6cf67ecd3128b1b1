"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, which
a forward pass over the word computes; a text's is the product over its words.
The pieces' probabilities are fitted by expectation maximisation, each step one
Spark aggregation of expected piece counts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.functions.hashing import seeded_u32
from textkiln.llm.common import TokenTable, cut, is_third, map_texts, segment_sums

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents a language is fitted on, in expectation (a bounded sample; scoring covers all rows).
SAMPLE_DOCS = 1000
EM_STEPS = 3
#: Pseudo-count of every piece in every language.
SMOOTHING = 0.1
#: Words of up to so many characters go through the vectorised pass, in blocks padded to these lengths.
PADDED = (8, 12, 16, 24, 32)
#: Nats by which a letter of a text may be less likely than in its language's own texts (see ``recognised``).
MARGIN = 1.6
NOISE = 6.0
WORD_START = "▁"
LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(1_000_003)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def words_of(token: str) -> list[str]:
    """Lower-case letter runs of a token."""
    low = token.lower()
    return [low] if low.isalpha() else LETTERS.findall(low)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a public vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p == p.lower() and (p == WORD_START or LETTERS.fullmatch(p.removeprefix(WORD_START)))})


class Pieces:
    """Piece numbers of the substrings of many words at once.

    Number 0 is no piece, 1 an unknown character, others are pieces; a
    substring that only begins longer pieces is -1.
    """

    def __init__(self, pieces: list[str]):
        self.count = len(pieces) + 2
        self.longest = max([1, *map(len, pieces)])
        number = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
        number.update((p, i + 2) for i, p in enumerate(pieces))
        keys = np.array([self._hash(p) for p in number], np.uint64)
        values = np.fromiter(number.values(), np.int32, len(number))
        #: Tables tried one after the other; ``crowded`` marks slots that several keys share.
        self.levels = []
        for mix in _MIX * 4:
            if not len(keys):
                break
            bits = max(8, int(len(keys)).bit_length() + 2)
            slot = ((keys * mix) >> np.uint64(64 - bits)).astype(np.int64)
            table, named, crowded = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]], named[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            crowded[slot[rest]] = True
            self.levels.append((mix, np.uint64(64 - bits), table, named, crowded))
            keys, values = keys[rest], values[rest]
        assert not len(keys), "the vocabulary does not fit its tables"

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.levels):
            return np.zeros(len(keys), np.int32)
        mix, shift, table, named, crowded = self.levels[level]
        slot = ((keys * mix) >> shift).astype(np.int64)
        out = named[slot]
        other = table[slot] != keys
        out[other] = 0
        more = np.flatnonzero(other & crowded[slot])
        if len(more):
            out[more] = self.find(keys[more], level + 1)
        return out

    def arcs(self, codes: np.ndarray, sizes: np.ndarray):
        """(start, end, word rows, piece numbers) of every piece in the words, by start.

        ``codes`` holds one word a row, padded with zeros.
        """
        n, width = codes.shape
        prefix = np.zeros((width + 1, n), np.uint64)
        powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        for j in range(width):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j]
        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            for size in range(1, min(self.longest, width - start) + 1):
                found = self.find(prefix[start + size, rows] - prefix[start, rows] * powers[size])
                if size == 1:
                    single = np.maximum(found, 1)
                    yield start, start + 1, rows, single
                else:
                    hit = found > 0
                    yield start, start + size, rows[hit], found[hit]
                alive = found != 0
                rows = rows[alive]
                if not len(rows):
                    break


def _blocks(words: list[str]):
    """(indices, codes, sizes) of words of similar length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for high in (*PADDED, None):
        at = np.flatnonzero((sizes > low) & (sizes <= high if high else True))
        low = high
        if not high:
            for i in at.tolist():  # a word of any length by itself
                yield np.array([i]), np.frombuffer(words[i].encode("utf-32-le"), "<u4").astype(np.uint64)[None, :], sizes[[i]]
        elif len(at):
            raw = "".join(words[i].ljust(high, "\0") for i in at.tolist()).encode("utf-32-le")
            yield at, np.frombuffer(raw, "<u4").astype(np.uint64).reshape(len(at), high), sizes[at]


def log_likelihoods(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """log P(word | language), one row per word, by the forward algorithm.

    ``probs`` is (pieces, languages). Words start with the word-start mark.
    Prefix probabilities of words beyond the longest padded length are
    rescaled on the way, so a word of any length keeps its value.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for at, codes, sizes in _blocks(words):
        long = codes.shape[1] > PADDED[-1]
        alpha = {0: np.ones((len(at), probs.shape[1]))}
        scale, last = np.zeros(probs.shape[1]), 0
        for start, end, rows, found in pieces.arcs(codes, sizes):
            if start != last:
                done = np.flatnonzero(sizes == start)
                out[at[done]] = np.log(alpha[start][done]) + scale
                alpha.pop(last)
                last = start
                if long and start % 16 == 0:  # one word, rescaled by language
                    top = alpha[start][0]
                    alpha = {k: v / top for k, v in alpha.items()}
                    scale += np.log(top)
            into = alpha.get(end)
            if into is None:
                into = alpha[end] = np.zeros_like(alpha[start])
            into[rows] += alpha[start][rows] * probs[found]
        done = np.flatnonzero(sizes == last + 1)
        out[at[done]] = np.log(alpha[last + 1][done]) + scale
    return out


def expected_counts(words: list[str], weights: np.ndarray, langs: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected uses of every piece by language, words weighted, by forward and backward passes.

    A word beyond the longest padded length goes through by itself, in logarithms.
    """
    total = np.zeros(probs.shape[1] * pieces.count)
    for at, codes, sizes in _blocks(words):
        n, width = codes.shape
        lang = langs[at]
        arcs = list(pieces.arcs(codes, sizes))
        if width > PADDED[-1]:
            _long_word(arcs, width, probs[:, lang[0]], weights[at[0]], total[lang[0] * pieces.count : (lang[0] + 1) * pieces.count])
            continue
        alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        alpha[0] = 1
        for start, end, rows, found in arcs:
            alpha[end, rows] += alpha[start, rows] * probs[found, lang[rows]]
        beta[sizes, np.arange(n)] = 1
        for start, end, rows, found in reversed(arcs):
            beta[start, rows] += beta[end, rows] * probs[found, lang[rows]]
        z = alpha[sizes, np.arange(n)]
        for start, end, rows, found in arcs:
            gamma = alpha[start, rows] * probs[found, lang[rows]] * beta[end, rows] / z[rows] * weights[at][rows]
            total += np.bincount(lang[rows] * pieces.count + found, weights=gamma, minlength=len(total))
    return total.reshape(probs.shape[1], pieces.count).T


def _long_word(arcs: list, width: int, probs: np.ndarray, weight: float, total: np.ndarray) -> None:
    """Add one word's expected uses of pieces to ``total``, whatever its length."""
    steps = [(start, end, int(found[0]), math.log(probs[found[0]])) for start, end, _, found in arcs if len(found)]
    ahead, back = [-math.inf] * (width + 1), [-math.inf] * (width + 1)
    ahead[0] = back[width] = 0.0
    for start, end, _, p in steps:
        ahead[end] = np.logaddexp(ahead[end], ahead[start] + p)
    for start, end, _, p in reversed(steps):
        back[start] = np.logaddexp(back[start], back[end] + p)
    for start, end, piece, p in steps:
        total[piece] += weight * math.exp(ahead[start] + p + back[end] - ahead[width])


@dataclass
class Model:
    """Languages in name order, piece probabilities (pieces, languages) and the mean log likelihood of a letter of their own texts."""

    langs: list[str]
    pieces: list[str]
    probs: np.ndarray
    means: np.ndarray


def _sample_words(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(lang number, word, count) over the sampled rows."""
    number = {v: i for i, v in enumerate(langs)}

    def count(batches):
        for pdf in batches:
            c: Counter = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                i = number[lang]
                c.update((i, w) for t in text.split() for w in words_of(t))
            yield pd.DataFrame([(i, w, n) for (i, w), n in c.items()], columns=["lang", "word", "n"])

    return rows.select("lang", "text").mapInPandas(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, vocabulary_path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, steps: int = EM_STEPS) -> Model:
    """Fit one unigram model a language on rows ``(doc_id, text, lang)``.

    Rows with a null id, text or language are not used, and a text without a
    letter teaches nothing. A language with more than ``sample_docs`` rows is
    fitted on a hash sample of about so many; repeated rows count each. An
    empty table gives a model without languages.
    """
    rows = labelled.where("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    names = vocabulary(vocabulary_path)
    if not langs:
        return Model([], names, np.zeros((len(names) + 2, 0)), np.zeros(0))
    limits = [min(1 << 32, -(-(sample_docs << 32) // sizes[v])) for v in langs]
    limit = F.create_map(*[F.lit(x) for v, n in zip(langs, limits, strict=True) for x in (v, n)])[F.col("lang")]
    counted = cut(_sample_words(rows.where(seeded_u32("langid", F.col("doc_id")) < limit), langs), "langid-words")
    pieces = Pieces(names)
    probs = np.full((pieces.count, len(langs)), 1.0 / pieces.count)
    for _ in range(steps):
        probs = _step(counted, names, probs)
    return Model(langs, names, probs, _letter_means(counted, names, probs))


def _letter_means(counted: DataFrame, names: list[str], probs: np.ndarray) -> np.ndarray:
    """Mean log likelihood of a letter (word starts count as letters) in each language's own sampled words."""
    shared = counted.sparkSession.sparkContext.broadcast((names, probs))

    def sums(batches):
        pieces, p = Pieces(shared.value[0]), shared.value[1]
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                words = [WORD_START + w for w in own["word"]]
                ll = log_likelihoods(words, pieces, p[:, [lang]])[:, 0]
                yield pd.DataFrame({"lang": [lang], "ll": [(ll * own["n"]).sum()], "letters": [float((np.fromiter(map(len, words), float) * own["n"]).sum())]})

    got = counted.mapInPandas(sums, "lang int, ll double, letters double").groupBy("lang").agg(F.sum("ll").alias("ll"), F.sum("letters").alias("letters")).toPandas()
    out = np.zeros(probs.shape[1])
    out[got["lang"]] = got["ll"] / got["letters"]
    return out


def recognised(model: Model, lang: Column, mean: Column, letters: Column) -> Column:
    """Whether a text's letters are as likely in its predicted language as that language's own texts allow.

    The posterior only compares the learned languages, so it is near 1 for any
    text; this looks at the likelihood itself. A letter may be ``MARGIN`` less
    likely on average than in the language's own texts, and short texts by
    ``NOISE`` over the root of their letters more. False for ``und``.
    """
    if not model.langs:
        return F.lit(False)
    least = F.create_map(*[F.lit(x) for v, m in zip(model.langs, model.means.tolist(), strict=True) for x in (v, m - MARGIN)])[lang]
    return F.coalesce(mean >= least - F.lit(NOISE) / F.sqrt(letters), F.lit(False))


def _step(counted: DataFrame, names: list[str], probs: np.ndarray) -> np.ndarray:
    """One expectation maximisation step; what reaches the driver is bounded by pieces times languages."""
    shared = counted.sparkSession.sparkContext.broadcast((names, probs))

    def expect(batches):
        pieces, p = Pieces(shared.value[0]), shared.value[1]
        total = np.zeros_like(p)
        for pdf in batches:
            words = [WORD_START + w for w in pdf["word"]]
            total += expected_counts(words, pdf["n"].to_numpy(float), pdf["lang"].to_numpy(np.int64), pieces, p)
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "v": total[piece, lang]})

    sums = counted.mapInPandas(expect, "piece long, lang long, v double").groupBy("piece", "lang").agg(F.sum("v").alias("v")).toPandas()
    new = np.full_like(probs, SMOOTHING)
    new[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["v"].to_numpy()
    shared.unpersist()
    return new / new.sum(axis=0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior (equal priors), in columns ``names``.

    Two more names add the mean log likelihood of a letter in that language
    (word starts count as letters) and the number of letters.

    Only the text is read. A null text, one without a letter, or an empty
    model gives ``und`` with score 0; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))

    def make():
        langs, vocab, probs = shared.value
        pieces = Pieces(vocab)

        def values(tokens: list[str]) -> np.ndarray:
            # one column per language, then the number of letters
            runs = [words_of(t) for t in tokens]
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            ll = log_likelihoods([WORD_START + w for r in runs for w in r], pieces, probs)
            letters = [sum(map(len, r)) + len(r) for r in runs]
            return np.column_stack([segment_sums(ll, sizes), letters])

        known = TokenTable(values)

        def work(texts: list) -> list:
            if not langs:
                return [["und"] * len(texts), *[[0.0] * len(texts)] * 3][: len(names)]
            ids, sizes, rows = known.look_up([t.split() if t else [] for t in texts])
            sums = segment_sums(rows[ids], sizes)
            ll, letters = sums[:, :-1], sums[:, -1]
            best = ll.argmax(axis=1)
            post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            ok = letters > 0.5
            mean = np.where(ok, ll.max(axis=1) / np.maximum(letters, 1), 0.0)
            return [[langs[b] if o else "und" for b, o in zip(best, ok)], np.where(ok, post, 0.0).tolist(), mean.tolist(), letters.tolist()][: len(names)]

        return work

    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    return map_texts(docs, text, list(zip(names, kinds)), make, keep)


def identify(docs: DataFrame, vocabulary_path: str = VOCABULARY, folds: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from rows whose crc32 of the id's text modulo ``folds`` is not
    ``held``; such rows are held out. A null id is not held out and not
    learned from. Repeated rows give repeated result rows; an empty table an
    empty result.
    """
    own = docs.select("doc_id", "text", "lang")
    model = fit(own.where(~is_third(F.col("doc_id"), folds, held)), vocabulary_path, sample_docs)
    out = predict(own, model, keep=["doc_id"])
    return out.select("doc_id", is_third(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score")
