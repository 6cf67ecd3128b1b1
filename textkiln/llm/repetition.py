"""Quality rules on repetition inside a text, by suffix arrays.

Suffixes of the word sequences of many texts are ranked together by prefix
doubling (equal ranks: equal first 2^k words of the same text). Only suffixes
whose first words recur stay in the array: exactly those with a neighbour of a
common prefix. The longest common prefixes of neighbours give the intervals of
maximal repeated substrings; the union of their spans and the longest of them
decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.llm.common import TokenTable, map_texts

SYMBOLS = "#*$%&|<>"
#: White space of the word rule: space and the five control characters U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Words of a repeated substring that count as a repeat.
MIN_REPEAT = 10
#: Largest share (per cent) of words that repeats may cover.
MAX_COVERED = 30
#: Longest repeat (words) of a kept text.
MAX_REPEAT = 100
MIN_WORDS = 50
#: Base rule: windows of so many words, and the largest share (per cent) of words in repeated windows.
WINDOW = 3
MAX_WINDOW_SHARE = 50


def _ends(sizes: np.ndarray) -> np.ndarray:
    """End of the text that each position belongs to."""
    return np.repeat(np.cumsum(sizes), sizes)


def suffix_ranks(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Final ranks of all suffixes and, by level k, those whose first 2^k words recur in their text.

    ``words`` holds the word numbers of all texts in a row, ``sizes`` the
    texts' lengths. A rank is the place where the group of equal prefixes
    starts in the suffix array, so groups of one suffix are final; each round
    doubles the prefix and sorts only what still recurs. A level is
    ``(positions, ranks)`` with equal ranks for equal prefixes.
    """
    n = len(words)
    ends = _ends(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    same = (text[order[1:]] == text[order[:-1]]) & (words[order[1:]] == words[order[:-1]])
    rank = np.empty(n, np.int64)
    start, again = _groups(len(order), same)
    rank[order] = start
    at = order[again]
    levels = [(at, rank[at])]
    step = 1
    while len(at):
        second = np.where(at + step < ends[at], rank[np.minimum(at + step, n - 1)], -1)
        order = np.lexsort((second, rank[at]))
        at, second, first = at[order], second[order], rank[at[order]]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        start, again = _groups(len(order), same)
        outer, _ = _groups(len(order), first[1:] == first[:-1])
        rank[at] = first + start - outer
        at = at[again]
        levels.append((at, rank[at]))
        step *= 2
    return rank, levels


def _groups(n: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` sorted items, each group's first index, and whether the group has several items.

    ``same`` tells of every item but the first whether it equals the one before.
    """
    new = np.concatenate([[True], ~same])[:n]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return start, ~(new & np.concatenate([~same, [True]])[:n])


def _common_prefixes(levels: list, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b``, from the highest level down."""
    lcp = np.zeros(len(a), np.int64)
    where = np.full(n + 1, -1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at, rank = levels[k]
        where[at] = rank
        x, y = where[np.minimum(a + lcp, n)], where[np.minimum(b + lcp, n)]
        lcp += np.where((x >= 0) & (x == y), 1 << k, 0)
        where[at] = -1
    return lcp


def _lcp_intervals(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeated substrings ``(place in sa, words, times)`` of at least ``least`` words.

    LCP intervals cannot be extended to the right; of them, those are returned
    whose occurrences follow different words (or a text's start).
    """
    change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    out, stack = [], []  # stack of (lcp, left border)
    for i, value in enumerate([*lcp.tolist(), 0]):
        left = i
        while stack and stack[-1][0] > value:
            size, left = stack.pop()
            if change[i] > change[left]:
                out.append((left, size, i - left + 1))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return out


def repeats(words: np.ndarray, sizes: np.ndarray, least: int = MIN_REPEAT):
    """Repeats of at least ``least`` words inside each text of a batch.

    Returns ``(starts, lengths)`` of the longest repeated span at every suffix
    that has one, ``(start, words, times)`` of the maximal repeated
    substrings, and the rank levels.
    """
    n = len(words)
    rank, levels = suffix_ranks(words, sizes)
    k = min(max(0, least.bit_length() - 1), len(levels) - 1)  # 2^k <= least
    at = levels[k][0]
    sa = at[np.argsort(rank[at], kind="stable")]
    lcp = _common_prefixes(levels, n, sa[:-1], sa[1:])
    near = np.maximum(np.concatenate([lcp, [0]]), np.concatenate([[0], lcp]))[: len(sa)]
    first = _ends(sizes) - np.repeat(sizes, sizes) == np.arange(n)
    before = np.where(first, -1, np.concatenate([[-1], words[:-1]]))[sa] if n else sa
    found = [(int(sa[i]), size, times) for i, size, times in _lcp_intervals(sa, lcp, before, least)] if len(sa) else []
    long = near >= least
    return (sa[long], near[long]), found, levels


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Mask of the positions in the union of spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _window_words(words: np.ndarray, sizes: np.ndarray, levels: list) -> np.ndarray:
    """Mask of the words in windows of three words that their text holds twice or more."""
    n = len(words)
    if len(levels) < 2:
        return np.zeros(n, bool)
    at, rank = levels[1]  # windows recur only where their first two words do
    inside = at + 2 < _ends(sizes)[at]
    at, key = at[inside], (rank[inside] * (int(words.max(initial=0)) + 1) + words[at[inside] + 2])
    order = np.argsort(key, kind="stable")
    _, again = _groups(len(order), key[order][1:] == key[order][:-1])
    return _covered(n, at[order][again], WINDOW)


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_INT, _LONG = T.IntegerType(), T.LongType()
_SPAN = T.ArrayType(T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)]))
_FIELDS = [(c, _LONG) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_maximal")] + [("repeat_spans", _SPAN)]


def measure(docs: DataFrame, text: str = "text", least: int = MIN_REPEAT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the texts' counts and repetition.

    ``covered_words`` are the words in the union of the maximal repeated
    substrings of at least ``least`` words (``repeat_spans`` are its spans, as
    word ranges), ``longest_repeat`` the words of the longest one (0: none) and
    ``n_maximal`` their number. Null and empty texts have zeros and no span.
    """

    def make():
        known = TokenTable(lambda tokens: np.zeros((len(tokens), 0)))

        def work(texts: list) -> list:
            texts = [t or "" for t in texts]
            words, sizes, _ = known.look_up([t.encode("utf-8", "surrogatepass").split() for t in texts])
            (starts, lengths), maximal, levels = repeats(words, sizes, least)
            n = len(words)
            mask = _covered(n, starts, lengths)
            window = _window_words(words, sizes, levels)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            longest = np.zeros(len(sizes), np.int64)
            np.maximum.at(longest, text_of[starts], lengths)
            per = lambda m: np.bincount(text_of[m], minlength=len(sizes)).tolist()
            ends = np.cumsum(sizes)
            covered = per(mask)
            spans = [_spans(mask[e - s : e]) if c else [] for c, e, s in zip(covered, ends, sizes)]
            lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
            return [
                sizes.tolist(),
                [len(t) - sum(map(t.count, SPACES)) for t in texts],
                [sum(map(t.count, SYMBOLS)) for t in texts],
                [len(x) - len(set(x)) for x in lines],
                per(window),
                covered,
                longest.tolist(),
                per(np.array([s for s, _, _ in maximal], np.int64)),
                [[{"start": a, "end": b} for a, b in x] for x in spans],
            ]

        return work

    return map_texts(docs, text, _FIELDS, make, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOW_SHARE * F.col("n_words"))


def kept(max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> Column:
    """Whether a measured text passes the base rules and both limits on repeats."""
    return ~base_failed() & (100 * F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, ``base_failed`` and ``kept`` of every row of ``docs`` (doc_id, text).

    Null and wordless texts fail the base rule. Rows are judged one by one, so
    repeated rows and null ids need no rule; an empty table gives an empty
    result.
    """
    out = measure(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select("*", base_failed().alias("base_failed"), kept().alias("kept"))
