"""Benchmark decontamination by greedy string tiling.

The benchmark is a stated query set that is shipped to the documents in blocks
of bounded size. Shared windows of ``MIN_MATCH`` words, found by rolling
Karp-Rabin hashes, join documents to test items; pairs whose seeds could reach
the threshold are tiled: the longest matches of unmarked words are marked again
and again, whatever their order, and the covered share of the item decides.
Documents never move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.llm.common import TokenTable, map_texts

#: Words of the shortest tile and of a seed.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Words of one block of the benchmark (an item is never cut).
BLOCK_WORDS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(token: str) -> str:
    """A word without case and without what is no letter or digit (may be empty: no word)."""
    low = token.lower()
    return low if low.isalnum() else "".join(filter(str.isalnum, low))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    for k in range(size if len(out) else 0):
        out = out * _BASE + mixed[k : len(out) + k]
    return out


def _window_hashes(prefix: np.ndarray, power: np.uint64, size: int) -> np.ndarray:
    return prefix[size:] - prefix[:-size] * power


def _prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, from which any window's hash follows."""
    out = [0]
    for v in ids.tolist():
        out.append((out[-1] * int(_BASE) + v + 2) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(doc start, item start, words)`` of greedy string tiling.

    Longest matches of unmarked words are marked first (ties: earlier in the
    document, then in the item). The search length halves from the shorter
    text down to ``least``; at each length windows are compared by hash,
    verified and extended. Negative ids match nothing.
    """
    n, m = len(doc), len(item)
    if min(n, m) < least:
        return []
    hd, hi = _prefix_hashes(doc), _prefix_hashes(item)
    used_d, used_i = np.zeros(n, bool), np.zeros(m, bool)
    used_d[doc < 0] = True
    used_i[item < 0] = True
    tiles = []
    size = min(n, m)
    while True:
        power = np.uint64(pow(int(_BASE), size, 1 << 64))
        found: list[tuple[int, int, int]] = []
        busy_d = np.concatenate([[0], np.cumsum(used_d)])
        busy_i = np.concatenate([[0], np.cumsum(used_i)])
        free_d = np.flatnonzero((busy_d[size:] - busy_d[:-size]) == 0)
        free_i = np.flatnonzero((busy_i[size:] - busy_i[:-size]) == 0)
        where: dict[int, list[int]] = {}
        for j, h in zip(free_i.tolist(), _window_hashes(hi, power, size)[free_i].tolist()):
            where.setdefault(h, []).append(j)
        for i, h in zip(free_d.tolist(), _window_hashes(hd, power, size)[free_d].tolist()):
            for j in where.get(h, ()):
                if i and j and not used_d[i - 1] and not used_i[j - 1] and doc[i - 1] == item[j - 1]:
                    continue  # part of the match that starts one word before
                k = 0
                while i + k < n and j + k < m and doc[i + k] == item[j + k] and not used_d[i + k] and not used_i[j + k]:
                    k += 1
                if k >= size:
                    found.append((-k, i, j))
        heapify(found)
        while found:
            k, i, j = heappop(found)
            k = -k
            free = np.flatnonzero(~(used_d[i : i + k] | used_i[j : j + k]))
            if len(free) == k:
                used_d[i : i + k] = True
                used_i[j : j + k] = True
                tiles.append((i, j, k))
                continue
            for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):  # what a longer tile has left of it
                if len(run) >= size:
                    heappush(found, (-len(run), i + int(run[0]), j + int(run[0])))
        if size == least:
            return tiles
        size = max(least, size // 2)


class Block:
    """Index of a block of items: vocabulary, seed hashes and the items' places of each."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        every = [(key, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)) for key, words in items]
        self.items = [x for x in every if len(x[1]) >= least]
        #: Items too short for a seed, by length and hash; each is one tile of its whole length.
        self.short: dict[int, dict[int, list[tuple]]] = {}
        for key, ids in every:
            if len(ids) < least:
                self.short.setdefault(len(ids), {}).setdefault(int(rolling(ids, len(ids))[0]), []).append((key, ids))
        hashes = [rolling(ids, least) for _, ids in self.items]
        sizes = [len(h) for h in hashes]
        seeds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.zeros(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

    def values(self, tokens: list[str]) -> np.ndarray:
        """Word number of each token; -1 is no word of the block, -2 no word at all."""
        get = self.vocabulary.get
        return np.array([get(w, -1) if w else -2 for w in map(normal, tokens)], np.int64)

    def match_short(self, ids: np.ndarray, of: np.ndarray, out: list[list]) -> None:
        """Add the short items that documents hold word for word; ``of`` is the document of each word."""
        for size, known in self.short.items():
            hashes = rolling(ids, size)
            inside = of[size - 1 :] == of[: len(of) - size + 1]
            starts = np.searchsorted(of, np.arange(len(out)))
            seen = set()
            for at in np.flatnonzero(inside & np.isin(hashes, np.array(list(known), np.uint64))).tolist():
                for k, (key, item) in enumerate(known[int(hashes[at])]):
                    d = int(of[at])
                    if (d, int(hashes[at]), k) not in seen and (ids[at : at + size] == item).all():
                        seen.add((d, int(hashes[at]), k))
                        out[d].append({"item_id": key, "covered": size, "item_words": size, "tiles": [{"doc_word": at - int(starts[d]), "item_word": 0, "words": size}]})

    def match(self, ids: np.ndarray, at: np.ndarray, coverage: float) -> list[dict]:
        """Items whose tiles in a document cover enough, given its word numbers and the starts of its seeds."""
        spans = np.zeros(len(ids) + 1, np.int64)
        np.add.at(spans, at, 1)
        np.add.at(spans, at + self.least, -1)
        inside = np.cumsum(spans[:-1]) > 0
        places = np.flatnonzero(inside)
        gaps = np.flatnonzero(np.diff(places) > 1) + 1  # keeps runs of seeds apart
        region, origin = np.insert(ids[places], gaps, -1), np.insert(places, gaps, -1)
        distinct = np.unique(rolling(ids, self.least)[at])
        left, right = np.searchsorted(self.seeds, distinct, "left"), np.searchsorted(self.seeds, distinct, "right")
        hits = np.concatenate([np.arange(a, b) for a, b in zip(left.tolist(), right.tolist())])
        out = []
        for k in np.unique(self.owner[hits]).tolist():
            key, item = self.items[k]
            reach = np.zeros(len(item) + 1, np.int64)
            own = self.place[hits[self.owner[hits] == k]]
            np.add.at(reach, own, 1)
            np.add.at(reach, own + self.least, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < coverage * len(item):
                continue
            tiles = greedy_tiles(region, item, self.least)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                out.append({"item_id": key, "covered": covered, "item_words": len(item), "tiles": [{"doc_word": int(origin[i]), "item_word": j, "words": n} for i, j, n in sorted(tiles)]})
        return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """Items with a word, in blocks; one partition of the benchmark is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


_TILE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("doc_word", "item_word", "words")])


def _match_block(docs: DataFrame, items: list[tuple], id_type: T.DataType, text: str, least: int, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    found = T.StructType([T.StructField("item_id", id_type), T.StructField("covered", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("tiles", T.ArrayType(_TILE))])

    def make():
        block = Block(shared.value, least)
        known = TokenTable(block.values)

        def work(texts: list) -> list:
            numbers, sizes, rows = known.look_up([t.split() if t else [] for t in texts])
            ids = rows[numbers]
            of = np.repeat(np.arange(len(sizes)), sizes)
            real = ids != -2
            ids, of = ids[real], of[real]
            out: list[list] = [[] for _ in texts]
            hashes = rolling(ids, least)
            if len(hashes) and len(block.seeds):
                bad = np.concatenate([[0], np.cumsum(ids < 0)])
                whole = (of[least - 1 :] == of[: len(of) - least + 1]) & (bad[least:] == bad[: len(bad) - least])
                at = np.flatnonzero(whole)
                place = np.minimum(np.searchsorted(block.seeds, hashes[at]), len(block.seeds) - 1)
                at = at[block.seeds[place] == hashes[at]]
                starts = np.searchsorted(of, np.arange(len(sizes) + 1))
                for d in np.unique(of[at]).tolist():
                    a, b = starts[d], starts[d + 1]
                    out[d] = block.match(ids[a:b], at[(at >= a) & (at < b)] - a, coverage)
            block.match_short(ids, of, out)
            return [out]

        return work

    return map_texts(docs, text, [("_found", T.ArrayType(found))], make)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``(doc_id, item_id, covered, item_words, tiles)`` of every document and item whose tiles cover enough.

    ``covered`` counts the item's words in tiles; a tile gives its first word
    in the document and the item (words as ``words_of`` counts them) and its
    length. An item of fewer than ``least`` words is one tile: a document
    holds it if it has all its words in a row. Null and empty texts and items
    without a word match nothing. Repeated rows on either side give repeated result rows;
    empty tables an empty result.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = benchmark.schema[item_id].dataType
    out = None
    for items in _blocks(benchmark, item_id, item_text, block_words):
        part = _match_block(own, items, kind, "text", least, coverage).select("doc_id", F.explode("_found").alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = F.lit(None)
        out = own.select("doc_id", empty.cast(kind).alias("item_id"), empty.cast("int").alias("covered"), empty.cast("int").alias("item_words"), empty.cast(T.ArrayType(_TILE)).alias("tiles")).where(F.lit(False))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a test item (see ``leaks``); every row is judged by its own text.

    Rows with a null, empty or blank text stay, repeated rows stay or go
    together, all columns are kept as they are; without items, or without
    rows, nothing changes.
    """
    kind = benchmark.schema[item_id].dataType
    for items in _blocks(benchmark, item_id, item_text, block_words):
        docs = _match_block(docs, items, kind, text, least, coverage).where(F.size("_found") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs
