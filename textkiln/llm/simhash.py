"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into segments. Two fingerprints that differ in
at most ``r`` bits agree, by pigeonhole, in one of the first segments up to
``q = r // m`` bits or in one of the others up to ``q - 1`` bits. Each segment
value is a key of that segment's table; a search enumerates the small Hamming
ball around the query's segment, fetches the table's matches and verifies the
complete distance inside the join, so only true links leave it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.llm.common import cut, map_texts

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: 3 segments of 21 or 22 bits: 46 probes a fingerprint, and about n / 2^21 candidates a probe.
SEGMENTS = 3
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 14


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as a signed 64-bit integer (no word: zero)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [joined]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes) + np.arange(len(words))
        spans = [joined[s:e] for s, e in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in spans[at : at + BLOCK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``fp``, the signed 64-bit SimHash of the whole text.

    A null or wordless text has fingerprint zero.
    """
    return map_texts(docs, text, [("fp", T.LongType())], lambda: lambda texts: [[simhash64(t, shingle) for t in texts]], keep)


def _segments(m: int, r: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment that has to be searched."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    q, a = divmod(r, m)
    out, shift = [], 0
    for i, w in enumerate(widths):
        if (radius := q if i <= a else q - 1) >= 0:
            out.append((shift, w, radius))
        shift += w
    return out


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for k in range(radius + 1) for flips in combinations(range(width), k)]


def _around(part: Column, tag: Column):
    return lambda mask: part.bitwiseXOR(mask).bitwiseOR(tag)


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Every pair ``(a, b)``, ``a < b``, of distinct fingerprints ``fp`` at most ``max_bits`` apart.

    The pairs are the same for any number of segments: more segments mean
    fewer probes and more candidates to verify. A pair that several segments
    find is returned once.
    """
    segs = _segments(segments, max_bits)

    entries, probes = [], []
    for i, (shift, width, radius) in enumerate(segs):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        tag = F.lit(i << 48 if width <= 48 else 0)  # tells the segments' tables apart
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        entries.append(F.array(part.bitwiseOR(tag)))
        probes.append(F.transform(masks, _around(part, tag)))
    entry = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*entries)).alias("key"))
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    found = probe.join(entry, (probe["key"] == entry["key"]) & near)
    return found.select("a", "b").distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternating star contraction: every node hooks its larger neighbours, then
    its smaller ones, to its smallest neighbour. Minima are pre-aggregated, so
    a node with very many links does not gather them in one task; each round
    is cut to a table and the rounds grow with the logarithm of the longest
    path. Raises if ``max_rounds`` do not suffice.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "simhash-edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "simhash-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        edges = cut(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "simhash-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("connected components did not converge")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits, itself included; null ids count as larger than
    any id (null if the component has no other). Null, empty and blank texts
    share fingerprint zero. Repeated rows give repeated result rows; an empty
    table an empty result. Links are searched between distinct fingerprints,
    so copies are never paired with each other.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fps = cut(fingerprints(own, "text", shingle, ["doc_id"]), "simhash-fp")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = components(links(reps.select("fp"), max_bits, segments))
    full = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = full.join(low, "root").select(F.col("fp").alias("k"), "component_id")
    out = fps.join(named, fps["fp"] == named["k"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id.

    Several rows that share a kept id leave one row, the smallest in the order
    of the other columns. Rows without an id cannot be named as duplicates and
    stay as they are.
    """
    names = near_duplicates(docs, doc_id, text, **how)
    kept = cut(names.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    once = kept.where("n = 1").select(F.col("doc_id").alias("_once"))
    again = kept.where("n > 1").select(F.col("doc_id").alias("_again"))
    cid = F.col(f"`{doc_id}`")
    # the kept ids grow with the documents: a shuffled join at every size
    plain = docs.join(once.hint("merge"), cid == F.col("_once"), "left_semi")
    rest = [c for c in docs.columns if c != doc_id]
    repeated = docs.join(again, cid == F.col("_again"), "left_semi").groupBy(cid).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    repeated = repeated.select(*[cid if c == doc_id else F.col("_row").getField(c).alias(c) for c in docs.columns])
    return plain.unionByName(repeated).unionByName(docs.where(cid.isNull()))
