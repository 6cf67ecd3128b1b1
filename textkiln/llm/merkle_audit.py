"""Fixity audit of archive replicas by Merkle trees over ordered offset ranges.

Records are hashed where they lie; records of one offset range of an archive
form a leaf, and every inner node hashes its children in order. Replicas are
compared from the roots down: only children of nodes that differ are looked
at, and only records of ranges that differ are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import cut

#: Bytes of an archive that one leaf covers.
RANGE = 1 << 16
FANOUT = 16
_LANES = range(4)


def warc_record(uri: Column, payload: Column) -> Column:
    """The bytes of a response record as text (null parts are empty)."""
    uri, payload = F.coalesce(uri, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def fixity(records: DataFrame) -> DataFrame:
    """One row per archive and offset: ``(archive, offset, n, record_id, digest, lanes)``.

    Several records at one offset (repeated rows) are pre-aggregated: their
    number, the smallest id and digest, and sums of their hashes, which any
    change of one of them alters.
    """
    mixed = F.md5(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("digest", F.lit(""))))
    lanes = [F.sum(F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"l{i}") for i in _LANES]
    return records.groupBy("archive", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id"), F.min("digest").alias("digest"), *lanes)


def tree(locations: DataFrame, levels: int, span: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes ``(archive, node, hash)`` by level, leaves first.

    A leaf hashes the sums over its range (no list is gathered); an inner node
    the hashes of its at most ``fanout`` children in order.
    """
    sums = [F.sum(f"l{i}").cast("string") for i in _LANES]
    leaf = locations.groupBy("archive", F.floor(F.col("offset") / F.lit(span)).alias("node")).agg(F.sum("n").cast("string").alias("n"), F.concat_ws(":", *sums).alias("s"))
    nodes = [cut(leaf.select("archive", "node", F.sha2(F.concat_ws(":", F.col("node").cast("string"), "n", "s"), 256).alias("hash")), "merkle-leaves")]
    for level in range(1, levels):
        child = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = nodes[-1].groupBy("archive", F.floor(F.col("node") / F.lit(fanout)).alias("parent")).agg(child.alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "|")
        nodes.append(cut(up.select("archive", F.col("parent").alias("node"), F.sha2(text, 256).alias("hash")), f"merkle-{level}"))
    return nodes


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) of nodes that differ or that only one side has."""
    b = b.select(F.col("archive").alias("_archive"), F.col("node").alias("_node"), F.col("hash").alias("_hash"))
    both = a.join(b, F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("node") == F.col("_node")), "full_outer")
    odd = both.where(~F.col("hash").eqNullSafe(F.col("_hash")))
    return odd.select(F.when(F.col("node").isNotNull(), F.col("archive")).otherwise(F.col("_archive")).alias("archive"), F.coalesce("node", "_node").alias("node"))


def _under(rows: DataFrame, node: Column, odd: DataFrame) -> DataFrame:
    """Rows whose node is among the odd ones."""
    odd = odd.select(F.col("archive").alias("_oa"), F.col("node").alias("_on"))
    return rows.join(odd, rows["archive"].eqNullSafe(F.col("_oa")) & (node == F.col("_on")), "left_semi")


def audit(first: DataFrame, second: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Locations ``(archive, offset, record_id, status, digest_a, digest_b)`` at which two replicas differ.

    Both sides are records ``(archive, offset, length, record_id, digest)``
    with non-negative offsets. Status is ``missing`` (not in the second),
    ``extra`` (not in the first) or ``altered``. Null archives are one archive,
    null digests empty ones; rows without an offset have no place and are
    reported as if at offset -1. Repeated rows count, so a record stored once
    more on one side is ``altered``. Equal replicas and two empty tables give
    an empty result; replica roots alone decide that nothing below is read.
    """
    a, b = (cut(fixity(x.withColumn("offset", F.coalesce("offset", F.lit(-1)).cast("long"))), f"merkle-{k}") for k, x in (("a", first), ("b", second)))
    last = a.select("offset").unionByName(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, reach = 1, max(0, last) // span
    while reach > 0 or levels == 1:  # the root is node 0 (or -1, without an offset)
        reach //= fanout
        levels += 1
    nodes_a, nodes_b = tree(a, levels, span, fanout), tree(b, levels, span, fanout)
    odd = _differ(nodes_a[-1], nodes_b[-1])
    for level in range(levels - 2, -1, -1):
        odd = cut(odd, f"merkle-odd-{level + 1}")
        parent = F.floor(F.col("node") / F.lit(fanout))
        odd = _differ(_under(nodes_a[level], parent, odd), _under(nodes_b[level], parent, odd))
    odd = cut(odd, "merkle-odd-0")
    place = F.floor(F.col("offset") / F.lit(span))
    left, right = _under(a, place, odd), _under(b, place, odd)
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    both = left.join(right, F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("offset") == F.col("_offset")), "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n"))
    for i in _LANES:
        same = same & F.col(f"l{i}").eqNullSafe(F.col(f"_l{i}"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("n").isNull(), "extra").otherwise("altered")
    here = F.col("n").isNotNull()
    return both.where(~same).select(
        F.when(here, F.col("archive")).otherwise(F.col("_archive")).alias("archive"),
        F.coalesce("offset", "_offset").alias("offset"),
        F.coalesce("record_id", "_record_id").alias("record_id"),
        status.alias("status"),
        F.col("digest").alias("digest_a"),
        F.col("_digest").alias("digest_b"),
    )
