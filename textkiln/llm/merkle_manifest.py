"""Merkle manifest of a dataset: leaves by group, subroots, one root, and a proof for every row.

Every inner node comes from a slot pivot: conditional aggregates spread the
children of a parent into ``FANOUT`` columns; the columns joined together are
hashed, and without a child's own column they are that child's siblings. Proofs
are built from the root down by exploding the pivots, so rows are never joined
with their ancestors one by one and no task holds more than a parent's children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import checked_broadcast, cut, in_order, numbered

FANOUT = 8
_SLOTS = [f"s{j}" for j in range(FANOUT)]
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts joined together (null parts are nothing)."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that joined values cannot be confused; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def depth(total: int) -> int:
    """Levels above ``total`` nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def _pivots(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Parents by level, lowest first: ``(grp, at, total, hash, s0 .. s7)``; a slot is a child's ``(hash, item)``.

    ``nodes`` are ``(grp, at, total, hash, item)``: the number in the group,
    the group's nodes on this level, and what travels with the node. Groups
    that have come down to one node go no higher.
    """
    out = []
    for level in range(levels):
        child = F.struct("hash", "item")
        slots = [F.max(F.when(F.col("at") % FANOUT == j, child)).alias(s) for j, s in enumerate(_SLOTS)]
        spread = nodes.where(F.col("total") > 1).groupBy("grp", F.floor(F.col("at") / FANOUT).alias("up")).agg(F.max("total").alias("total"), *slots)
        over = F.ceil(F.col("total") / FANOUT).cast("long")
        out.append(cut(spread.select("grp", F.col("up").alias("at"), over.alias("total"), digest(*[F.col(f"{s}.hash") for s in _SLOTS]).alias("hash"), *_SLOTS), f"manifest-{name}-{level + 1}"))
        nodes = out[-1].select("grp", "at", "total", "hash", F.lit(None).cast("string").alias("item"))
    return out


def _tops(nodes: DataFrame, pivots: list[DataFrame]) -> DataFrame:
    """(grp, hash) of the one node that every group comes down to."""
    return reduce(DataFrame.unionByName, [x.where("total = 1").select("grp", "hash") for x in (nodes, *pivots)])


def _descend(nodes: DataFrame, pivots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(item, hash, path, mark)`` of every node; ``tops`` are ``(grp, total, path, mark)``, the path above each group.

    A child's path is its siblings (the other columns of the pivot), then its parent's path.
    """
    tops = tops.select(F.col("grp").alias("_g"), F.col("total").alias("_total"), F.col("path").alias("_path"), F.col("mark").alias("_mark"))
    known = None
    for level in range(len(pivots), 0, -1):
        start = tops.where((F.col("_total") > FANOUT ** (level - 1)) & (F.col("_total") <= FANOUT**level)).select("_g", F.lit(0).cast("long").alias("_at"), "_path", "_mark")
        known = start if known is None else known.unionByName(start)
        parents = pivots[level - 1].join(known, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("at") == F.col("_at")))
        hashes = [F.col(f"{s}.hash") for s in _SLOTS]
        kids = [
            F.when(
                F.col(s).isNotNull(),
                F.struct(F.lit(j).alias("slot"), F.col(s).alias("node"), F.concat_ws("", *hashes[:j]).alias("left"), F.concat_ws("", *hashes[j + 1 :]).alias("right")),
            )
            for j, s in enumerate(_SLOTS)
        ]
        child = parents.select("grp", "at", "_path", "_mark", F.explode(F.filter(F.array(*kids), lambda k: k.isNotNull())).alias("k"))
        path = F.concat(F.array(F.struct("k.left", "k.right")), F.col("_path")).cast(_PATH)
        if level == 1:
            known = child.select(F.col("k.node.item").alias("item"), F.col("k.node.hash").alias("hash"), path.alias("path"), F.col("_mark").alias("mark"))
        else:
            known = child.select(F.col("grp").alias("_g"), (F.col("at") * FANOUT + F.col("k.slot")).cast("long").alias("_at"), path.alias("_path"), "_mark")
    alone = nodes.where("total = 1").join(tops.where("_total = 1"), F.col("grp").eqNullSafe(F.col("_g"))).select("item", "hash", F.col("_path").alias("path"), F.col("_mark").alias("mark"))
    return alone if known is None else known.unionByName(alone)


def manifest(leaves: DataFrame) -> DataFrame:
    """``(item, leaf, subroot, root, path)`` of every leaf ``(grp, key, leaf, item)``.

    Leaves stand in the order of ``key`` (null first; equal keys by leaf) in
    their group; a null group is a group. While several nodes remain, every
    ``FANOUT`` consecutive ones are joined and hashed into one (the last run may
    hold fewer, even one). What remains is the group's subroot, a lone leaf
    itself; subroots in the order of the groups give the root in the same way.
    ``path`` holds the siblings left and right of the node on each level, from
    the leaf up through the subroot to the root. Repeated rows are leaves of
    their own; an empty table gives an empty result.
    """
    rows = numbered(in_order(leaves.select("grp", "key", "leaf", "item"), ["grp", "key", "leaf"], "manifest-leaves"))
    # a number per group: checked, and joined by shuffle if there are too many for a broadcast
    groups = cut(rows.groupBy("grp").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("total")), "manifest-groups")
    sized = checked_broadcast(groups.withColumnRenamed("grp", "_grp"))
    nodes = rows.join(sized, F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", (F.col("n") - F.col("first")).alias("at"), "total", F.col("leaf").alias("hash"), "item")
    size = groups.agg(F.max("total").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    pivots = _pivots(nodes, depth(size["most"] or 0), "rows")
    tops = numbered(in_order(_tops(nodes, pivots), ["grp"], "manifest-subroots"))
    heads = tops.select(F.lit(0).alias("grp"), F.col("n").alias("at"), F.lit(size["groups"]).cast("long").alias("total"), "hash", F.struct("grp").alias("item"))
    above = _pivots(heads, depth(size["groups"]), "groups")
    # the root is one row; every subroot's path starts there
    root = _tops(heads, above).select(F.lit(0).alias("grp"), F.lit(size["groups"]).cast("long").alias("total"), F.array().cast(_PATH).alias("path"), F.col("hash").alias("mark"))
    subroots = _descend(heads, above, root).select(F.col("item.grp").alias("grp"), "path", F.struct(F.col("hash").alias("subroot"), F.col("mark").alias("root")).alias("mark"))
    placed = subroots.join(groups.select(F.col("grp").alias("_grp"), "total"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
    placed = cut(placed, "manifest-paths")
    return _descend(nodes, pivots, placed).select("item", F.col("hash").alias("leaf"), "mark.subroot", "mark.root", "path")


def document_leaf(text: Column) -> Column:
    """Leaf of a document whose text is ``text``: doc_id, source, lang, n_chars and the text."""
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


def verify_documents(docs: DataFrame, tampered: Column, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Groups are the languages. Where ``tampered`` holds, the root is recomputed
    from the leaf that the text ``altered`` gives, elsewhere from the document's
    own, each time with the siblings of the untouched manifest. Nulls in any
    column are values of their own (see ``field``); a null ``tampered`` is false.
    """
    own = document_leaf(F.col("text"))
    shown = F.when(tampered, document_leaf(altered))
    leaves = cut(docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), own.alias("leaf"), F.struct("doc_id", shown.alias("shown")).alias("item")), "manifest-hashes")
    found = manifest(leaves)
    folded = fold(F.coalesce("item.shown", "leaf"), F.col("path"))
    out = found.select(F.col("item.doc_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
