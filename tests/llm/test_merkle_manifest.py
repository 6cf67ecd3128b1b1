import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textkiln.llm import merkle_manifest as M
from textkiln.llm.common import is_third, table
from textkiln.llm.queries import op13_merkle_manifest

from .conftest import ODD


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(root, for every node the list of (left, right) siblings from the bottom up)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, at in enumerate(places):
            run = runs[at // 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes, places = [H(*r) for r in runs], [at // 8 for at in places]
    return nodes[0], paths


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def by_hand(rows):
    if not rows:
        return []
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        sub, paths = climb([leaf_of(r, r.text) for r in mine])
        subroots.append(sub)
        out += [(r, len(subroots) - 1, p) for r, p in zip(mine, paths, strict=True)]
    root, above = climb(subroots)
    done = []
    for r, k, path in out:
        path = path + above[k]
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
        shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if tampered else r.text
        folded = leaf_of(r, shown)
        for left, right in path:
            folded = H(left, folded, right)
        done.append((r.doc_id, leaf_of(r, r.text), subroots[k], root, H(*(a + b for a, b in path)), folded, folded == root))
    return sorted(done, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def verify(docs):
    return M.verify_documents(docs, is_third(F.col("doc_id"), 3, 0), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_whole_table_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = by_hand(docs.collect())
    assert got(op13_merkle_manifest(spark, sf)) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [8, 2], [64, 65, 1, 9], [1] * 9, [3] * 66])
def test_shapes_of_trees(spark, sizes):
    rows = [(k * 1000 + i, "Text %d" % i, f"l{k}", "s") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    assert got(verify(docs)) == by_hand(docs.collect())


def test_odd_rows(spark, frame):
    docs = frame(ODD).selectExpr("*", "cast(if(doc_id % 2 = 0, null, length(text)) as bigint) AS n_chars", "1 AS grp", "2 AS at", "3 AS item", "'l' AS leaf", "'h' AS hash", "5 AS total")
    assert got(verify(docs)) == by_hand(docs.collect())
    assert got(verify(docs.where("false"))) == []
    assert got(verify(docs.where("doc_id = 3"))) == by_hand(docs.where("doc_id = 3").collect())


def test_no_two_documents_share_a_leaf(spark):
    rows = [(1, "ab", "c", "d"), (1, "a", "bc", "d"), (1, "ab", None, "cd"), (1, "ab", "-", "d"), (None, "1:ab", "c", "d"), (1, None, "c", "d"), (1, "", "c", "d"), (1, "é", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.lit(None).cast("long"))
    assert len({r.leaf for r in verify(docs).collect()}) == len(rows)


def test_a_change_anywhere_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", "s") for i in range(30)]
    make = lambda rs: spark.createDataFrame(rs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long"))
    roots = {verify(make(rs)).first().root for rs in (rows, rows[:-1], rows[:7] + [(7, "other", "en", "s")] + rows[8:], rows[:7] + [(7, "text 7", "de", "s")] + rows[8:])}
    assert len(roots) == 4
