import math
import zlib

import pytest
from pyspark.sql import functions as F

from textkiln.llm import hilbert_shards as H
from textkiln.llm.common import table
from textkiln.llm.queries import op9_hilbert_sharding

from .conftest import ODD


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_the_curve_visits_neighbouring_cells(spark, dims, bits):
    names = [f"x{i}" for i in range(dims)]
    cells = spark.range(1 << (dims * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(x) for i, x in enumerate(names)])
    rows = sorted(H.hilbert_index(cells, names, bits).collect(), key=lambda r: r.hilbert)
    assert [r.hilbert for r in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a[x] - b[x]) for x in names) == 1 for a, b in zip(rows, rows[1:]))


def check_rows_law(rows, shards=H.SHARDS):
    n, by = len(rows), {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < shards for s in by)
    assert {len(by.get(s, [])) for s in range(shards)} <= {n // shards, -(-n // shards)}
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_query(spark, sf):
    rows = op9_hilbert_sharding(spark, sf).collect()
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check_rows_law(rows)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    # the cell is the one of the quantised metadata
    cuts = {d: H.cut_points(table(spark, sf, "documents"), d) for d in ("lang", "source")}
    for r in rows:
        own = docs[r.doc_id]
        cell = (sum(own.lang >= c for c in cuts["lang"]), sum(own.source >= c for c in cuts["source"]), min(15, int(math.log2(r.size)) - 4))
        assert cell == cells_of_the_curve()[r.hilbert]


_CURVE = {}


def cells_of_the_curve():
    """Index -> cell by walking the curve: the inverse transform, level by level (brute force over all cells)."""
    if not _CURVE:
        for cell in ((a, b, c) for a in range(16) for b in range(16) for c in range(16)):
            x, q = list(cell), 8
            while q > 1:
                for i in range(3):
                    if x[i] & q:
                        x[0] ^= q - 1
                    else:
                        t = (x[0] ^ x[i]) & (q - 1)
                        x[0] ^= t
                        x[i] ^= t
                q >>= 1
            x[1] ^= x[0]
            x[2] ^= x[1]
            t = 0
            for q in (8, 4, 2):
                if x[2] & q:
                    t ^= q - 1
            x = [v ^ t for v in x]
            _CURVE[int("".join(str(v >> b & 1) for b in (3, 2, 1, 0) for v in x), 2)] = cell
    return _CURVE


def test_odd_rows(frame):
    df = frame(ODD)
    out = H.assign(df)
    rows = out.collect()
    assert len(rows) == len(ODD)
    check_rows_law(rows)
    assert out.columns[: 4] == ["doc_id", "text", "lang", "source"] and {"score", "copy", "key"} <= set(out.columns)
    check_rows_law(H.shard_rows(df).collect())
    assert H.assign(frame([])).count() == 0 and H.shard_rows(frame([])).count() == 0


def test_a_group_of_copies_spreads(frame):
    rows = H.shard_rows(frame([(i, "same text", "en", "a") for i in range(400)])).collect()
    check_rows_law(rows)
    assert len({r.shard for r in rows}) == 40


def test_cut_points_are_quantiles_of_all_values(spark, frame):
    n = 20_000  # more values than any dictionary, each as frequent as the others
    many = spark.range(n).select(F.format_string("h%06d", "id").alias("source"))
    cuts = H.cut_points(many, "source")
    assert cuts == [f"h{-(-n * k // 16):06d}" for k in range(1, 16)]
    hot = spark.range(300).select(F.when(F.col("id") < 100, "m").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("source"))
    cuts = H.cut_points(hot.unionByName(spark.createDataFrame([(None,), ("é",)], "source string")), "source")
    assert len(cuts) <= 15 and "m" not in cuts and cuts == sorted(cuts, key=str.encode)
    assert H.cut_points(frame([]), "source") == [] and H.cut_points(frame([(1, "x", "en", "a")]), "source") == []
