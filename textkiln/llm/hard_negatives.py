"""Hard negatives by inner product, scored exactly in a residue number system.

Integer vectors are reduced modulo several small primes; each pair of blocks is
multiplied once per prime in float32, where every sum stays below 2^24 and so is
exact, and Chinese remaindering gives the signed scores back. Spark cuts anchors
and rows into bounded groups, pairs the groups, and windows over the few best
rows of each group select positives and negatives.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textkiln.llm.common import checked_broadcast, cut, in_order, numbered, running_totals

#: The largest primes whose symmetric residues fit one signed byte.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Components that float32 holds exactly as sums of products: below 2^24.
EXACT = 1 << 24
#: Rows and bytes (8 a component) of one group of anchors or rows at most, and scores made at a time.
GROUP_ROWS = 65_536
GROUP_BYTES = 32 << 20
STEP_SCORES = 1 << 20
#: Groups a core at least, if there are rows enough.
GROUPS_PER_CORE = 16
_NO_ID = np.iinfo(np.int64).max


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Symmetric residues (from -(p-1)/2 to (p-1)/2) as float32."""
    r = values % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def product_residues(a: np.ndarray, c: np.ndarray, prime: int) -> np.ndarray:
    """``a @ c.T`` modulo ``prime`` from float32 residues; wide rows are summed in runs that stay exact."""
    width = EXACT // (prime // 2) ** 2
    total = np.zeros((len(a), len(c)), np.int64)
    for k in range(0, a.shape[1], width):
        total += (a[:, k : k + width] @ c[:, k : k + width].T).astype(np.int64)
    return total % prime


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product tells all integers from ``-bound`` to ``bound`` apart."""
    product = 1
    for m, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound:
            return PRIMES[:m]
    raise ValueError(f"inner products may reach {bound}, beyond the signed scores of 64 bits that are supported")


def remainder_join(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed integers of smallest size with these remainders, in balanced mixed radix (no step leaves 64 bits)."""
    value, product = np.zeros(parts[0].shape, np.int64), 1
    for r, p in zip(parts, primes, strict=True):
        digit = ((r - value) % p) * pow(product % p, -1, p) % p if product > 1 else r % p
        value += np.where(digit > p // 2, digit - p, digit) * product
        product *= p
    return value


def score_bound(a: np.ndarray, c: np.ndarray) -> int:
    """No inner product of a row of ``a`` and one of ``c`` is larger in size (Cauchy-Schwarz over rounded-up lengths)."""
    if not a.size or not c.size:
        return 0
    longest = [max(1, int(np.square(m.astype(np.float64)).sum(axis=1).max() * (1 + 1e-9)) + 1) for m in (a, c)]
    return isqrt(longest[0] * longest[1]) + 1


def exact_scores(a: np.ndarray, c: np.ndarray):
    """Yield (first row, int64 scores) of runs of rows of ``a`` against all rows of ``c``."""
    primes = primes_for(score_bound(a, c))
    ra, rc = ([residues(m, p) for p in primes] for m in (a, c))
    rows = max(1, STEP_SCORES // max(1, len(c)))
    for at in range(0, len(a), rows):
        yield at, remainder_join([product_residues(x[at : at + rows], y, p) for x, y, p in zip(ra, rc, primes, strict=True)], primes)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy().astype(np.int64, copy=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, _NO_ID).to_numpy()


def _best(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first ``k`` fitting columns of every row, larger scores first, then smaller ids."""
    r, c = np.nonzero(fit)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = _matrix(left["a_vec"], len(left)), _matrix(right["c_vec"], len(right))
        an, al, cn, cl, ids = left["a_n"].to_numpy(), left["a_label"].to_numpy(), right["c_n"].to_numpy(), right["c_label"].to_numpy(), _ids(right["c_id"])
        rows, cols, got = [], [], []
        for at, s in exact_scores(a, c) if len(a) and len(c) else ():
            here = slice(at, at + len(s))
            fit = (al[here, None] == cl[None, :]) & (an[here, None] != cn[None, :])
            if len(c) > k:  # scores below the k-th of a row's fitting ones cannot be among its first
                masked = np.where(fit, s, np.iinfo(np.int64).min)
                fit &= s >= np.partition(masked, len(c) - k, axis=1)[:, [len(c) - k]]
            r, q = _best(s, fit, ids, k)
            rows.append(an[r + at])
            cols.append(ids[q])
            got.append(s[r, q])
        n, i, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, got))
        return pa.table({"a_n": n, "p_id": pa.array(i, mask=i == _NO_ID), "p_score": v})

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = _matrix(left["a_vec"], len(left)), _matrix(right["c_vec"], len(right))
        an, al, cl, ids = left["a_n"].to_numpy(), left["a_label"].to_numpy(), right["c_label"].to_numpy(), _ids(right["c_id"])
        # the scores n with low * p <= 100 * n <= high * p, for each positive score p
        bands = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in left["p_scores"].to_pylist()]
        out_n, out_p, out_i, out_s = [], [], [], []
        for at, s in exact_scores(a, c) if len(a) and len(c) else ():
            here = range(at, at + len(s))
            least = np.array([min(x for x, _ in bands[r]) for r in here])
            most = np.array([max(y for _, y in bands[r]) for r in here])
            r, q = np.nonzero((al[at : at + len(s), None] != cl[None, :]) & (s >= least[:, None]) & (s <= most[:, None]))
            order = np.lexsort((ids[q], -s[r, q], r))
            r, q = r[order], q[order]
            v = s[r, q]
            first, last = np.searchsorted(r, np.arange(len(s))), np.searchsorted(r, np.arange(len(s)), "right")
            for row in range(len(s)):
                run_v = -v[first[row] : last[row]]
                for rank, (x, y) in enumerate(bands[at + row], 1):
                    b = int(np.searchsorted(run_v, -y))
                    e = min(b + k, int(np.searchsorted(run_v, -x, "right")))
                    if e > b:
                        span = slice(first[row] + b, first[row] + e)
                        out_n.append(np.full(e - b, an[at + row]))
                        out_p.append(np.full(e - b, rank, np.int32))
                        out_i.append(ids[q[span]])
                        out_s.append(v[span])
        n, i, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_n, out_i, out_s))
        p = np.concatenate(out_p) if out_p else np.zeros(0, np.int32)
        return pa.table({"a_n": n, "p_rank": p, "negative_id": pa.array(i, mask=i == _NO_ID), "negative_score": v})

    return run


def quantise(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null for a vector that is null or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Hard negatives ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows(id long, label long, vector array<long>)``; the anchors are the rows
    for which ``is_anchor`` (an expression of those columns) holds. Scores are
    integer inner products. An anchor's positives are its first ``positives``
    other rows of the same label; of each, the first ``negatives`` rows of other
    labels with ``low * positive <= 100 * negative <= high * positive`` are
    returned, ranked from 1. Larger scores come first, ties by smaller id.

    Rows with a null label, a null vector or a null component take no part. A
    row without an id is no anchor; as a positive or negative it stands behind
    equal scores and its id is null. Rows that repeat an id are rows of their
    own, as anchors too. Vectors that are shorter than the longest count as if
    padded with zeros. Empty tables and anchors without a positive give no row.
    Scores must fit 63 bits; vectors whose lengths allow more raise an error.
    """
    spark = rows.sparkSession
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    some = rows.where(usable).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor & F.col("id").isNotNull(), F.lit(False)).alias("anchor"))
    size = some.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(F.size("vector")).alias("dim")).first()
    n, anchors, dim = size["n"], size["anchors"] or 0, max(1, size["dim"] or 0)
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vector")))
    rows_n = numbered(in_order(some.withColumn("vector", padded), [F.col("label"), F.col("id")], "negatives-rows"))
    # groups are bounded in rows and bytes; beyond that there are several a core
    bound = max(1, min(group_rows, GROUP_BYTES // (8 * dim)))
    c_rows = max(1, min(bound, -(-n // (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))))
    a_groups, c_groups = max(1, -(-anchors // bound)), max(1, -(-n // c_rows))
    every = rows_n.select(F.floor(F.col("n") / c_rows).cast("long").alias("cg"), F.col("n").alias("c_n"), F.col("id").alias("c_id"), F.col("label").alias("c_label"), F.col("vector").alias("c_vec"))
    own = in_order(rows_n.where("anchor"), [F.col("n")], "negatives-anchors")
    own = running_totals(own.drop("anchor"), [], {"at": F.lit(1)}).select(
        F.floor((F.col("at") - 1) / bound).cast("long").alias("ag"), F.col("n").alias("a_n"), F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("vector").alias("a_vec")
    )
    # rows lie in label order, so few pairs of groups share a label
    labels = own.select("ag", F.col("a_label").alias("label")).distinct().join(every.select("cg", F.col("c_label").alias("label")).distinct(), "label")
    cells = checked_broadcast(cut(labels.select("ag", "cg").distinct(), "negatives-cells"))
    near = own.join(cells, "ag").groupBy("ag", "cg").cogroup(every.join(cells, "cg").groupBy("ag", "cg"))
    first = Window.partitionBy("a_n").orderBy(F.desc("p_score"), F.asc_nulls_last("p_id"))
    chosen = near.applyInArrow(_positives(positives), "a_n long, p_id long, p_score long").withColumn("p_rank", F.row_number().over(first)).where(F.col("p_rank") <= positives)
    chosen = cut(chosen, "negatives-positives")
    ranked = F.sort_array(F.collect_list(F.struct("p_rank", "p_score")))
    scores = chosen.groupBy("a_n").agg(F.transform(ranked, lambda p: p["p_score"]).alias("p_scores"))
    asked = own.join(scores, "a_n").withColumn("cg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_groups - 1).cast("long"))))
    against = every.withColumn("ag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a_groups - 1).cast("long"))))
    found = asked.groupBy("ag", "cg").cogroup(against.groupBy("ag", "cg")).applyInArrow(_negatives(negatives, low, high), "a_n long, p_rank int, negative_id long, negative_score long")
    best = Window.partitionBy("a_n", "p_rank").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = chosen.join(own.select("a_n", F.col("a_id").alias("anchor_id")), "a_n")
    return top.join(named, ["a_n", "p_rank"]).select("anchor_id", F.col("p_id").alias("positive_id"), "rank", "negative_id", F.col("p_score").alias("positive_score"), "negative_score")
