"""Vector tables: id -> vector lookup and exact inner-product top-k.

``mips_topk`` takes a query and a candidate table of any size: Spark packs both
into blocks of bounded bytes and rows, pairs the blocks, and every pair of
blocks yields the best ``k`` candidates of each of its queries, merged in the task
and then by a window over partitions times ``k`` rows a query. No vector passes the driver, no
score matrix exceeds one block pair, and no (query, candidate) pair is ever
emitted as a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textkiln.operators.ranking import in_order, running_totals
from textkiln.session import materialize

#: Bytes of one block of vectors (8 a component), and its rows at most: a step's scores are BLOCK_ROWS^2.
QUERY_BYTES = 32 << 20
BLOCK_ROWS = 2000
#: Bytes of vectors that are broadcast at most (a vocabulary's at 64 components).
SLOT_BYTES = 32 << 20


def embedding_lookup(ids: DataFrame, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Gather the vector of every row's ``id_col`` (an id the table lacks gives a null
    vector). The planner picks the join: AQE broadcasts a table whose measured size
    is small and splits hot ids otherwise."""
    return ids.join(table.select(id_col, vec_col), id_col, "left")


def hashed_lookup(ids: DataFrame, token_col: str, table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", ids_below: int | None = None) -> DataFrame:
    """Map token ids onto a table of ``n`` vectors by ``token mod n``, counted in id
    order, and gather them: every vector is reachable whatever the ids are.

    ``ids_below`` says that all ids are in ``[0, ids_below)``, as those of a vocabulary.
    No id meets a later slot then; slots of at most ``SLOT_BYTES`` are broadcast, so
    that no row is shuffled to its vector and back."""
    rows = in_order(table.select(id_col, vec_col), [id_col], "vectors")
    slots = running_totals(rows, [], {"_slot": F.lit(1)}).select((F.col("_slot") - 1).alias("_slot"), id_col, vec_col)
    n, width = table.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    mapped = ids.withColumn("_at", F.pmod(F.col(token_col), F.lit(max(n, 1))).cast("bigint"))
    if ids_below is not None:
        slots = slots.where(F.col("_slot") < ids_below)
        if 8 * (width or 0) * min(n, ids_below) <= SLOT_BYTES:
            slots = F.broadcast(slots)
    return mapped.join(slots, F.col("_at") == F.col("_slot")).drop("_at", "_slot")


def _pack(df: DataFrame, id_col: str, vec_col: str, block_bytes: int, pre: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (``pre``n, ``pre``ids, ``pre``vecs) of the vectors of each partition of ``df``; vectors are packed as bytes.

    A block holds at most ``rows`` vectors and ``block_bytes`` (one vector at
    least). Rows without an id or vector are in no block.
    """

    def run(batches):
        ids, vecs, size = [], [], 0

        def block():
            return pd.DataFrame({f"{pre}n": [len(ids)], f"{pre}ids": [np.array(ids, np.int64).tobytes()], f"{pre}vecs": [np.array(vecs, np.float64).tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["i"].to_numpy(), pdf["v"], strict=True):
                if ids and (size + 8 * len(v) > block_bytes or len(ids) == rows):
                    yield block()
                    ids, vecs, size = [], [], 0
                ids.append(i)
                vecs.append(np.asarray(v, np.float64))
                size += 8 * len(v)
        if ids:
            yield block()

    src = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v")).where("i is not null and v is not null")
    return src.mapInPandas(run, f"{pre}n long, {pre}ids binary, {pre}vecs binary")


def _best(S: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest scores of every row, ties by smaller id."""
    if S.shape[1] > k:
        least = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k]
        r, c = np.nonzero(S >= least[:, None])  # all that tie with the k-th as well
    else:
        r, c = np.nonzero(np.ones(S.shape, bool))
    order = np.lexsort((ids[c], -S[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(S)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def _pair_topk(k: int):
    def run(batches):
        qids, at, cand, score = None, *[np.zeros(0, np.int64)] * 2, np.zeros(0)  # best so far: rows of the query block
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if qids is None or row.q_ids != qids:
                    if qids is not None:
                        yield pd.DataFrame({"query_id": np.frombuffer(qids, np.int64)[at], "cand_id": cand, "score": score})
                    qids, at, cand, score = row.q_ids, *[np.zeros(0, np.int64)] * 2, np.zeros(0)
                cids = np.frombuffer(row.c_ids, np.int64)
                S = np.frombuffer(row.q_vecs).reshape(row.q_n, -1) @ np.frombuffer(row.c_vecs).reshape(row.c_n, -1).T
                r, c = _best(S, cids, k)
                at, cand, score = np.concatenate([at, r]), np.concatenate([cand, cids[c]]), np.concatenate([score, S[r, c]])
                order = np.lexsort((cand, -score, at))
                at, cand, score = at[order], cand[order], score[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, cand, score = at[keep], cand[keep], score[keep]
        if qids is not None:
            yield pd.DataFrame({"query_id": np.frombuffer(qids, np.int64)[at], "cand_id": cand, "score": score})

    return run


def mips_topk(queries: DataFrame, cands: DataFrame, k: int = 5, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """For every query vector, the ``k`` candidates with the largest inner product
    (ties: smaller id first). ``queries(query_id, q_vec)``, ``cands(cand_id, c_vec)``.

    Every query block meets every candidate block: that many products are what
    an exact answer takes, and they spread over all pairs of blocks."""
    q = _pack(queries, "query_id", "q_vec", block_bytes, "q_")
    c = _pack(cands, "cand_id", "c_vec", block_bytes, "c_")
    q, c = materialize(q, "mips-queries"), materialize(c, "mips-candidates")
    best = q.hint("shuffle_replicate_nl").crossJoin(c).mapInPandas(_pair_topk(k), "query_id long, cand_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
