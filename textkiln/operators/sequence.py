"""Ordered-sequence operators on event tables.

``linear_recurrence`` computes every prefix of ``h_t = a_t * h_{t-1} + b_t`` per
key in a blocked scan that splits hot keys:

1. range-partition rows on ``(key, order...)``: Spark samples the full sort key,
   so a key holding a third of all rows is spread over many partitions;
2. per partition, a vectorized segmented doubling scan (numpy, Arrow batches)
   gives each row the composed map ``(A, B)`` of its key's rows in that
   partition up to it; the result is written as a table in the shared
   checkpoint folder so every later read sees the same partitions. Keys stay
   Arrow values throughout (no conversion can merge or change them) and are
   compared null-safely;
3. one summary row per partition (its last key's ``(A, B)``) streams through
   the same scan in partition order, which gives the state carried into each
   partition's first key; no list of summaries is built;
4. the carries (at most one a partition, broadcast) are joined back:
   ``h = A * carry + B``.

The state never uses ``exp(sum(log a))``: ``a`` may be 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.constants import SMOOTH_WINDOW, TAU_FLOOR
from textkiln.functions.gates import clamp, softplus
from textkiln.operators.ranking import in_order, numbered, partitions_for, running_totals
from textkiln.session import checkpoint_dir, materialize


def segmented_scan(seg: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix composition of affine maps within runs of equal ``seg``
    (log-depth doubling; combining earlier (A1, B1) with later (A2, B2) gives
    (A2*A1, A2*B1 + B2))."""
    A, B = a.astype(np.float64).copy(), b.astype(np.float64).copy()
    n, step = len(A), 1
    while step < n:
        same = seg[step:] == seg[:-step]
        if A.ndim > 1:  # vectors: the same segment test for every dimension
            same = same[:, None]
        nb = np.where(same, A[step:] * B[:-step] + B[step:], B[step:])
        na = np.where(same, A[step:] * A[:-step], A[step:])
        A[step:], B[step:] = na, nb
        step *= 2
    return A, B


def _after(carry, A: np.ndarray, B: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A * carry[0], A * carry[1] + B


def key_starts(keys: pa.Array) -> np.ndarray:
    """Whether each row's key differs from the one before it (the first row's does);
    nulls equal each other, and so do NaNs."""
    here, back = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
    same = pc.or_(pc.fill_null(pc.equal(here, back), False), pc.and_(pc.is_null(here), pc.is_null(back)))
    if pa.types.is_floating(keys.type):
        same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(here), False), pc.fill_null(pc.is_nan(back), False)))
    return np.concatenate([np.ones(min(1, len(keys)), bool), ~same.to_numpy(zero_copy_only=False)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Numbers as an array, equal-length lists as a row each; a null is NaN."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _column(values: np.ndarray) -> pa.Array:
    if values.ndim == 1:
        return pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)), pa.array(values.ravel()))


def _scan(key: str, inputs: Sequence[str], outputs: Sequence[str], scan: Callable, after: Callable):
    """Arrow map over rows sorted by ``key``: replaces ``inputs`` with ``outputs`` =
    ``scan(segments, *inputs)``, where ``after(carry, *outputs)`` puts what a key had in
    earlier batches before it. All other columns pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, ()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            seg = np.cumsum(key_starts(keys))
            made = [x.copy() for x in scan(seg, *[_matrix(batch.column(c)) for c in inputs])]
            if last is not None and not key_starts(pa.concat_arrays([last, keys.slice(0, 1)]))[1]:
                first = seg == seg[0]
                for x, y in zip(made, after(carry, *[m[first] for m in made]), strict=True):
                    x[first] = y
            last, carry = keys.slice(len(keys) - 1), tuple(x[-1].copy() for x in made)
            names = [c for c in batch.schema.names if c not in inputs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [_column(x) for x in made], names=[*names, *outputs])

    return run


def _scanned(rows: DataFrame, key: str, inputs: Sequence[str], outputs: Sequence[str], scan: Callable, after: Callable) -> DataFrame:
    num = rows.schema[inputs[0]].dataType
    schema = T.StructType([f for f in rows.schema.fields if f.name not in inputs] + [T.StructField(c, num) for c in outputs])
    return rows.mapInArrow(_scan(key, inputs, outputs, scan, after), schema)


def _ranged(df: DataFrame, key: str, order_cols: Sequence[str], parts: Sequence[int]) -> DataFrame:
    """Rows range-partitioned and sorted by key and order, with ``_pid`` and ``_idx``."""
    rows = df.repartitionByRange(*parts, key, *order_cols).sortWithinPartitions(key, *order_cols)
    mid = F.monotonically_increasing_id()
    return rows.withColumn("_pid", F.shiftright(mid, 33).cast("int")).withColumn("_idx", mid.bitwiseAND(F.lit((1 << 33) - 1)))


def _carried(local: DataFrame, key: str, state: Sequence[str], scan: Callable, after: Callable) -> DataFrame:
    """``(_cp, _ck, _c<state>)``: what earlier partitions hold of a partition's first key.

    One row a partition, in partition order: a partition that holds a single
    key goes on with the chain of the one before it, any other starts anew."""
    ends = local.groupBy("_pid").agg(
        F.min_by(F.struct(F.col(key).alias("k")), "_idx").alias("first"), F.max_by(F.struct(F.col(key).alias("k"), *state), "_idx").alias("last")
    )
    # windows and the scan run over one row a partition
    w = Window.orderBy("_pid")
    before = F.lag("last").over(w)
    goes_on = F.coalesce(before.isNotNull() & before["k"].eqNullSafe(F.col("first.k")), F.lit(False))
    ends = ends.withColumn("_on", goes_on)
    chain = F.sum(F.when(F.col("_on") & F.col("first.k").eqNullSafe(F.col("last.k")), 0).otherwise(1)).over(w)
    rows = ends.select("_pid", F.col("first.k").alias("_ck"), "_on", chain.alias("_chain"), *[F.col(f"last.{c}").alias(f"_e{c}") for c in state])
    made = _scanned(rows, "_chain", [f"_e{c}" for c in state], [f"_s{c}" for c in state], scan, after)
    into = F.lag(F.struct(*[F.col(f"_s{c}").alias(c) for c in state])).over(w)
    return made.select(F.col("_pid").alias("_cp"), "_ck", F.when(F.col("_on"), into).alias("_c")).where("_c is not null").select("_cp", "_ck", *[F.col(f"_c.{c}").alias(f"_c{c}") for c in state])


def linear_recurrence(
    df: DataFrame,
    key: str,
    order_cols: list[str],
    a: Column,
    b: Column,
    h0: float = 0.0,
    out: str = "h",
    num_partitions: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add ``out`` = h_t of ``h_t = a_t h_{t-1} + b_t`` per ``key`` in ``order_cols``
    order, starting from ``h0`` before each key's first row. ``a`` and ``b`` are
    numbers, or equal-length arrays for an elementwise recurrence over vector
    dimensions (the state is then an array).

    Rows with a null key are one sequence. A row whose ``a`` or ``b`` is null
    leaves the state as it is: its ``out`` is that of the row before it, or
    ``h0``. Null components of a vector make NaN.

    ``carry`` names the other input columns to keep (default: all). The Python
    scan is opaque to column pruning, so callers that need only the state pass
    ``carry=[]`` and nothing else crosses into Python or the checkpoint table."""
    checkpoint_dir(df.sparkSession)
    keep = [c for c in df.columns if c not in (key, *order_cols)] if carry is None else list(carry)
    named = df.select(key, *order_cols, *keep, a.alias("_a"), b.alias("_b"))
    vec = isinstance(named.schema["_a"].dataType, T.ArrayType)
    num = T.ArrayType(T.DoubleType()) if vec else T.DoubleType()
    still, none = F.lit(1.0), F.lit(0.0)
    if vec:
        some = named.where("_a is not null").select(F.size("_a")).first()
        width = some[0] if some else 1
        still, none = F.array_repeat(still, width), F.array_repeat(none, width)
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    d = named.withColumns({"_a": F.when(missing, still).otherwise(F.col("_a").cast(num)), "_b": F.when(missing, none).otherwise(F.col("_b").cast(num))})
    rows = _ranged(d, key, order_cols, [num_partitions] if num_partitions else partitions_for(d))
    local = materialize(_scanned(rows, key, ["_a", "_b"], ["_A", "_B"], segmented_scan, _after), "scan-blocks")
    carries = _carried(local, key, ["_A", "_B"], segmented_scan, _after)
    # at most one carry per partition: a proven bound for the broadcast
    j = local.join(F.broadcast(carries), (F.col("_pid") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_ck")), "left")

    def affine(A_, h_, B_):  # A * h + B, elementwise for vectors
        if vec:
            return F.zip_with(F.zip_with(A_, h_, lambda x, y: x * y), B_, lambda x, y: x + y)
        return A_ * h_ + B_

    begin = F.array_repeat(F.lit(float(h0)), F.size("_A")) if vec else F.lit(float(h0))
    start = F.when(F.col("_cp").isNotNull(), affine(F.col("_c_A"), begin, F.col("_c_B"))).otherwise(begin)
    return j.withColumn(out, affine(F.col("_A"), start, F.col("_B"))).drop("_A", "_B", "_pid", "_idx", "_cp", "_ck", "_c_A", "_c_B")


def liquid_gates(x_tau: Column, x_in: Column, log_dt: float = 0.0) -> tuple[Column, Column]:
    """(a, b) of the liquid cell: tau = softplus(x_tau) + floor, alpha =
    clamp(softplus(log_dt) / tau, 0, 1), a = 1 - alpha, b = alpha * tanh(x_in)."""
    tau = softplus(x_tau) + F.lit(TAU_FLOOR)
    dt = softplus(F.lit(float(log_dt)))
    alpha = clamp(dt / tau, 0.0, 1.0)
    return F.lit(1.0) - alpha, alpha * F.tanh(x_in)


def liquid_filter(
    df: DataFrame, key: str, order_cols: list[str], x_tau: Column, x_in: Column, log_dt: float = 0.0, h0: float = 0.0, out: str = "h", carry: list[str] | None = None
) -> DataFrame:
    """Adaptive smoothing: the liquid cell's gates feeding ``linear_recurrence``."""
    a, b = liquid_gates(x_tau, x_in, log_dt)
    return linear_recurrence(df, key, order_cols, a, b, h0, out, carry=carry)


def final_state(states: DataFrame, key: str, order_cols: list[str], h: str = "h") -> DataFrame:
    """State after each key's last row (partial + final aggregate)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return states.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.max_by(F.col(h), order).alias("h_final"))


def trailing_mean(
    df: DataFrame, key: str, order_cols: list[str], value: str, window: int = SMOOTH_WINDOW, out: str = "trailing_mean", chunk: int = 4096
) -> DataFrame:
    """Mean of the ``window`` values before each row (current row excluded),
    emitted only where a full frame exists.

    A plain window per key would put a hot key in one task. Rows get their
    position per key, are cut into chunks of ``chunk`` positions (at least
    ``window``), and each chunk also receives the ``window`` rows before it (a
    halo); the window then runs per (key, chunk), at most ``chunk + window``
    rows, with the same arithmetic as one window over the whole key."""
    chunk = max(chunk, window)  # the halo then lies in the chunk before
    d = row_positions(df.select(key, *order_cols, value), key, order_cols)
    c = F.floor(F.col("pos") / chunk).cast("bigint")
    halo = (F.col("pos") % chunk) >= (chunk - window)
    copies = F.when(
        halo,
        F.array(F.struct(c.alias("chunk"), F.lit(True).alias("own")), F.struct((c + 1).alias("chunk"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(c.alias("chunk"), F.lit(True).alias("own"))))
    rep = d.withColumn("_c", F.explode(copies)).withColumn("chunk", F.col("_c.chunk")).withColumn("_own", F.col("_c.own")).drop("_c")
    w = Window.partitionBy(key, "chunk").orderBy("pos").rowsBetween(-window, -1)
    r = rep.withColumn("_n", F.count(value).over(w)).withColumn(out, F.avg(value).over(w))
    return r.where(F.col("_own") & (F.col("_n") == window)).drop("_n", "_own", "chunk", "pos")


def _weight(m: np.ndarray, top: np.ndarray) -> np.ndarray:
    """``exp(m - top)``, 0 for what holds no row (a maximum of minus infinity)."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(m), 0.0, np.exp(m - top))


def softmax_scan(seg: np.ndarray, score: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running ``(m, l, s)`` within runs of equal ``seg``: the largest score so far, and
    the sums of ``exp(score - m)`` and ``exp(score - m) * value`` (log-depth doubling;
    the combination rescales both sides to the larger maximum). A score of minus
    infinity weighs nothing."""
    gone = np.isneginf(score)
    return _merge_scan(seg, score, np.where(gone, 0.0, 1.0), np.where(gone, 0.0, value))


def _merge_scan(seg: np.ndarray, m: np.ndarray, l: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, l, s = (x.astype(np.float64).copy() for x in (m, l, s))
    step = 1
    while step < len(m):
        same = seg[step:] == seg[:-step]
        back_m = np.where(same, m[:-step], -np.inf)
        top = np.maximum(m[step:], back_m)
        here, back = _weight(m[step:], top), _weight(back_m, top)
        l_new, s_new = l[step:] * here + l[:-step] * back, s[step:] * here + s[:-step] * back
        m[step:], l[step:], s[step:] = top, l_new, s_new
        step *= 2
    return m, l, s


def _softmax_after(carry, m: np.ndarray, l: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.maximum(m, carry[0])
    here, back = _weight(m, top), _weight(carry[0], top)
    return top, l * here + carry[1] * back, s * here + carry[2] * back


def causal_softmax_mean(df: DataFrame, key: str, order_cols: list[str], score: Column, value: Column, out: str = "attn") -> DataFrame:
    """``sum_{j<=i} e^{s_j} v_j / sum_{j<=i} e^{s_j}`` per key, for scores of any size.

    One scan per range partition carries the running maximum with both sums;
    what earlier partitions hold of a key (one row each) is combined in
    afterwards. Rows with a null key form one sequence. A row whose score or
    value is null weighs nothing: its mean is that of the rows before it, null
    if there are none."""
    missing = score.isNull() | value.isNull()
    least = F.lit(float("-inf"))
    named = df.select(
        "*", F.when(missing, least).otherwise(score.cast("double")).alias("_m"), F.when(missing, 0.0).otherwise(value.cast("double")).alias("_v")
    )
    rows = _ranged(named, key, order_cols, partitions_for(named))
    local = _scanned(rows, key, ["_m", "_v"], ["_M", "_L", "_S"], softmax_scan, _softmax_after)
    local = materialize(local, "softmax-blocks")
    state = ["_M", "_L", "_S"]
    carry = _carried(local, key, state, _merge_scan, _softmax_after)
    j = local.join(F.broadcast(carry), (F.col("_pid") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_ck")), "left")
    cm, cl, cs = F.coalesce("_c_M", least), F.coalesce("_c_L", F.lit(0.0)), F.coalesce("_c_S", F.lit(0.0))
    top = F.greatest(F.col("_M"), cm)
    x, y = (F.when(m == least, 0.0).otherwise(F.exp(m - top)) for m in (F.col("_M"), cm))
    weight = F.col("_L") * x + cl * y
    mean = F.when(weight != 0, (F.col("_S") * x + cs * y) / weight)
    return j.select(*[F.col(f"`{k}`") for k in df.columns], mean.alias(out))


def row_positions(df: DataFrame, key: str, order_cols: list[str], out: str = "pos") -> DataFrame:
    """0-based position of each row within its key (range partitions, so hot keys are
    split; rows with a null key are numbered like any other)."""
    d = running_totals(in_order(df, [key, *order_cols], "positions"), [key], {"_cnt": F.lit(1)})
    return d.withColumn(out, (F.col("_cnt") - 1).cast("bigint")).drop("_cnt", "_pid", "_idx")


#: Chunks of ``span`` rows that are attended to in one call.
ATTEND_CHUNKS = 16


def _as_matrix(column: pa.Array) -> np.ndarray:
    """Scalars become a one-column matrix, arrays a row per vector."""
    m = _matrix(column).astype(np.float64)
    return m if m.ndim > 1 else m.reshape(-1, 1)


def _attend(columns: list[str], span: int, dim: int | None):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n").combine_chunks()
        n, pos, own = (table[c].to_numpy() for c in ("_n", "pos", "_own"))
        start = n - pos % span  # the number of a chunk's first row names the chunk
        q, k, v = _as_matrix(table["_q"].combine_chunks()), _as_matrix(table["_k"].combine_chunks()), _matrix(table["_v"].combine_chunks()).astype(np.float64)
        attn = np.empty(len(n))
        for u in np.unique(start[own]).tolist():
            i, j = np.searchsorted(start, [u, u + 1]).tolist()
            first = np.searchsorted(start, u - span) if pos[i] >= span else i  # the key's chunk before, if there is one
            qi, pi, back = q[i:j], pos[i:j], pos[first:j]
            s = (qi @ k[first:j].T) / np.sqrt(dim or q.shape[1])
            band = (back[None, :] <= pi[:, None]) & (back[None, :] > pi[:, None] - span)
            s = np.where(band, s, -np.inf)
            s = s - s.max(axis=1, keepdims=True)
            w = np.exp(s)
            attn[i:j] = (w * v[None, first:j]).sum(axis=1) / w.sum(axis=1)
        return table.select(columns).append_column("attn", pa.array(attn, from_pandas=True)).filter(pa.array(own))

    return run


def history_attention(
    df: DataFrame,
    key: str,
    order_cols: list[str],
    q: Column,
    k: Column,
    v: Column,
    *,
    span: int,
    dim: int | None = None,
) -> DataFrame:
    """Causal scaled-dot-product attention over each row's last ``span`` rows
    (itself included) within its key: ``softmax_j(q_i . k_j / sqrt(dim)) v_j``.
    ``q`` and ``k`` are numbers or equal-length arrays; ``dim`` defaults to their
    width. The caller states ``span``: rows further back are not looked at.

    Rows are cut into chunks of ``span`` positions of a key; runs of chunks that lie
    near each other in the whole order are one group, together with a copy of the chunk
    before its first (the halo). So a group holds about ``ATTEND_CHUNKS * span`` rows
    however hot a key or small the keys, and no pair is ever emitted as a row. The order
    columns travel with the rows, so nothing is joined back.
    """
    named = df.select(key, *order_cols, q.alias("_q"), k.alias("_k"), v.alias("_v"))
    placed = in_order(named, [key, *order_cols], "positions").withColumns({"_at": F.col("_pid"), "_in": F.col("_idx")})
    placed = numbered(placed, "_n").withColumnsRenamed({"_at": "_pid", "_in": "_idx"})
    d = running_totals(placed, [key], {"_cnt": F.lit(1)}).withColumn("pos", (F.col("_cnt") - 1).cast("bigint"))
    start = F.col("_n") - F.col("pos") % span
    group, after = (F.floor(x / (span * ATTEND_CHUNKS)).cast("bigint") for x in (start, start + span))
    here = F.struct(group.alias("group"), F.lit(True).alias("own"))
    copies = F.when(after != group, F.array(here, F.struct(after.alias("group"), F.lit(False).alias("own")))).otherwise(F.array(here))
    columns = [key, *order_cols, "pos"]
    rep = d.withColumn("_c", F.explode(copies)).select(*columns, "_q", "_k", "_v", F.col("_n").cast("bigint").alias("_n"), F.col("_c.group").alias("_g"), F.col("_c.own").alias("_own"))
    schema = T.StructType([*[d.schema[c] for c in columns], T.StructField("attn", T.DoubleType())])
    return rep.groupBy("_g").applyInArrow(_attend(columns, span, dim), schema)
