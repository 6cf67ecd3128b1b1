"""The liquid filter on an event stream, with the state carried per key.

Keys are dealt into buckets by their hash, and a call folds all rows of a bucket's
keys at once, so a micro-batch costs by its rows and not by its keys. State per
bucket: for each of its keys ``h`` (the recurrence state), the ``(ts, event_id)`` of the
last row applied, a count of late rows and when it was last seen. Spark gives no
order inside a micro-batch, so each call sorts its rows; rows not after their key's
stored position are late: counted and emitted flagged. Gates ``(a, b)`` are native
column expressions computed before the stateful step; the Python function only folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from textkiln.operators.sequence import liquid_gates, segmented_scan

STATE_SCHEMA = "keys binary"
#: Buckets of keys; each is one call a micro-batch.
BUCKETS = 512
_NO_TIME = -(1 << 62)
_NO_ID = (1 << 63) - 1
_KEY = np.dtype([("none", "?"), ("user", "<i8"), ("h", "<f8"), ("us", "<i8"), ("id", "<i8"), ("n_late", "<i8"), ("seen", "<i8")])
_OUT = "none boolean, user long, id long, us long, h double, late boolean"


def _emit(pdf: pd.DataFrame, h, late: bool) -> pd.DataFrame:
    return pdf[["none", "user", "id", "us"]].assign(h=h, late=late)


def _fold(h0: float, emit_late: bool, idle_ms: int | None):
    def put(state, keys: np.ndarray, now: int) -> None:
        if idle_ms:
            keys = keys[keys["seen"] + idle_ms > now]
            if not len(keys):
                state.remove()
                return
            state.setTimeoutDuration(int(max(1, keys["seen"].min() + idle_ms - now)))
        state.update((keys.tobytes(),))

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        known = np.frombuffer(state.get[0], _KEY) if state.exists else np.zeros(0, _KEY)
        if state.hasTimedOut:
            put(state, known, now)
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["none", "user", "us", "id"], kind="stable", ignore_index=True)
        none, user, us, ids = (pdf[c].to_numpy() for c in ("none", "user", "us", "id"))
        seg = np.cumsum(np.concatenate([[False], (none[1:] != none[:-1]) | (user[1:] != user[:-1])]))
        here = np.zeros(int(seg[-1]) + 1, _KEY)
        starts = np.searchsorted(seg, np.arange(len(here)))
        here["none"], here["user"], here["h"], here["us"], here["id"] = none[starts], user[starts], h0, -(1 << 63), -(1 << 63)
        at = {k: i for i, k in enumerate(zip(known["none"].tolist(), known["user"].tolist(), strict=True))}
        back = np.array([at.get(k, -1) for k in zip(here["none"].tolist(), here["user"].tolist(), strict=True)], np.int64)
        here[back >= 0] = known[back[back >= 0]]
        after = (back < 0)[seg] | (us > here["us"][seg]) | ((us == here["us"][seg]) & (ids > here["id"][seg]))
        if not after.all():
            np.add.at(here["n_late"], seg[~after], 1)
            if emit_late:
                yield _emit(pdf[~after], np.nan, True)
        here["seen"] = now
        if after.any():
            live, its = pdf[after], seg[after]
            A, B = segmented_scan(its, live["a"].to_numpy(np.float64), live["b"].to_numpy(np.float64))
            hs = A * here["h"][its] + B
            ends = np.flatnonzero(np.concatenate([its[1:] != its[:-1], [True]]))
            for name, values in (("h", hs), ("us", us[after]), ("id", ids[after])):
                here[name][its[ends]] = values[ends]
            yield _emit(live, hs, False)
        others = np.ones(len(known), bool)
        others[back[back >= 0]] = False
        put(state, np.concatenate([known[others], here]), now)

    return run


def stream_liquid_filter(
    events: DataFrame, x_tau: Column, x_in: Column, log_dt: float = 0.0, h0: float = 0.0, emit_late: bool = True, idle_hours: float | None = None
) -> DataFrame:
    """Streaming liquid filter per ``user_id`` over ``(ts, event_id)`` order.

    ``events`` needs ``user_id, event_id, ts`` (TIMESTAMP or TIMESTAMP_NTZ).
    Output (append): ``user_id, event_id, ts, h, late`` for every row; rows that
    come after a later one of their key cannot be applied and are emitted with
    ``late`` true and ``h`` NaN (``emit_late=False`` only counts them in the
    state). In a query that runs on, ``idle_hours`` drops the state of a key that
    gets no row for so long; the key then starts anew. (Such a timeout keeps
    asking for batches, so an ``availableNow`` run, which would never end, goes
    without.)
    """
    a, b = liquid_gates(x_tau, x_in, log_dt)
    user, event = F.col("user_id").cast("long"), F.col("event_id").cast("long")
    d = events.select(
        F.pmod(F.xxhash64(user), F.lit(BUCKETS)).alias("bucket"),
        user.isNull().alias("none"),
        F.coalesce(user, F.lit(0)).alias("user"),
        F.coalesce(event, F.lit(_NO_ID)).alias("id"),  # plain numbers: no key or id passes through a float
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NO_TIME)).alias("us"),
        a.alias("a"),
        b.alias("b"),
    )
    out = d.groupBy("bucket").applyInPandasWithState(
        _fold(h0, emit_late, int(idle_hours * 3_600_000) if idle_hours else None),
        _OUT,
        STATE_SCHEMA,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_hours else GroupStateTimeout.NoTimeout,
    )
    return out.select(
        F.when(~F.col("none"), F.col("user")).alias("user_id"),
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("event_id"),
        F.when(F.col("us") != _NO_TIME, F.timestamp_micros("us")).alias("ts"),
        "h",
        "late",
    )
