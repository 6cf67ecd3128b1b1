"""The liquid filter over event time: rows that arrive out of order are put back in order.

Rows wait in a buffer, in slots of event time. When the watermark (the latest time
seen minus the allowed delay) has passed a slot's end, a timer fires: no row of the
slot can be missing any more but late ones, so its rows are sorted and folded into
their keys' states. Keys are dealt into buckets by their hash; a bucket has one state,
one buffer and one timer, so a micro-batch costs by its rows and not by its keys. What a watermark
releases of a bucket is folded together, and input is taken in the batches Arrow hands
over. Keys travel as text and event ids beside a flag, so that no
value passes through a float.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textkiln.operators.sequence import liquid_gates, segmented_scan

#: Milliseconds of event time that are buffered and released together.
SLOT_MS = 60_000
#: Rows of one piece of the buffer; pieces are cut in the order of time.
PIECE_ROWS = 4096
#: Buckets of keys; each is one group of the stateful step, and costs a micro-batch some
#: dozen calls to the state. The step has so many tasks at most.
BUCKETS = 128
_NEVER = -(1 << 62)
_ROW = np.dtype([("key", "<i8"), ("us", "<i8"), ("id", "<i8"), ("a", "<f8"), ("b", "<f8")])
_KEY = np.dtype([("h", "<f8"), ("us", "<i8"), ("id", "<i8")])
_OUT = "key string, event_id long, us long, h double, late boolean"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (list, map and timer state need it).
    A commit writes what has changed, not the whole state. Each partition of the state is
    opened and committed in every micro-batch, however few rows it got, so there are
    two for each core at most (a query that goes on keeps the number it began with)."""
    name = "spark.sql.shuffle.partitions"
    confs = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        name: str(min(int(spark.conf.get(name)), 2 * spark.sparkContext.defaultParallelism, BUCKETS)),
    }
    before = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Reorder(StatefulProcessor):
    def __init__(self, h0: float, slot_ms: int):
        self.h0, self.slot_ms = h0, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a bucket's keys by number, each one's h after its last applied row (us, id), the
        # number of the next buffered piece and the time of the timer that is set
        self.state = handle.getValueState("state", "names binary, keys binary, piece long, timer long")
        self.buffer = handle.getMapState("buffer", "slot long, piece long", "rows binary")

    def _now(self) -> tuple[list[str], np.ndarray, int, int]:
        if not self.state.exists():
            return [], np.zeros(0, _KEY), 0, -_NEVER
        names, keys, piece, timer = self.state.get()
        return json.loads(bytes(names)), np.frombuffer(bytes(keys), _KEY).copy(), int(piece), int(timer)

    def _wait(self, rows: np.ndarray, piece: int) -> tuple[int, int]:
        """Buffer rows in pieces; the next piece's number and the first end of a slot."""
        if not len(rows):
            return piece, -_NEVER
        rows = rows[np.argsort(rows["us"], kind="stable")]
        slots = rows["us"] // (1000 * self.slot_ms)
        for i in range(0, len(rows), PIECE_ROWS):
            self.buffer.updateValue((int(slots[i]), piece), (rows[i : i + PIECE_ROWS].tobytes(),))
            piece += 1
        return piece, (int(slots[0]) + 1) * self.slot_ms

    def _set(self, timer: int, end: int) -> int:
        """One timer at the first end of a buffered slot."""
        if end >= timer:
            return timer
        if timer != -_NEVER:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(end)
        return end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, keys, piece, timer = self._now()
        number = {name: i for i, name in enumerate(names)}
        for pdf in rows:
            pdf = pdf[~pdf["beat"].to_numpy(bool)]
            if not len(pdf):
                continue
            new = np.empty(len(pdf), _ROW)
            new["key"] = [number.setdefault(name, len(number)) for name in pdf["key"]]
            for name in _ROW.names[1:]:
                new[name] = pdf[name].to_numpy()
            keys = np.concatenate([keys, np.full(len(number) - len(keys), np.array((self.h0, _NEVER, _NEVER), _KEY))])
            last = keys[new["key"]]
            late = (new["us"] == _NEVER) | (new["us"] < last["us"]) | ((new["us"] == last["us"]) & (new["id"] <= last["id"]))
            if late.any():
                yield _rows([*number], new[late], np.full(int(late.sum()), np.nan), True)
            piece, end = self._wait(new[~late], piece)
            timer = self._set(timer, end)
        self.state.update((json.dumps([*number]).encode(), keys.tobytes(), piece, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted((int(s), int(p)) for s, p in self.buffer.keys())
        names, keys, piece, _ = self._now()
        due = [k for k in waiting if (k[0] + 1) * self.slot_ms <= upto]
        nearest = min(((s + 1) * self.slot_ms for s, _ in waiting[len(due) :]), default=-_NEVER)
        if due:
            rows = np.concatenate([np.frombuffer(bytes(self.buffer.getValue(k)[0]), _ROW) for k in due])
            for k in due:
                self.buffer.removeKey(k)
            ended = (rows["us"] // (1000 * self.slot_ms) + 1) * self.slot_ms <= upto
            piece, end = self._wait(rows[~ended], piece)
            nearest = min(nearest, end)
            rows = rows[ended]
            rows = rows[np.lexsort((rows["id"], rows["us"], rows["key"]))]
            A, B = segmented_scan(rows["key"], rows["a"], rows["b"])
            hs = A * keys["h"][rows["key"]] + B
            ends = np.flatnonzero(np.append(rows["key"][1:] != rows["key"][:-1], True))
            at = rows["key"][ends]
            keys["h"][at], keys["us"][at], keys["id"][at] = hs[ends], rows["us"][ends], rows["id"][ends]
            yield _rows(names, rows, hs, False)
        timer = self._set(-_NEVER, nearest)
        self.state.update((json.dumps(names).encode(), keys.tobytes(), piece, timer))


def _rows(names: list[str], rows: np.ndarray, h: np.ndarray, late: bool) -> pd.DataFrame:
    key = pd.Series([names[i] for i in rows["key"].tolist()], dtype=object)
    return pd.DataFrame({"key": key, "event_id": rows["id"], "us": rows["us"], "h": h, "late": late})


def stream_ordered_liquid_filter(
    events: DataFrame, x_tau: Column, x_in: Column, delay: str = "1 hour", log_dt: float = 0.0, h0: float = 0.0, slot_ms: int = SLOT_MS
) -> DataFrame:
    """Streaming liquid filter per ``user_id`` in ``(ts, event_id)`` order, for rows up to ``delay`` late.

    Rows whose time is within ``delay`` of the latest time seen in earlier
    micro-batches give the batch filter's result whatever the order they come
    in. Output (append): ``user_id, event_id, ts, h, late``; a row comes out
    when the watermark has passed its slot of ``slot_ms``. A row that comes after
    its slot was folded is emitted with ``late`` true and ``h`` null; so is a row
    without a time. A null gate keeps the state; rows with a null user are one
    sequence. A row without an event id is a heartbeat: it moves the watermark
    and is not emitted, so a source that falls silent can still release its last
    rows. Start the query inside ``state_store(spark)``.
    """
    a, b = liquid_gates(x_tau, x_in, log_dt)
    missing = a.isNull() | b.isNull()
    kind = events.schema["user_id"].dataType
    timed = events.withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", delay)
    d = timed.select(
        F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("")).alias("key"),  # no user: the empty text
        F.col("event_id").isNull().alias("beat"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.unix_micros("_ts"), F.lit(_NEVER)).alias("us"),  # a plain number: rows behind the watermark still reach the flag
        F.when(missing, 1.0).otherwise(a).alias("a"),
        F.when(missing, 0.0).otherwise(b).alias("b"),
    )
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    out = d.groupBy("bucket").transformWithStateInPandas(_Reorder(h0, slot_ms), _OUT, "append", "eventTime")
    ts = F.when(F.col("us") != _NEVER, F.timestamp_micros("us"))
    user = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind)
    return out.select(user.alias("user_id"), "event_id", ts.alias("ts"), "h", "late")
