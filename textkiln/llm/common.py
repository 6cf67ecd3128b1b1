"""Helpers shared by the operators: lineage cuts, checked broadcasts, Arrow maps, ordered sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.operators.ranking import in_order, numbered, running_totals  # noqa: F401
from textkiln.session import materialize

#: Rows of one Arrow batch turned into Python objects at a time, and bytes of their
#: texts (a longer text is a slice of its own).
SLICE_ROWS = 256
SLICE_BYTES = 8 << 20
#: Largest number of rows that ``checked_broadcast`` ships to every executor.
BROADCAST_ROWS = 50_000
#: Words remembered by one task before its cache is started anew.
CACHE_WORDS = 400_000


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder (survives lost executors)."""
    return materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else without one.

    The caller passes a frame that is cheap to count (a small aggregate or a
    cut table); beyond the bound Spark joins by shuffling and AQE splits skew.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_third(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder`` modulo ``modulus`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def map_texts(
    df: DataFrame,
    text: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list], list[Sequence]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns computed in Arrow batches from one text column.

    ``make`` is called once per task and returns a function from a list of
    texts (None for null) to one list per field. ``keep`` names the columns
    that stay (all by default). Batches are turned into Python objects
    a slice at a time, so memory follows the texts of one slice.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in {f for f, _ in fields}]
    names = [*keep, *([] if text in keep else [text])]
    src = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in fields])
    types = [_arrow_type(t) for _, t in fields]
    k, at_text, out = len(keep), names.index(text), keep + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at, rows in _slices(whole.column(at_text)):
                part = whole.slice(at, rows)
                made = work(part.column(at_text).to_pylist())
                cols = [part.column(i) for i in range(k)] + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=out)

    return src.mapInArrow(run, schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the slices that are worked on at a time."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(total[at - 1]) if at else 0
        end = int(np.searchsorted(total, before + SLICE_BYTES, "right"))
        rows = min(max(end - at, 1), SLICE_ROWS)
        yield at, rows
        at += rows


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class TokenTable(dict):
    """Number of every distinct token seen, with rows of values computed once per token.

    ``values(tokens)`` returns an array with one row per new token. The table
    starts anew after ``CACHE_WORDS`` tokens, which bounds a task's memory and
    changes no value.
    """

    def __init__(self, values: Callable[[list], np.ndarray], limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit, self.new = values, limit, []
        self.rows: np.ndarray | None = None
        self.used = 0

    def __missing__(self, token):
        self.new.append(token)
        self[token] = at = len(self)
        return at

    def look_up(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of all token lists in a row, the lists' lengths, and the table of values by number."""
        if len(self) > self.limit:
            self.clear()
            self.rows, self.used = None, 0
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if self.new or self.rows is None:
            fresh, self.new = self.compute(self.new), []
            if self.rows is None:
                self.rows = fresh
            else:
                if self.used + len(fresh) > len(self.rows):
                    self.rows = np.concatenate([self.rows[: self.used], np.empty((max(len(fresh), self.used),) + self.rows.shape[1:], self.rows.dtype)])
                self.rows[self.used : self.used + len(fresh)] = fresh
            self.used += len(fresh)
        return ids, sizes, self.rows


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` (rows) with the given sizes; empty runs give zero."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
