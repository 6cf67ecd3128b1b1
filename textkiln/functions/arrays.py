"""Token-array helpers: padding, masking, slicing, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkiln.constants import EOT, IGNORE


def pad_to(arr: Column, length: int, value: int) -> Column:
    """Right-pad ``arr`` with ``value`` up to ``length`` (no-op when already long enough)."""
    n = F.greatest(F.lit(length) - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(F.lit(value).cast("int"), n))


def repeat_ignore(arr: Column) -> Column:
    """An all-ignored label array as long as ``arr``."""
    return F.array_repeat(F.lit(IGNORE).cast("int"), F.size(arr))


def append_eot(arr: Column) -> Column:
    return F.concat(arr, F.array(F.lit(EOT).cast("int")))


def tail(arr: Column, length: int) -> Column:
    """Last ``length`` elements (the whole array when shorter); empty stays empty."""
    n = F.least(F.size(arr), F.lit(length))
    return F.when(n > 0, F.slice(arr, -n, n)).otherwise(arr)


def count_valid(labels: Column, shifted: bool = True) -> Column:
    """Labels other than IGNORE; ``shifted`` skips position 0, which nothing predicts."""
    arr = F.slice(labels, 2, 2147483646) if shifted else labels
    return F.size(F.filter(arr, lambda x: x != IGNORE))


def array_md5(arr: Column) -> Column:
    """md5 of the comma-joined elements: a compact fingerprint for comparisons."""
    return F.md5(F.array_join(F.transform(arr, lambda x: x.cast("string")), ","))
