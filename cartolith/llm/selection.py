"""The largest values, or a fixed sample, of a table of any size, with little to send to the driver.

A sort with a limit would have every task send that many rows; here a first pass
finds a threshold, so that all tasks together send about as many as are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 64


def largest(df: DataFrame, value: str, most: int) -> DataFrame:
    """All rows whose positive ``value`` is at or above a threshold that at most ``most`` rows reach.

    Thresholds are 64 to each doubling; rows of equal value come together or not at all.
    """
    step = F.floor(F.log2(F.col(value).cast("double")) * _STEPS).cast("int")
    held = sorted((r["step"], r["count"]) for r in df.groupBy(step.alias("step")).count().collect())  # 64 rows for each doubling
    edge, total = None, 0
    for at, n in reversed(held):
        total += n
        if total > most:
            break
        edge = at
    return df.where(step >= F.lit(edge)) if edge is not None else df.limit(0)


def sample(df: DataFrame, key: Column, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of ``key``, the same on every run."""
    total = df.count()
    if total > 2 * n:
        df = df.where(F.xxhash64(key) <= F.lit(int((1 << 64) * (2 * n + 100) / total) - (1 << 63)) if (2 * n + 100) < total else F.lit(True))
    return df.orderBy(F.xxhash64(key), *ties).limit(n)
