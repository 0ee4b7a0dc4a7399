"""Lookups by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

MOST_HOT = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key: inner, left, or left_semi.

    Keys that hold more than a thousandth of all rows, of which there can't be a
    thousand, are looked up where their rows lie, in a broadcast of their rows of
    ``table``; all others are dealt out by key, so no task gets more than a
    thousandth of the rows for one key. Both sides are read twice: give tables that
    are written, or cheap to make. A key that is null counts as no key.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    counts = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    most = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    least = max(MOST_HOT, (most.total or 0) // MOST_HOT)
    hot = [tuple(r)[:-1] for r in counts.where(F.col("_n") > least).collect()] if (most.top or 0) > least else []  # fewer than MOST_HOT rows
    if not hot:
        return rows.join(table, names, how)
    some = F.coalesce(_among([F.col(c) for c in names], hot, [rows.schema[c].dataType for c in names]), F.lit(False))
    near = rows.where(some).join(F.broadcast(table.where(some)), names, how)  # fewer than MOST_HOT rows
    return near.unionByName(rows.where(~some).join(table.where(~some), names, how))


def _among(keys: Sequence[Column], hot: list[tuple], kinds: Sequence[DataType]) -> Column:
    if len(keys) == 1:
        return keys[0].isin([h[0] for h in hot if h[0] is not None])
    typed = lambda h: F.struct(*(F.lit(x).cast(t) for x, t in zip(h, kinds, strict=True)))
    return F.struct(*keys).isin([typed(h) for h in hot if None not in h])
