"""Fields of jobs that no column foresees: VARIANT payloads folded field by field.

An event's payload is a JSON object of fields to set. A name with dots sets a place
inside (``stages.PRECHECK``), any other name the whole field. A record is a table of
its leaves, (path array, value VARIANT), so records need no common schema, and an
event costs what it sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config
from ..storage import written

LEVELS = 4  # objects are taken apart to this depth below the place that is set


def assignments(events: DataFrame, by: Sequence[str] = ("job_id",), order: str = "seq", payload: str = "payload") -> DataFrame:
    """``by``, ``order``, path and value (VARIANT) of each field that an event's JSON text sets.

    Null, broken and empty payloads and those that aren't objects set nothing; a
    JSON null is a value. Numbers keep their kind.
    """
    fields = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    return events.select(*by, order, F.explode(fields).alias("_name", "value")).select(*by, order, F.split("_name", r"\.").alias("path"), "value")


def leaves(sets: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``sets`` with objects taken apart, one row a leaf. Lists, empty objects and objects below ``levels`` are leaves."""
    others = [c for c in sets.columns if c not in ("path", "value")]
    rows = sets
    for _ in range(levels):
        inner = rows.select("*", F.explode_outer(F.try_variant_get("value", "$", "map<string,variant>")).alias("_key", "_inner"))
        whole = F.col("_key").isNull()
        rows = inner.select(*others, F.when(whole, F.col("path")).otherwise(F.concat("path", F.array("_key"))).alias("path"), F.when(whole, F.col("value")).otherwise(F.col("_inner")).alias("value"))
    return rows


def _above(path: str, least: int = 0) -> F.Column:
    """All beginnings of a path, the path itself only with ``least`` 0."""
    return F.transform(F.sequence(F.lit(1), F.size(path) - least), lambda n: F.slice(path, 1, n))


def fold_fields(events: DataFrame, by: Sequence[str] = ("job_id",), order: str = "seq", payload: str = "payload", levels: int = LEVELS) -> DataFrame:
    """D14 for any fields: ``by``, path, value and ``order`` of every leaf of each record after all events.

    The latest event that gives a leaf decides. Setting a place ends all that lay
    below it before, and setting a place below a leaf ends that leaf. Of one event,
    later than another by ``order``, nothing ends what it sets itself. Events of one
    ``order`` count as one; where they give the same leaf, the larger JSON text
    stays. Aggregates combine before the shuffle, so an event-rich record is no hot
    key; a leaf meets the places above it by equality of paths.
    """
    sets = assignments(events, by, order, payload)
    keys = [*by, "path"]
    found = leaves(sets, levels)
    last = written(found.groupBy(*keys).agg(F.max_by("value", F.struct(order, F.to_json("value"))).alias("value"), F.max(order).alias(order)), "fields")  # read three times, and far smaller than the events
    placed = sets.groupBy(*keys).agg(F.max(order).alias("_set"))
    # a whole set above or at a leaf, later than it
    over = last.select(*keys, order, F.explode(_above("path")).alias("_place"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    ended = over.alias("l").join(placed.alias("s"), [*same, F.col("l._place") == F.col("s.path")]).where(F.col("s._set") > F.col(f"l.{order}")).select(*(F.col(f"l.{k}").alias(k) for k in keys))
    # a later leaf below
    below = last.where(F.size("path") > 1).select(*by, F.explode(_above("path", 1)).alias("path"), F.col(order).alias("_below")).groupBy(*keys).agg(F.max("_below").alias("_below"))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    grown = last.alias("l").join(below.alias("s"), match).where(F.col("s._below") > F.col(f"l.{order}")).select(*(F.col(f"l.{k}").alias(k) for k in keys))
    gone = ended.unionByName(grown).distinct()
    return last.alias("l").join(gone.alias("s"), match, "left_anti")


def shown_fields(fields: DataFrame, names: Sequence[str] = config.PRECHECK_METRICS, stage: str = "PRECHECK") -> DataFrame:
    """D9 for any fields: all but the metrics of one stage that aren't listed."""
    inside = (F.size("path") > 3) & (F.get("path", F.lit(0)) == "stages") & (F.get("path", F.lit(1)) == stage) & (F.get("path", F.lit(2)) == "metrics")
    return fields.where(~inside | F.get("path", F.lit(3)).isin(*names))


def records(fields: DataFrame, by: Sequence[str] = ("job_id",)) -> DataFrame:
    """``by`` and ``record``, a VARIANT object of each record's leaves by dotted name; a record's fields are few."""
    entry = F.struct(F.array_join("path", ".").alias("name"), "value")
    packed = fields.groupBy(*by).agg(F.collect_list(entry).alias("_fields"))
    return packed.select(*by, F.to_variant_object(F.map_from_entries("_fields")).alias("record"))
