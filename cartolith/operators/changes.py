"""Change detection, and upkeep of the reference cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import purge, upsert

KEYS = ("namespace", "path")
REF_KEYS = ("namespace", "ref_path", "ref_line", "ref_column")


def changed_files(current: DataFrame, previous: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Current files whose sha1 is new or differs; deleted files don't show."""
    before = previous.select(*keys, F.col("sha1").alias("_before"))
    return current.join(before, list(keys), "left").where(~F.col("sha1").eqNullSafe(F.col("_before"))).select(*current.columns)


def impacted_refs(def_index: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose references point into a changed file."""
    hit = changed.select("namespace", F.col("path").alias("def_path"))
    return def_index.join(hit, ["namespace", "def_path"], "left_semi").select("namespace", F.col("ref_path").alias("path")).distinct()


def without_impacted(mappings: DataFrame, def_index: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings and index rows that point into no changed file."""
    hit = changed.select("namespace", F.col("path").alias("def_path"))
    gone = def_index.join(hit, ["namespace", "def_path"], "left_semi").select(*REF_KEYS).distinct()
    return mappings.join(gone, list(REF_KEYS), "left_anti"), def_index.join(gone, list(REF_KEYS), "left_anti")


def recompute_set(current: DataFrame, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """Changed and impacted files that exist."""
    both = changed.select(*KEYS).union(impacted.select(*KEYS)).distinct()
    return both.join(current.select(*KEYS), list(KEYS), "left_semi")


def carried_forward(mappings: DataFrame, recompute: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """C4: cached mappings of existing files that had a sha before and need no new look."""
    named = lambda df: df.select("namespace", F.col("path").alias("ref_path"))
    keys = ["namespace", "ref_path"]
    return mappings.join(named(recompute), keys, "left_anti").join(named(current), keys, "left_semi").join(named(previous.where("sha1 IS NOT NULL")), keys, "left_semi").select(*mappings.columns)


def build_def_index(mappings: DataFrame) -> DataFrame:
    """A row for each file a reference is defined in, from the struct column ``mapping``."""
    each = mappings.select("namespace", F.explode("mapping.definitions.file_path").alias("def_path"), "ref_path", "ref_line", "ref_column")
    return each.where(F.col("def_path") != "").distinct()


def replace_mappings(mappings: DataFrame, new: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The mappings of recomputed files are replaced by the new ones."""
    gone = recomputed.select("namespace", F.col("path").alias("ref_path"))
    return mappings.join(gone, ["namespace", "ref_path"], "left_anti").select(*mappings.columns).unionByName(new)


def update_file_state(previous: DataFrame, current: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The sha1 of recomputed files, all others' as before."""
    return upsert(previous, current.join(recomputed, list(KEYS), "left_semi").select(*previous.columns), KEYS, "updated_at")


def dedupe_positions(refs: DataFrame) -> DataFrame:
    """C7"""
    return refs.dropDuplicates(["path", "line", "col"])


def reset_namespace(table: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """Drops the rows of namespaces whose resolver (namespace, resolver) is no longer the stored one."""
    other = stored.withColumnRenamed("resolver", "_stored").join(current, "namespace").where(F.col("_stored") != F.col("resolver"))
    return purge(table, other, "namespace")
