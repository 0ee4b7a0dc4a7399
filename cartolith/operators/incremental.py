"""Nodes, references, interactions, dependencies, degrees and entry points kept up to date by what changed.

A table is kept as counts of support: an edge between two files is there while at
least one reference supports it. A change is a table of counts to add, of which only
the keys it names are looked up; edges that come or go change degrees, and degrees
that change move entry points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KeyedStore, added
from ..storage import written

EDGES = "src string, dst string, support long"
DEGREES = "path string, out_degree long, in_degree long"
DOWNSTREAM = "path string, ref_name string, node_type string, def_path string, support long"
UPSTREAM = "path string, ref_path string, ref_name string, node_type string, support long"
REFERENCES = "source string, target string, support long"


def affected_symbols(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols whose references may resolve differently: those that a changed, new or vanished file (path) has or had."""
    touched = lambda t: t.join(changed.select("path"), "path", "left_semi").select("symbol")
    return touched(old).union(touched(new)).distinct()


def mapping_changes(old: DataFrame, new: DataFrame, changed: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Mappings that go and mappings that come when the symbols (path, symbol, …) of ``changed`` files turn from ``old`` into ``new``.

    ``resolve`` maps symbols to mappings; it only sees the affected symbols, all
    occurrences of them.
    """
    symbols = written(affected_symbols(old, new, changed), "affected")
    return tuple(resolve(t.join(symbols, "symbol", "left_semi")) for t in (old, new))


def support_change(gone: DataFrame, come: DataFrame, keys: Sequence[str], name: str = "support") -> DataFrame:
    """``keys`` and how many more rows of ``come`` than of ``gone`` have them, where that isn't 0."""
    sign = lambda t, s: t.select(*keys, F.lit(s).cast("long").alias(name))
    return sign(gone, -1).unionByName(sign(come, 1)).groupBy(*keys).agg(F.sum(name).alias(name)).where(f"{name} <> 0")


def edge_rows(mappings: DataFrame) -> DataFrame:
    """Src and dst of each mapping that leaves its file."""
    return mappings.where("path <> def_path").select(F.col("path").alias("src"), F.col("def_path").alias("dst"))


def crossings(old: DataFrame, change: DataFrame, keys: Sequence[str], name: str = "support") -> DataFrame:
    """``keys`` and +1 or -1 of what the change brings into being or ends; ``old`` has at least the keys of ``change``'s that there are."""
    before = change.withColumnRenamed(name, "_more").join(old, list(keys), "left").withColumn("_was", F.coalesce(name, F.lit(0)))
    is_, was = (F.col("_was") + F.col("_more") > 0).cast("long"), (F.col("_was") > 0).cast("long")
    return before.select(*keys, (is_ - was).alias("change")).where("change <> 0")


def degree_change(edges: DataFrame) -> DataFrame:
    """path, out_degree and in_degree to add for edges (src, dst, change)."""
    zero = F.lit(0).cast("long")
    ends = edges.select(F.col("src").alias("path"), F.col("change").alias("out_degree"), zero.alias("in_degree")).unionByName(edges.select(F.col("dst").alias("path"), zero.alias("out_degree"), F.col("change").alias("in_degree")))
    return ends.groupBy("path").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree")).where("out_degree <> 0 OR in_degree <> 0")


def entry_points(degrees: DataFrame) -> DataFrame:
    """M5 from degrees: files that use another and that none uses."""
    return degrees.where("out_degree > 0 AND in_degree = 0").select("path")


def downstream_rows(mappings: DataFrame) -> DataFrame:
    """X1 with repeats: each mapping (path, name, def_path, node_type) that leaves its file."""
    return mappings.where("path <> def_path").select("path", F.col("name").alias("ref_name"), "node_type", "def_path")


def upstream_rows(mappings: DataFrame) -> DataFrame:
    """X2 with repeats: each mapping seen from its definition's file, its own references too."""
    return mappings.select(F.col("def_path").alias("path"), F.col("path").alias("ref_path"), F.col("name").alias("ref_name"), "node_type")


def maintain_support(store: KeyedStore, gone: DataFrame, come: DataFrame, name: str = "support") -> DataFrame:
    """Takes rows that went and came, of the store's keys and none of them null, into a store of counts; the keys that came into being (+1) or ended (-1).

    A row that several references give is there while one of them is. Rows that go
    and come alike cancel out, and only buckets of the others are read and written.
    """
    change = written(support_change(gone, come, store.keys, name), "support_change")
    buckets = store.touched(change)
    moved = written(crossings(store.read(buckets), change, store.keys, name), "moved")
    store.update(change, added(store.keys, [name]), buckets)
    return moved


def maintain_files(store: KeyedStore, rows: DataFrame, changed: DataFrame) -> list[int]:
    """G18 as a store by path: the rows of changed and new files in place of theirs before; vanished ones of ``changed`` (path) go. The buckets it wrote."""
    paths = written(changed.select("path").distinct(), "changed")
    fresh = rows.join(paths, "path", "left_semi")
    return store.update(fresh, lambda old, new: old.join(paths, "path", "left_anti").unionByName(new.select(*old.columns)), store.touched(paths))


def build(edges: KeyedStore, degrees: KeyedStore, mappings: DataFrame) -> None:
    """Fills two empty stores with the edges and degrees of all mappings."""
    count = edge_rows(mappings).groupBy("src", "dst").agg(F.count("*").alias("support"))
    everywhere = lambda store: list(range(store.buckets))
    edges.update(count, added(["src", "dst"], ["support"]), everywhere(edges))
    degrees.update(degree_change(edges.read().select("src", "dst", F.lit(1).cast("long").alias("change"))), added(["path"], ["out_degree", "in_degree"]), everywhere(degrees))


def maintain(edges: KeyedStore, degrees: KeyedStore, gone: DataFrame, come: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes mappings that went and came into both stores; edges (src, dst, change) and entry points (path, change) that came or went, +1 or -1.

    Only buckets of changed edges and of files whose degrees change are read and
    written.
    """
    moved = maintain_support(edges, edge_rows(gone), edge_rows(come))
    more = written(degree_change(moved), "degree_change")
    buckets = degrees.touched(more)
    before = written(degrees.read(buckets).join(more.select("path"), "path", "left_semi"), "degrees_before")
    degrees.update(more, added(["path"], ["out_degree", "in_degree"]), buckets)
    after = added(["path"], ["out_degree", "in_degree"])(before, more)
    was, is_ = (entry_points(t).withColumn("change", F.lit(s)) for t, s in ((before, -1), (after, 1)))
    return moved, was.unionByName(is_).groupBy("path").agg(F.sum("change").alias("change")).where("change <> 0")
