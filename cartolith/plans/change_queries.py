"""Queries that keep tables up to date from one state of the files to the next, and must end where a full run does.

Old state: files whose id divides by 10 aren't there yet, those whose id divides by 7
have the first half of their text. New state: files whose id divides by 11 are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import config
from ..operators import context, graph, incremental, mental_model, references
from ..sources.store import KeyedStore, added, newest
from ..storage import new_folder, written
from . import bindings as b
from .registry import query

_BUCKETS = 4
_NEW_FILES = b.FILES.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)")


def _new(sql: str) -> str:
    return sql.replace(b.FILES, _NEW_FILES)


def states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols of the old and the new state, and the files that changed, came or went."""
    files = b.files(spark, d)
    half = F.when(F.col("doc_id") % 7 == 0, F.substring(F.col("content"), F.lit(1), F.floor(F.length("content") / 2).cast("int"))).otherwise(F.col("content"))
    place = lambda found: found.withColumn("doc_id", F.regexp_extract("path", r"/(\d+)\.", 1).cast("long"))
    symbols = lambda f: place(references.extract_symbols(references.extract_leaves(f, pattern=config.SYMBOL))).select("symbol", "path", "line", "col", "doc_id", F.col("text").alias("name"))
    old = written(symbols(files.where("doc_id % 10 <> 0").withColumn("content", half)), "symbols_old")
    new = written(symbols(files.where("doc_id % 11 <> 0")), "symbols_new")
    changed = files.where("doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0").select("path")
    return old, new, changed


def resolve(symbols: DataFrame) -> DataFrame:
    """A symbol has one definition here, so each reference meets one row."""
    return references.only_resolved(symbols, references.first_definitions(symbols, ("doc_id", "line", "col")))


def stores(spark: SparkSession, mappings: DataFrame) -> tuple[KeyedStore, KeyedStore]:
    """Edges and degrees of a full run."""
    edges = KeyedStore(spark, new_folder(spark, "edges"), StructType.fromDDL(incremental.EDGES), ["src", "dst"], _BUCKETS)
    degrees = KeyedStore(spark, new_folder(spark, "degrees"), StructType.fromDDL(incremental.DEGREES), ["path"], _BUCKETS)
    incremental.build(edges, degrees, mappings)
    return edges, degrees


def maintained(spark: SparkSession, d: str) -> tuple[KeyedStore, KeyedStore, DataFrame, DataFrame]:
    """Both stores after the change, the entry points before it, and those that came or went."""
    old, new, changed = states(spark, d)
    edges, degrees = stores(spark, resolve(old))
    before = incremental.entry_points(degrees.read())
    gone, come = incremental.mapping_changes(old, new, changed, resolve)
    _, entries = incremental.maintain(edges, degrees, gone, come)
    return edges, degrees, before, entries


@query("x4_maintained_edges", _new(f"WITH {b.MAPPINGS} SELECT path AS src, def_path AS dst, count(*) AS support FROM mappings WHERE path <> def_path GROUP BY 1, 2"))
def x4_maintained(spark: SparkSession, d: str) -> DataFrame:
    return maintained(spark, d)[0].read()


def named(symbols: DataFrame) -> DataFrame:
    """``resolve`` with the reference's name and the kind of node its definition lies in."""
    found = resolve(symbols).join(symbols.select("path", "line", "col", "name"), ["path", "line", "col"])
    return found.withColumn("node_type", F.lit("line"))


def _interactions(spark: SparkSession, d: str, schema: str, rows) -> DataFrame:
    """A store of interactions of the old state, filled by a change from nothing, then taken to the new state."""
    old, new, changed = states(spark, d)
    kind = StructType.fromDDL(schema)
    store = KeyedStore(spark, new_folder(spark, "interactions"), kind, kind.names[:-1], _BUCKETS)
    before = rows(named(old))
    incremental.maintain_support(store, before.limit(0), before)
    gone, come = incremental.mapping_changes(old, new, changed, named)
    incremental.maintain_support(store, rows(gone), rows(come))
    return store.read()


@query("x1_maintained_interactions", _new(f"WITH {b.MAPPINGS} SELECT path, text AS ref_name, 'line' AS node_type, def_path, count(*) AS support FROM mappings WHERE path <> def_path GROUP BY ALL"))
def x1_maintained(spark: SparkSession, d: str) -> DataFrame:
    return _interactions(spark, d, incremental.DOWNSTREAM, incremental.downstream_rows)


@query("x2_maintained_interactions", _new(f"WITH {b.MAPPINGS} SELECT def_path AS path, path AS ref_path, text AS ref_name, 'line' AS node_type, count(*) AS support FROM mappings GROUP BY ALL"))
def x2_maintained(spark: SparkSession, d: str) -> DataFrame:
    return _interactions(spark, d, incremental.UPSTREAM, incremental.upstream_rows)


@query(
    "g18_maintained_graph",
    _new(
        f"""WITH {b.MAPPINGS} SELECT 'node' AS kind, path AS source, path || ':' || line || ':' || col || ':word:2' AS target FROM symbols
UNION ALL SELECT DISTINCT 'reference', path || ':' || line || ':' || col || ':word:2', def_path || ':' || def_line || ':' || def_col || ':word:2' FROM mappings"""
    ),
)
def g18_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by file and references by their ends, both taken from the old state to the new one."""
    old, new, changed = states(spark, d)
    word = lambda prefix="": graph.node_id(F.col(f"{prefix}path"), F.col(f"{prefix}line"), F.col(f"{prefix}col"), F.lit("word"), 2)
    node_rows = lambda symbols: symbols.select("path", word().alias("node_id"), "name")
    reference_rows = lambda mappings: mappings.select(word().alias("source"), word("def_").alias("target"))
    nodes = KeyedStore(spark, new_folder(spark, "nodes"), StructType.fromDDL("path string, node_id string, name string"), ["path"], _BUCKETS)
    references_ = KeyedStore(spark, new_folder(spark, "references"), StructType.fromDDL(incremental.REFERENCES), ["source", "target"], _BUCKETS)
    incremental.maintain_files(nodes, node_rows(old), old)
    before = reference_rows(resolve(old))
    incremental.maintain_support(references_, before.limit(0), before)
    incremental.maintain_files(nodes, node_rows(new), changed)
    gone, come = incremental.mapping_changes(old, new, changed, resolve)
    incremental.maintain_support(references_, reference_rows(gone), reference_rows(come))
    return nodes.read().select(F.lit("node").alias("kind"), F.col("path").alias("source"), F.col("node_id").alias("target")).unionByName(references_.read().select(F.lit("reference").alias("kind"), "source", "target"))


@query("m5_maintained_entry_points", _new(f"WITH {b.CRITICAL} SELECT path FROM entries"))
def m5_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Entry points of the old state with those added and taken away that the change moved."""
    _, _, before, moved = maintained(spark, d)
    both = before.withColumn("change", F.lit(1)).unionByName(moved.select("path", F.col("change").cast("int").alias("change")))
    return both.groupBy("path").agg(F.sum("change").alias("n")).where("n > 0").select("path")


@query("b1_repaired_walk", _new(f"WITH RECURSIVE {b.WALK} SELECT w.path, e.path AS entry, w.depth FROM walk w JOIN entries e ON w.entry_ord = e.entry_ord"))
def b1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The walk of the new state, repaired from that of the old one."""
    old, new, _ = states(spark, d)
    before, after = (written(incremental.edge_rows(resolve(s)).distinct(), "file_edges") for s in (old, new))
    seeds = lambda edges: incremental.entry_points(mental_model.degree(edges)).select("path", F.col("path").alias("entry_ord"))
    walk = context.multi_source_bfs(before, seeds(before))
    return context.repaired_walk(walk, before, after, seeds(after)).withColumnRenamed("entry_ord", "entry")


@query(
    "s6_store_in_buckets",
    """WITH o AS (SELECT o_custkey AS k, max((o_orderdate, o_orderkey)) AS top, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1)
SELECT k, top[2] AS o_orderkey, n FROM o""",
)
def s6_store(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's newest order and number of orders, brought in by two updates that overlap."""
    orders = b.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("version"), "o_orderkey")
    latest = KeyedStore(spark, new_folder(spark, "orders"), orders.schema, ["k"], _BUCKETS)
    counts = KeyedStore(spark, new_folder(spark, "counts"), StructType.fromDDL("k long, n long"), ["k"], _BUCKETS)
    for part in (orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 = 0")):
        latest.update(part, newest(["k"], "version"))
        counts.update(part.groupBy("k").agg(F.count("*").alias("n")), added(["k"], ["n"]))
    return latest.read().join(counts.read(), "k").select("k", "o_orderkey", "n")
