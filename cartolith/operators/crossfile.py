"""Cross-file dependencies of all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .context import numbered_within


def _linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References with the leaf they point to and its parent; the parent need not be kept in the tree."""
    side = lambda prefix, *columns: nodes.select(*(F.col(c).alias(prefix + c) for c in columns))
    ref = side("ref_", "node_id", "path", "name", "is_reference").where("ref_is_reference")
    ident = side("ident_", "node_id", "path", "parent_id")
    definition = side("def_", "node_id", "path", "node_type")
    links = edges.where("type = 'REFERENCES'").select(F.col("source").alias("ref_node_id"), F.col("target").alias("ident_node_id"))
    return links.join(ref, "ref_node_id").join(ident, "ident_node_id").join(definition, F.col("ident_parent_id") == F.col("def_node_id"))


def downstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Path, ref_name, node_type and def_path of references that leave their file, each once."""
    out = _linked(nodes, edges).where(F.col("ident_path") != F.col("ref_path"))
    return out.select(F.col("ref_path").alias("path"), F.col("ref_name"), F.col("def_node_type").alias("node_type"), F.col("def_path")).distinct()


def upstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Path, ref_path, ref_name and node_type of references that enter a file, its own too, each once."""
    return _linked(nodes, edges).select(F.col("ident_path").alias("path"), F.col("ref_path"), F.col("ref_name"), F.col("def_node_type").alias("node_type")).distinct()


def downstream_texts(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("def_path").alias("other"), scalars.downstream_text(F.col("ref_name"), F.col("node_type"), F.col("def_path")).alias("text"))


def upstream_texts(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("ref_path").alias("other"), scalars.upstream_text(F.col("ref_name"), F.col("ref_path"), F.col("node_type"), F.col("path")).alias("text"))


def interactions_by_file(texts: DataFrame) -> DataFrame:
    """Of each path a map from other file to its sorted texts."""
    each = texts.groupBy("path", "other").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    return each.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("other", "texts")))).alias("interactions"))


def file_edges(downstream_: DataFrame) -> DataFrame:
    """(src, dst) of every dependency between two files."""
    return downstream_.where(F.col("path") != F.col("def_path")).select(F.col("path").alias("src"), F.col("def_path").alias("dst")).distinct()


def dependency_files(edges: DataFrame) -> DataFrame:
    """Of each path the sorted other files that it uses."""
    return edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("files"))


def interactions_flat(texts: DataFrame) -> DataFrame:
    """Of each path all texts, sorted, in one row; for texts of a file's own references, which its size bounds."""
    return texts.groupBy("path").agg(F.sort_array(F.collect_list("text")).alias("interactions"))


def interaction_rows(texts: DataFrame) -> DataFrame:
    """X5 as rows: path, place from 1 among the path's sorted texts, and text; for paths that any number of files refer to."""
    return numbered_within(texts.select("path", "text"), "path", ("text",))


def distinct_files(nodes: DataFrame) -> DataFrame:
    """X6"""
    return nodes.select("path").distinct()
