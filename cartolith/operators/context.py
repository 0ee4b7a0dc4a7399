"""The walk from all entry points at once, and the context text it makes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config, scalars
from ..sources.files import upsert
from ..storage import discard, written
from .incremental import support_change

_FEW = 20_000  # rows (path, label) that a join may broadcast, 3 MB at most for paths of 50 characters


def multi_source_bfs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """B1: path, entry_ord and depth of every file that ``seeds`` (path, entry_ord) reach over ``edges`` (src, dst).

    A file belongs to the first entry point that reaches it, at its shortest
    distance from there. The smallest (entry_ord, depth) spreads from files whose
    label fell in the round before; a round writes those alone, and cycles end for
    labels only fall. A smaller entry_ord may come late and still replaces a label.
    entry_ord may be of any type that can be ordered.
    """
    links = written(edges.select("src", "dst").distinct(), "bfs_edges")
    first = written(seeds.select("path", "entry_ord", F.lit(0).alias("depth")).groupBy("path").agg(F.min(_label()).alias("label")), "bfs")
    found = _spread([first], first, links)
    discard(links)
    return _best_labels(found).select("path", "label.entry_ord", "label.depth")


def _step(label: str, kind) -> Column:
    """The label that a file offers to those it uses."""
    return F.struct(F.col(f"{label}.entry_ord").alias("entry_ord"), (F.col(f"{label}.depth") + 1).alias("depth")).cast(kind)


def _side(table: DataFrame, n: int) -> DataFrame:
    """One side of a join, of ``n`` rows at most: broadcast if they are few, else both sides are dealt out.

    By Spark's own bound in bytes each of the joins of each round may send megabytes to the driver.
    """
    return F.broadcast(table) if n <= _FEW else table.hint("merge")


def _spread(found: list[DataFrame], frontier: DataFrame, links: DataFrame) -> list[DataFrame]:
    """Tables (path, label) of falling labels: ``found``, of which ``frontier`` is to spread, and those of all further rounds."""
    kind = frontier.schema["label"].dataType
    none = F.lit(None).cast(kind)
    while n := frontier.count():
        offers = links.join(_side(frontier, n), F.col("path") == F.col("src")).select(F.col("dst").alias("path"), none.alias("label"), _step("label", kind).alias("offer"))
        known = reduce(DataFrame.unionByName, found).select("path", "label", none.alias("offer"))
        best = known.unionByName(offers).groupBy("path").agg(F.min("label").alias("label"), F.min("offer").alias("offer"))
        frontier = written(best.where("offer IS NOT NULL AND (label IS NULL OR offer < label)").select("path", F.col("offer").alias("label")), "bfs")
        found = [*found, frontier]
    return found


def repaired_walk(labels: DataFrame, old_edges: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``multi_source_bfs`` of ``edges`` and ``seeds`` from the labels (path, entry_ord, depth) of an earlier walk over ``old_edges``.

    A label stands while a file with the label before it uses its file, or, at depth
    0, while its seed does. Labels that stand no longer are withdrawn, then those that
    stood on them; since depths rise along the way, no cycle holds itself up. The walk
    goes on from the files next to what was withdrawn, and from new edges and seeds.
    entry_ord has to name the same entry point in both walks: give its path.
    """
    links, before = (written(e.select("src", "dst").distinct(), "bfs_edges") for e in (edges, old_edges))
    labelled = written(labels.select("path", _label().alias("label")), "bfs")
    kind = labelled.schema["label"].dataType
    own = written(seeds.select("path", "entry_ord", F.lit(0).alias("depth")).groupBy("path").agg(F.min(_label()).cast(kind).alias("label")), "bfs_seeds")
    moved = written(support_change(before, links, ["src", "dst"]), "bfs_moved")
    lost, new = (moved.where(f"support = {s}").select("src", "dst") for s in (-1, 1))
    told = lambda t: t.select(F.col("path").alias("src"), _step("label", kind).alias("offer"))
    of_all, of_own = (partial(_side, n=t.count()) for t in (labelled, own))
    # labels at depth 0 without their seed, and those that came over a lost edge
    rootless = labelled.where("label.depth = 0").join(of_own(own), ["path", "label"], "left_anti").select("path")
    doubted = lost.join(of_all(told(labelled)), "src").select(F.col("dst").alias("path"), F.col("offer").alias("label")).join(of_all(labelled), ["path", "label"], "left_semi").select("path")
    standing, gone, n_gone = labelled, None, 0
    doubted = written(rootless.union(doubted).distinct(), "bfs_doubted")
    while n := doubted.count():
        of_few = partial(_side, n=n)  # a path has one label, so no more are asked, held and fall than are doubted
        asked = standing.join(of_few(doubted), "path", "left_semi")
        users = links.join(of_few(asked.select(F.col("path").alias("dst"), "label")), "dst")
        holders = users.join(of_all(told(standing).withColumnRenamed("offer", "label")), ["src", "label"]).select(F.col("dst").alias("path"))
        held = holders.union(asked.join(of_own(own), ["path", "label"], "left_semi").select("path")).distinct()
        fell = written(asked.join(of_few(held), "path", "left_anti"), "bfs_fell")
        n_fell = fell.count()
        if n_fell == 0:
            break
        of_fell = partial(_side, n=n_fell)
        gone, n_gone = fell if gone is None else gone.unionByName(fell), n_gone + n_fell
        standing = written(standing.join(of_fell(fell.select("path")), "path", "left_anti"), "bfs")
        next_ = before.union(links).join(of_fell(told(fell)), "src").select(F.col("dst").alias("path"), F.col("offer").alias("label"))  # a new edge may have held one up so far
        doubted = written(next_.join(of_all(standing), ["path", "label"], "left_semi").select("path").distinct(), "bfs_doubted")
    border = new if gone is None else new.union(links.join(_side(gone.select(F.col("path").alias("dst")), n_gone), "dst", "left_semi").select("src", "dst")).distinct()
    offers = border.join(of_all(told(standing)), "src").select(F.col("dst").alias("path"), "offer").union(own.select("path", F.col("label").alias("offer")))
    best = offers.groupBy("path").agg(F.min("offer").alias("offer")).join(of_all(standing), "path", "left")
    frontier = written(best.where("label IS NULL OR offer < label").select("path", F.col("offer").alias("label")), "bfs")
    return _best_labels(_spread([standing, frontier], frontier, links)).select("path", "label.entry_ord", "label.depth")


def _label() -> Column:
    return F.struct("entry_ord", "depth")


def _best_labels(found: list[DataFrame]) -> DataFrame:
    """The smallest label of each path among the rounds' new ones."""
    return reduce(DataFrame.unionByName, found).groupBy("path").agg(F.min("label").alias("label"))


def numbered(rows: DataFrame, order: Sequence[str | Column] = ("path",), name: str = "entry_ord", kind: str = "int") -> DataFrame:
    """``rows`` numbered from 1 by ``order``, with a count in each range of its values first, so no task sorts all rows.

    The ranges are drawn from a sample, for which Spark reads all rows once more; they are written first, so that nothing is computed twice.
    """
    plain = written(rows, "unnumbered")
    parts = written(plain.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    discard(plain)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    place = (F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).cast(kind).alias(name)
    return parts.join(F.broadcast(starts), "_part").select(*rows.columns, place)


def numbered_within(rows: DataFrame, group: str, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in each ``group``; a group of any size is spread over the ranges of its values; rows without a group go."""
    overall = numbered(rows, (group, *order), "_n", "long")
    first = overall.groupBy(group).agg(F.min("_n").alias("_first"))
    return overall.join(first, group).select(*rows.columns, (F.col("_n") - F.col("_first") + 1).alias(name))


def first_inclusion(walk: DataFrame, briefs: DataFrame) -> DataFrame:
    """B2: entry_ord, depth, path and brief of the critical files reached whose brief isn't empty."""
    return walk.join(briefs.where("brief <> ''").select("path", "brief"), "path").select("entry_ord", "depth", "path", "brief")


def context_pieces(included: DataFrame) -> DataFrame:
    """The context as rows ``place`` (from 1) and ``text``: the briefs by (entry_ord, depth, path), from the second on after an empty line.

    The texts in order are the context; it may be of any length, for no task holds it.
    """
    ordered = numbered(included, ("entry_ord", "depth", "path"), "place")
    return ordered.select("place", F.concat(F.when(F.col("place") > 1, "\n\n").otherwise(""), "brief").alias("text"))


def concat_context(included: DataFrame) -> DataFrame:
    """One row ``context``, for contexts that fit in one; empty without briefs."""
    ordered = F.sort_array(F.collect_list(F.struct("entry_ord", "depth", "path", "brief")))
    return included.agg(F.array_join(F.transform(ordered, lambda s: s["brief"]), "\n\n").alias("context"))


def context_tokens(pieces: DataFrame) -> DataFrame:
    """Tokens of all pieces together; none spans an empty line."""
    return pieces.agg(F.coalesce(F.sum(scalars.count_tokens(F.col("text"))), F.lit(0)).alias("context_tokens"))


def upsert_context(documents: DataFrame, contexts: DataFrame, version: str = "version") -> DataFrame:
    """One context document for each repository (repo_id, data)."""
    new = contexts.withColumn("document_type", F.lit(config.CONTEXT)).withColumn("file_path", F.lit(None).cast("string")).select(*documents.columns)
    return upsert(documents, new, ["repo_id", "file_path", "document_type"], version)


def context_coverage(critical: DataFrame, walk: DataFrame) -> DataFrame:
    """Critical files that no entry point reaches."""
    return critical.join(walk.select("path"), "path", "left_anti")
