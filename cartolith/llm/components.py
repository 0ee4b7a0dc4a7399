"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import look_up
from .storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """v and label (the smallest vertex reachable) of every vertex of ``edges`` (a, b), a row each.

    Each round points every vertex to its smallest neighbour, if that is smaller,
    follows the pointers to their ends and replaces all edges by those between
    different ends. Every vertex left has a neighbour, so each round at least halves
    them, and all rounds together cost a small multiple of the first. The rounds'
    pointers are composed from the last to the first.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("w")))
    links = written(both.distinct(), "cc_edges")
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        smallest = links.groupBy("u").agg(F.min("w").alias("w")).select(F.col("u").alias("v"), F.least("u", "w").alias("label"))
        rounds.append(_ends(written(smallest, "cc_pointers")))
        ends = rounds[-1]
        moved = written(look_up(links, ends.select(F.col("v").alias("u"), F.col("label").alias("a")), "u").select("a", "w"), "cc_moved")
        contracted = look_up(moved, ends.select(F.col("v").alias("w"), F.col("label").alias("b")), "w").where("a <> b")
        new = written(contracted.select(F.col("a").alias("u"), F.col("b").alias("w")).distinct(), "cc_edges")
        discard(links, moved)
        links = new
    discard(links)
    labels = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        further = labels.select(F.col("v").alias("label"), F.col("label").alias("_further"))
        composed = written(look_up(earlier, further, "label", "left").select("v", F.coalesce("_further", "label").alias("label")), "cc_labels")
        discard(earlier, labels)
        labels = composed
    return labels


def _ends(pointers: DataFrame) -> DataFrame:
    """``pointers`` (v, label) with each label replaced by where its own label leads in the end; each step doubles the way."""
    while True:
        further = pointers.where("v <> label").select(F.col("v").alias("label"), F.col("label").alias("_further"))
        jumped = written(look_up(pointers, further, "label", "left").select("v", F.coalesce("_further", "label").alias("label"), F.col("_further").isNotNull().alias("moved")), "cc_pointers")
        discard(pointers)
        pointers = jumped
        if pointers.where("moved").isEmpty():
            return pointers
