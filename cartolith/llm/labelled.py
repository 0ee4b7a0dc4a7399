"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import sample
from .storage import written

HELD_OUT_OF = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text divides by 5; such rows are never learnt from. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text and ``label`` (0 or 1) of at most ``per_class`` labelled ids of each class, those of the smallest hashes.

    Only ids of ``docs`` are drawn, so a class has fewer than ``per_class`` only if
    ``docs`` has. Ids that are held out, null, or labelled both ways are left out;
    labels other than 0 and 1 are ignored. Rows of a repeated id all come.
    """
    labelled = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where(F.col("label") == F.col("other"))
        .select("doc_id", "label")
    )
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    known = written(labelled.join(ids, "doc_id", "left_semi"), "labelled_ids")
    one, two = (sample(known.where(F.col("label") == v), F.col("doc_id"), per_class, ["doc_id"]) for v in (0, 1))
    return docs.select("doc_id", "text").join(F.broadcast(one.union(two)), "doc_id")  # 2 * per_class rows at most
