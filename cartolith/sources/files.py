"""Sources and sinks: file trees, mapping caches, graph and document tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MAPPING


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Path (relative to ``root``), content and size (in characters) of all files below; bytes that are no UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    text = F.replace(F.expr("make_valid_utf8(content)"), F.lit("�"), F.lit(""))
    return raw.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^.*?" + _quoted(base), "").alias("path"), "content").select(
        "path", text.alias("content"), F.length(text).cast("long").alias("size"), F.col("content").alias("raw")
    )


def write_tree(files: DataFrame, root: str) -> None:
    """A file of each row (folder, content) below ``root``, as ``folder=…/<task>-<number>.txt``; a newline ends each, as Spark reads no empty files.

    The tasks write through pyarrow: Hadoop's writers start two processes for each
    local file, to set its rights and its checksum's. A task that runs again writes
    the same names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for folder, content in zip(batch.column("folder").to_pylist(), batch.column("content"), strict=True):
                place = f"{base}/folder={folder}"
                if place not in made:
                    store.create_dir(place)
                    made.add(place)
                with store.open_output_stream(f"{place}/{task}-{n}.txt") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                    out.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("folder", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def strict_text(files: DataFrame, otherwise: str | None = "IGNORE") -> DataFrame:
    """Text of ``raw`` bytes; those that are no UTF-8 become ``otherwise``, or go if that is None."""
    valid = F.expr("is_valid_utf8(raw)")
    if otherwise is None:
        return files.where(valid).withColumn("content", F.col("raw").cast("string"))
    return files.withColumn("content", F.when(valid, F.col("raw").cast("string")).otherwise(F.lit(otherwise)))


def read_mappings(cache: DataFrame) -> DataFrame:
    """S3: (namespace, ref_path, ref_line, ref_column, data JSON) with the JSON as struct ``mapping``; bad JSON goes."""
    return cache.withColumn("mapping", F.from_json("data", MAPPING)).where(F.col("mapping.reference").isNotNull())


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes by repository; a repository's earlier nodes are replaced."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def stored_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends are nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select(*edges.columns)


def write_edges(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    stored_edges(edges, nodes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "type").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of each key the row of the highest ``version``; an update wins a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_new")


def purge(table: DataFrame, gone: DataFrame, key: str = "repo_id") -> DataFrame:
    """The rows whose ``key`` is not in ``gone``."""
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def store_mappings(cache: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Keyed replace of mappings; new ones with a null in their key are skipped."""
    keys = ["namespace", "ref_path", "ref_line", "ref_column"]
    return upsert(cache, new.dropna(subset=keys), keys, version)
