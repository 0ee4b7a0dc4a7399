"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_tables: dict[str, list[str]] = {}
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="cartolith-")
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; ``clear`` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that no result still reads."""
    for table in tables:
        path = _places.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, [path])


def mark(spark: SparkSession) -> int:
    """The number of tables so far, for ``clear``."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Deletes the tables this application has written, or those after a ``mark``, but for ``keep``; results that read them are then gone too."""
    kept = {_places.get(df) for df in keep}
    _delete(spark, [p for p in _tables.get(spark.sparkContext.applicationId, [])[since:] if p not in kept])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    known = _tables.get(context.applicationId, [])
    for path in paths:
        known.remove(path)
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
