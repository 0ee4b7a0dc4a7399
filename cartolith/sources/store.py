"""A keyed table in buckets of which an update rewrites only those it touches.

Rows lie in folders by a hash of their key. A version of the table is a manifest, a
small table that names the folder of each bucket that has rows; an update writes the
buckets it touches anew and then a manifest that names them in place of the old ones.
A reader sees a version whole, for a manifest counts once its write has been
committed; a writer that fails leaves the version before. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedStore:
    """``path``: a folder that driver and executors share; ``keys``: the columns that tell rows apart; ``buckets``: the same at every use."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 256):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """Number of the newest committed manifest; 0 without one."""
        return max((int(p.getName()) for p in self._listed("manifest") if any(f.getName() == "_SUCCESS" for f in self._listed(f"manifest/{p.getName()}"))), default=0)

    def _listed(self, name: str) -> list:
        """What a folder of the store holds."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        return [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/{version}").collect()  # a row a bucket
        return {r.bucket: r.folder for r in rows}

    def read(self, only: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or the rows of some buckets."""
        held = self.manifest(version)
        folders = [f"{self.path}/data/{held[b]}/_bucket={b}" for b in sorted(held) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # self.buckets at most

    def update(self, rows: DataFrame, merge: Merge, touched: list[int] | None = None) -> list[int]:
        """Puts ``merge(old, rows)`` in place of the rows of the buckets that ``rows`` touch, and gives their numbers; they may be given."""
        version = self.version()
        held, touched = self.manifest(version), self.touched(rows) if touched is None else touched
        if not touched:
            return []
        new = merge(self.read(touched, version), rows).select(*self.schema.names).withColumn("_bucket", self._bucket())
        folder = uuid.uuid4().hex
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        names = [p.getName() for p in self._listed(f"data/{folder}")]
        filled = [int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")]
        after = {b: f for b, f in held.items() if b not in set(touched)} | dict.fromkeys(filled, folder)
        manifest = self.spark.createDataFrame(list(after.items()), "bucket int, folder string")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/{version + 1}")
        return touched


def newest(keys: Sequence[str], version: str) -> Merge:
    """S6 as a merge: of each key the row of the highest ``version``; an update wins a tie. An aggregate, so no window sorts all rows of a key."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.select(*old.columns).withColumn("_new", F.lit(1)))
        order = F.struct(F.col(version).isNotNull(), version, "_new")
        best = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), order).alias("_row"))
        return best.select("_row.*")

    return merge


def added(keys: Sequence[str], counts: Sequence[str]) -> Merge:
    """Counts added up key by key; rows whose counts are all 0 go."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.unionByName(rows.select(*old.columns))
        total = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
        return total.where(" OR ".join(f"{c} <> 0" for c in counts))

    return merge
