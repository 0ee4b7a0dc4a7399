"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt out over all cores if it has fewer partitions than there are cores, as one file of one row group has; larger inputs as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
