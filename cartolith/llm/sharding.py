"""Sharding by longest-processing-time scheduling of groups of equal texts.

All groups, sorted by size, go to the least-loaded shard through a heap. Groups of
one size are interchangeable, so the schedule needs only how many groups there are
of each size; the driver gets that table and no group. Sizes that occur add up to
no more than all bytes, so it has at most the root of twice the corpus's bytes as
rows (245,000 for 30 GB), however many groups there are. Which group of a size goes
to which of its shards follows from its rank among them, found in the tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import look_up
from .storage import discard, written

ROW_BYTES = 16
_SUBS = 1024
_RANKED = 1 << 15  # groups of one size that one task ranks, about


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """Groups of each (size, count), by falling size, that each shard gets: one at a time to the least-loaded shard, ties to the lower one.

    Equal groups are dealt in rounds: while all shards' loads lie within one group of
    each other, every further round gives each shard one, in the order of the first.
    """
    heap = [(0, shard) for shard in range(shards)]
    out = []
    for size, count in sizes:
        given = [0] * shards
        while count:
            low, high = heap[0][0], max(heap)[0]
            rounds = count // shards if high - low <= size else 0
            if rounds > 1:  # one round in heap order brings all up by one group; loads keep their order
                heap = [(load + (rounds - 1) * size, shard) for load, shard in heap]
                given = [g + rounds - 1 for g in given]
                count -= (rounds - 1) * shards
            for _ in range(min(count, shards)):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                given[shard] += 1
                count -= 1
        out.append(given)
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text plus 16. Equal texts share a shard; null texts
    are a group of their own, apart from empty ones, with 0 bytes and the CRC of
    nothing, 0. A group never splits, so one larger than a shard's fair part makes
    its shard larger. slot counts a shard's rows from 0 without gaps, in an order
    that depends on the rows alone; equal rows get slots next to each other. Rows
    with a null doc_id are placed like others. Extra columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col("text")
    held = F.coalesce(text, F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(held) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(held).alias("text_crc32"),
            F.xxhash64(text, F.lit(1)).alias("k1"),
            F.xxhash64(F.lit(2), text, F.octet_length(text)).alias("k2"),
        ),
        "shard_rows",
    )
    groups = written(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "shard_groups")
    found = groups.groupBy("bytes").count().toPandas().sort_values("bytes", ascending=False)  # a row for each size that occurs
    given = schedule(list(zip(found["bytes"].tolist(), found["count"].tolist(), strict=True)), shards)
    upto = np.cumsum(np.array(given, np.int64).reshape(-1, shards), axis=1)  # of the groups of a size, those below upto[j] go to shards 0 to j
    subs = np.ceil(found["count"].to_numpy() / _RANKED).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(upto) + 1) * shards, pa.int32()), pa.array(upto.ravel()))
    plan = spark.createDataFrame(pa.table({"bytes": pa.array(found["bytes"].to_numpy(np.int64)), "subs": pa.array(subs), "upto": lists}))
    planned = look_up(groups, plan, "bytes").withColumn("part", F.pmod("k2", "subs"))
    counted = planned.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 32,768 groups
    begins = counted.select("bytes", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    order = Window.partitionBy("bytes", "part").orderBy("k1", "k2")
    ranked = planned.withColumn("rank", F.row_number().over(order) - 1).join(begins, ["bytes", "part"])
    shard = F.size(F.filter("upto", lambda u: u <= F.col("rank") + F.col("begin")))
    placed = written(ranked.select("k1", "k2", shard.cast("int").alias("shard")), "shard_placed")
    discard(groups)
    sharded = written(look_up(rows, placed, ["k1", "k2"]).withColumn("sub", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(_SUBS)).cast("int")), "shard_sharded")
    discard(rows, placed)
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "k1", "k2")
    return (
        sharded.join(F.broadcast(starts), ["shard", "sub"])  # shards * 1024 rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.row_number().over(within) - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
