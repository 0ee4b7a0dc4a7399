"""Exact top-k inner products with multi-resolution segment statistics.

A vector cut into segments of l components, each with mean m and deviation s, has
with another vector the squared distance of at least the sum of
l * ((m - m')**2 + (s - s')**2), and so, both norms being known, an inner product
of at most the sum of l * (m * m' + s * s'). The candidates of the highest coarse
bounds give each query a floor first; pairs below it are dropped, from coarse
segments to fine ones, and exact products follow for the pairs that survive.

Queries and candidates meet in blocks of bounded size on a grid: a query row is
sent once for each block of candidates and a candidate once for each block of
queries, and a task keeps k rows for each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
LEVELS = (16, 8, 4)
_TILE, _PACK, _SEEDS = 128, 1024, 32
_EXACT = float(1 << 52)  # sums of products below it are exact in floats
_DENSE = 0.25  # share of surviving pairs from which whole tiles are multiplied
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _statistics(x: np.ndarray, size: int) -> np.ndarray:
    """Means and deviations of segments of ``size`` components (the last may be shorter), times the root of their length."""
    edges = np.arange(0, x.shape[1], size)
    length = np.diff(np.append(edges, x.shape[1])).astype(float)
    total, square = np.add.reduceat(x, edges, axis=1), np.add.reduceat(x * x, edges, axis=1)
    mean = total / length
    deviation = np.sqrt(np.maximum(square / length - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.tile(length, 2))


def _pair_products(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, c: np.ndarray, easy: bool) -> np.ndarray:
    """Exact products of the pairs of rows (q, c), at the ends of the 64-bit range where they lie beyond it."""
    if easy:
        return np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + 65536]], vectors[c[a : a + 65536]]) for a in range(0, max(len(q), 1), 65536)]).astype(np.int64)
    whole = lambda rows: [[int(v) for v in row] for row in rows]
    left, right = dict(zip(u := np.unique(q), whole(queries[u]), strict=True)), dict(zip(u := np.unique(c), whole(vectors[u]), strict=True))
    return np.array([min(max(sum(x * y for x, y in zip(left[i], right[k], strict=True)), int(_LEAST) + 1), int(_MOST)) for i, k in zip(q.tolist(), c.tolist(), strict=True)], np.int64)


def _best(rows: np.ndarray, ids: np.ndarray, products: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` highest products, ties to the smaller id."""
    order = np.lexsort((ids, -products, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], "left")
    return order[place < k]


def top_products(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, work: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, ids and products of each query's k highest products with other ids, ties to the smaller id.

    queries, vectors: whole numbers as floats. ``work`` counts the pairs, those
    that survive each level, and the exact products made.
    """
    dims = queries.shape[1]
    levels = [s for s in LEVELS if s < dims] or [max(dims, 1)]
    with np.errstate(over="ignore", invalid="ignore"):  # bounds of huge vectors may be infinite or undefined, and then drop nothing
        q_stats, c_stats = ([_statistics(x, s) if dims else np.zeros((len(x), 1)) for s in levels] for x in (queries, vectors))
        q_norm, c_norm = (np.sqrt((x**2).sum(axis=1)) for x in (queries, vectors))
        slack = 1 + 1e-6 * (1 + q_norm * c_norm.max(initial=0))
    easy = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dims, 1) < _EXACT
    work = {} if work is None else work
    add = lambda name, n: work.__setitem__(name, work.get(name, 0) + int(n))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries) if len(vectors) else 0, _TILE):
        b = min(a + _TILE, len(queries))
        other = query_ids[a:b, None] != ids[None, :]
        add("pairs", other.sum())
        with np.errstate(over="ignore", invalid="ignore"):
            bound = q_stats[0][a:b] @ c_stats[0].T
        bound = np.where(other, np.where(np.isnan(bound), np.inf, bound) + slack[a:b, None], -np.inf)
        seeds = min(max(_SEEDS, 4 * k), len(ids))
        chosen = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds] if seeds < len(ids) else np.tile(np.arange(len(ids)), (b - a, 1))
        rows, cols = np.repeat(np.arange(b - a), seeds), chosen.ravel()
        real = other[rows, cols]
        rows, cols = rows[real], cols[real]
        products = _pair_products(queries, vectors, rows + a, cols, easy)
        add("products", len(rows))
        kept = _best(rows, ids[cols], products, k)
        rows, cols, products = rows[kept], cols[kept], products[kept]
        floor = np.full(b - a, -np.inf)
        full = np.flatnonzero(np.bincount(rows, minlength=b - a) == k)
        lowest = np.full(b - a, np.inf)
        np.minimum.at(lowest, rows, products.astype(float))
        floor[full] = lowest[full]
        live = other & (bound >= floor[:, None])
        np.put_along_axis(live, chosen, False, axis=1)  # their products are known
        for level, (qs, cs) in enumerate(zip(q_stats, c_stats, strict=True)):
            if level and live.mean() > _DENSE:
                with np.errstate(over="ignore", invalid="ignore"):
                    live &= ~(qs[a:b] @ cs.T + slack[a:b, None] < floor[:, None])
            elif level:
                r, c = np.nonzero(live)
                with np.errstate(over="ignore", invalid="ignore"):
                    live[r, c] = ~(np.einsum("ij,ij->i", qs[r + a], cs[c]) + slack[r + a] < floor[r])
            add(f"live_{levels[level]}", live.sum())
        if easy and live.mean() > _DENSE:
            add("products", live.size)
            dense = queries[a:b] @ vectors.T
            live &= dense >= floor[:, None]
            if live.sum() > 4 * k * (b - a):  # the highest k alone, and what ties with the lowest of them
                masked = np.where(live, dense, -np.inf)
                edge = np.partition(masked, -k, axis=1)[:, -k] if len(ids) >= k else np.full(b - a, -np.inf)
                live &= masked >= edge[:, None]
            r, c = np.nonzero(live)
            more = dense[r, c].astype(np.int64)
        else:
            r, c = np.nonzero(live)
            add("products", len(r))
            more = _pair_products(queries, vectors, r + a, c, easy)
        rows, cols, products = np.concatenate([rows, r]), np.concatenate([cols, c]), np.concatenate([products, more])
        kept = _best(rows, ids[cols], products, k)
        found.append((rows[kept] + a, ids[cols[kept]], products[kept]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))


def _packed(rows: DataFrame, block: Column, name: str, scale: float) -> DataFrame:
    """Rows (id, v) as a few rows of packed numbers floor(scale * v): block, dims, ids and vectors of at most 1024 rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, blocks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            v = batch.column("v")
            sizes, flat = v.value_lengths().to_numpy(zero_copy_only=False), np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            at = np.concatenate(([0], np.cumsum(sizes)))
            out: list[tuple] = []
            for dims in np.unique(sizes):
                for kept in np.unique(blocks[sizes == dims]):
                    rows_ = np.flatnonzero((sizes == dims) & (blocks == kept))
                    for part in np.array_split(rows_, max(1, -(-len(rows_) // _PACK))):
                        x = flat[at[part][:, None] + np.arange(dims)[None, :]]
                        small = np.abs(x).max(initial=0) < 1 << 15
                        out.append((int(kept), int(dims), bool(small), ids[part].astype(np.int64).tobytes(), x.astype(np.int16 if small else float).tobytes()))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "dims", "small", "ids", "vectors"])

    return rows.select(block.alias("block"), "id", "v").mapInArrow(pack, "block long, dims int, small boolean, ids binary, vectors binary").select(
        F.col("block").alias(f"{name}_block"), "dims", "small", "ids", "vectors"
    )


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["ids"]])
    dims = int(pdf["dims"].iloc[0])
    vectors = [np.frombuffer(b, np.int16 if small else float).astype(float) for b, small in zip(pdf["vectors"], pdf["small"], strict=True)]
    return ids, np.concatenate(vectors).reshape(len(ids), dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest products of each query among ``vectors`` (vec_id, embedding).

    Components become floor(scale * x). Rows whose id or vector is null, or whose
    vector holds null or, scaled, non-finite components, take no part. Queries: rows
    for which ``is_query`` holds, one of each id (of repeated ids the smallest
    vector). Candidates: all rows of other ids, repeated ones as often as they stand
    there. Vectors of another length are no candidates. Ties go to the smaller
    vec_id; score is exact, and where it does not fit in 64 bits it is the nearest
    number that does. An empty table gives an empty result; extra columns are ignored.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, finite)
    rows = vectors.where(fit).select(F.col("vec_id").cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    query_blocks, candidate_blocks = max(1, -(-counts.q // query_block)), max(1, -(-counts.n // candidate_block))
    asked = _packed(queries, F.pmod(F.xxhash64("id"), F.lit(query_blocks)), "query", scale).withColumn("candidate_block", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1)).cast("array<long>")))
    held = _packed(rows, F.pmod(F.xxhash64("id", "v"), F.lit(candidate_blocks)), "candidate", scale).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        query_ids, q = _unpacked(left)
        ids, c = _unpacked(right)
        at, found, score = top_products(query_ids, q, ids, c, k)
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": found, "score": score})

    keys = ["query_block", "candidate_block", "dims"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
