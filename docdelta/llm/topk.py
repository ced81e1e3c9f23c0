"""Exact top-k inner products with block-at-a-time pruning.

Vectors are put in the order of their nearest pivots, so that similar ones share blocks of document
ranges. A block keeps, for each dimension (the term of a sparse engine), the largest and the smallest
value; their products with a query's values, the larger of the two in each dimension, sum to a bound
that no vector of the block exceeds. For each query the blocks of a range are taken by falling bound and
scored through their forward index, the matrix of their rows, until the bound falls below the k-th
score. That is at least the k-th score among a bounded sample of vectors, from which every task starts,
and a task keeps what it has found from range to range. Ties go to the smaller id, so a block is skipped
only below the k-th score, not at it.

Queries go in groups of bounded bytes, a broadcast each, over the ranges, which are never shuffled for
it; a task hands on k rows a query. Bounds skip blocks where vectors form clusters. Vectors that point
evenly in all directions have bounds far above their scores, and then every block is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.llm.common import discard, quoted, small_batches, written

BLOCK = 64
#: Vectors of a range.
RANGE = 4096
#: Vectors of the sample that gives first thresholds, and those of them that are pivots of the order.
SEEDS, PIVOTS = 1024, 128
#: Bytes of the queries of a group, about.
GROUP_BYTES = 32 << 20
#: Ranges that a task takes at most.
TASK_RANGES = 64


def quantised(vectors: DataFrame, asked: Column, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, asked) with each component x as floor(1024 * x); only whole, finite vectors with an id."""
    x = F.col("v")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    out = vectors.select(quoted(id_col).cast("long").alias("vec_id"), F.transform(quoted(vector_col), lambda y: y.cast("double")).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    out = out.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return out.select("vec_id", F.transform(x, lambda y: F.floor(y * F.lit(1024.0)).cast("long")).alias("v"), "asked")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, shorter ones filled with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    width = width or max(1, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _clustered(pivots: np.ndarray):
    """Rows with the number of the nearest pivot in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            width = max(x.shape[1], pivots.shape[1])
            x, p = _wide(x, width).astype(float), _wide(pivots, width).astype(float)
            near = (2 * x @ p.T - (p * p).sum(1)).argmax(1) if len(p) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["cluster", *batch.schema.names])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of up to RANGE vectors (row, vec_id, v) each, in their order: rows, ids and values as bytes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        while (n := sum(len(x[0]) for x in held)) >= RANGE or (last and n):
            width = max(x[2].shape[1] for x in held)
            rows, ids, values = (np.concatenate(x) for x in ([y[0] for y in held], [y[1] for y in held], [_wide(y[2], width) for y in held]))
            columns = [pa.array([x[:RANGE].tobytes()], pa.binary()) for x in (rows, ids, values)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([width], pa.int32())], ["rows", "ids", "vectors", "width"])
            held = [(rows[RANGE:], ids[RANGE:], values[RANGE:])] if n > RANGE else []

    for batch in batches:
        held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), _matrix(batch.column(2))))
        yield from flush(False)
    yield from flush(True)


class Search:
    """The k best of each query among the ranges seen so far; rows are numbers of their own, ids may repeat."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, k: int, seed_rows: np.ndarray | None = None, seeds: np.ndarray | None = None):
        self.rows, self.queries, self.k = rows, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(rows)
        self.least = np.full(len(rows), np.iinfo(np.int64).min)
        self.blocks = self.skipped = 0
        if seeds is not None and len(seeds) > k:
            width = max(seeds.shape[1], queries.shape[1])
            s = _wide(seeds, width).T
            for i, q in enumerate(_wide(queries, width)):
                self.least[i] = np.partition((q @ s)[seed_rows != rows[i]], -k)[-k]

    def add(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """Goes through the blocks of a range for each query, by falling bound."""
        width, k = max(values.shape[1], self.queries.shape[1]), self.k
        values, queries = _wide(values, width), _wide(self.queries, width)
        starts = np.arange(0, len(ids), BLOCK)
        high, low = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
        for n, q in enumerate(queries):
            bounds = np.maximum(high * q, low * q).sum(1)
            best_ids, best = self.best[n]
            self.blocks += len(starts)
            for done, b in enumerate(np.argsort(-bounds, kind="stable")):
                if bounds[b] < self.least[n]:
                    self.skipped += len(starts) - done
                    break
                at = slice(starts[b], starts[b] + BLOCK)
                scores, own = values[at] @ q, ids[at]
                keep = (rows[at] != self.rows[n]) & (scores >= self.least[n])
                if not keep.any():
                    continue
                best_ids, best = np.concatenate((best_ids, own[keep])), np.concatenate((best, scores[keep]))
                order = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    self.least[n] = max(self.least[n], best[-1])
            self.best[n] = best_ids, best


def exact_topk(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest integer inner products of each row for which `asked` holds.

    Candidates are all rows but the query's own, so a row that repeats a query's id is a candidate, and a
    query of its own if `asked` holds for it. Vectors that are null, hold null, NaN or an infinity, or lack
    an id take no part; nor are queries rows for which `asked` is null. Shorter vectors count as filled with
    0. Ties go to smaller ids. Fewer than k candidates give fewer rows. Scores wrap beyond 64 bits. Other
    columns are not read but by `asked`.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(quantised(vectors, asked, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("v")).alias("width")).head()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SEEDS).select("row", "v").collect()
    seed_rows, width = np.array([x["row"] for x in sample], np.int64), max(1, size["width"] or 0)
    seeds = np.zeros((len(sample), width), np.int64)
    for i, x in enumerate(sample):
        seeds[i, : len(x["v"])] = x["v"]

    ranges = -(-size["n"] // RANGE)
    tasks = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-ranges // TASK_RANGES))
    near = rows.select("row", "vec_id", "v").mapInArrow(_clustered(seeds[:PIVOTS]), "cluster int, row long, vec_id long, v array<long>")
    near = near.repartitionByRange(tasks, "cluster", "row").sortWithinPartitions("cluster", "row").select("row", "vec_id", "v")
    packs = written(near.mapInArrow(_packed, "rows binary, ids binary, vectors binary, width int"), "ranges")

    groups = max(1, -(-size["asked"] * 8 * width // GROUP_BYTES))
    found: DataFrame | None = None
    for group in range(groups):
        own = rows.where("asked").where(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).select("row", "vec_id", "v").collect()
        queries = np.zeros((len(own), width), np.int64)
        for i, x in enumerate(own):
            queries[i, : len(x["v"])] = x["v"]
        shared = spark.sparkContext.broadcast((np.array([x["row"] for x in own], np.int64), [x["vec_id"] for x in own], queries, seed_rows, seeds))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_rows, query_ids, queries, seed_rows, seeds = shared.value
            at = Search(query_rows, queries, k, seed_rows, seeds)
            for batch in batches:
                for own_rows, ids, values, wide in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    at.add(np.frombuffer(own_rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(-1, wide))
            sizes = [len(x) for x, _ in at.best]
            columns = [np.repeat(query_rows, sizes), np.repeat(np.array(query_ids, np.int64), sizes), np.concatenate([np.empty(0, np.int64), *(x for x, _ in at.best)]), np.concatenate([np.empty(0, np.int64), *(x for _, x in at.best)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "query_id", "vec_id", "score"])

        one = written(packs.mapInArrow(search, "row long, query_id long, vec_id long, score long"), "found")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    discard(packs, rows)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
