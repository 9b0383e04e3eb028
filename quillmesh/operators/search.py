"""Exact metric search: nearest, k nearest, range and furthest, in blocks of matrices.

Both sides are packed into blocks of about BLOCK rows; every pair of blocks is one row of a
block join, answered by one matrix product, and each query keeps its best rows of a block.
Partial answers are merged per query. Nothing is broadcast or collected, memory per task is
two blocks, and the work spreads over all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec

BLOCK = 2048


def packed(points: DataFrame, id_col: str, v_col: str, n_blocks: int) -> DataFrame:
    rows = points.select(F.col(id_col).cast("long").alias("id"), vec.vector(v_col).alias("v"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    return rows.groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))


def _block_pairs(points: DataFrame, queries: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    n_points, n_queries = points.count(), queries.count()
    left = packed(queries, names[2], names[3], max(1, -(-n_queries // BLOCK))).select(F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
    right = packed(points, names[0], names[1], max(1, -(-n_points // BLOCK))).select("ids", "vs")
    return left.crossJoin(right)


def _sides(batch: pa.RecordBatch, i: int):
    q, p = np.asarray(batch.column(0)[i].values), np.asarray(batch.column(2)[i].values)
    return q, vec.matrix(batch.column(1)[i].values), p, vec.matrix(batch.column(3)[i].values)


def _best(k: int, furthest: bool, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, q, ids, p = _sides(batch, i)
                if q.shape[1] != p.shape[1]:
                    raise ValueError("queries and points differ in dimension")
                order = np.argsort(ids)
                ids, p = ids[order], p[order]
                d2 = vec.distances2(q, p)
                d2 = -d2 if furthest else d2
                if skip_self:
                    d2[qids[:, None] == ids[None, :]] = np.inf
                # some more than k, as the product rounds; exact distances decide
                take = min(len(ids), k + 8)
                near = np.argpartition(d2, take - 1, 1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(qids), 1))
                exact = np.sqrt(((q[:, None, :] - p[near]) ** 2).sum(2))
                usable = np.isfinite(np.take_along_axis(d2, near, 1))
                rank = np.lexsort((ids[near], np.where(usable, -exact if furthest else exact, np.inf)), axis=1)[:, :k]
                keep = np.take_along_axis(usable, rank, 1)
                at, who = np.take_along_axis(exact, rank, 1), np.take_along_axis(ids[near], rank, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, rank.shape[1])[keep.ravel()]), pa.array(who[keep]), pa.array(at[keep])], names=["qid", "id", "dist"])

    return run


def k_nearest(points: DataFrame, queries: DataFrame, k: int = 10, *, columns=("id", "v", "qid", "qv"), skip_self: bool = False, furthest: bool = False) -> DataFrame:
    """qid, rank, id, dist: the k nearest (or furthest) points, ties by id; fewer if k > N."""
    pairs = _block_pairs(points, queries, columns)
    best = pairs.mapInArrow(_best(k, furthest, skip_self), "qid long, id long, dist double")
    order = Window.partitionBy("qid").orderBy(F.col("dist").desc() if furthest else F.col("dist"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def nearest(points: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return k_nearest(points, queries, 1, **options)


def furthest(points: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return k_nearest(points, queries, 1, furthest=True, **options)


def _within(radius: float, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, q, ids, p = _sides(batch, i)
                for at in range(0, len(qids), 256):
                    d2 = vec.distances2(q[at : at + 256], p)
                    a, b = np.nonzero(d2 < radius * radius * (1 + 1e-9) + 1e-9)
                    dist = np.sqrt(((q[at : at + 256][a] - p[b]) ** 2).sum(1))
                    keep = dist < radius
                    if skip_self:
                        keep &= qids[at + a] != ids[b]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at + a][keep]), pa.array(ids[b][keep]), pa.array(dist[keep])], names=["qid", "id", "dist"])

    return run


def range_search(points: DataFrame, queries: DataFrame, r: float = 1.0, *, columns=("id", "v", "qid", "qv"), skip_self: bool = False) -> DataFrame:
    """qid, id, dist of all points strictly nearer than r."""
    return _block_pairs(points, queries, columns).mapInArrow(_within(r, skip_self), "qid long, id long, dist double")


def with_points(found: DataFrame, points: DataFrame) -> DataFrame:
    """Search results with the vectors of the points found."""
    return found.join(points.select("id", "v"), "id")
