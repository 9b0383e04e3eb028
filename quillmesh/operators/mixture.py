"""k-means and diagonal Gaussian mixtures.

Every iteration is one pass: parameters (K x D numbers, documented to fit the driver) are
broadcast, each Arrow batch is assigned by a matrix product, and per-partition sufficient
statistics, K rows each, are merged by a partial and a final sum.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rng import uniform_np
from .seeds import seed_centers

KAPPA0, NU0, SIGMA0, ALPHA = 0.0001, 3.0, 0.001, 1.0


def as_points(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("long").alias("id"), vec.vector("v").alias("v"))


def _stats(assign, second: bool):
    """assign(ids, x) -> (n, K) responsibilities or (n,) labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s1 = s2 = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vec.matrix(batch.column(1))
            r = assign(batch.column(0).to_numpy(), x)
            part = r.sum(0), r.T @ x, r.T @ (x * x) if second else np.zeros((r.shape[1], 0))
            n, s1, s2 = part if n is None else (n + part[0], s1 + part[1], s2 + part[2])
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(list(s1)), pa.array(list(s2), pa.list_(pa.float64()))], names=["k", "n", "s1", "s2"])

    return run


def sufficient_statistics(points: DataFrame, assign, k: int, dim: int, second: bool = False):
    parts = points.mapInArrow(_stats(assign, second), "k int, n double, s1 array<double>, s2 array<double>")
    sums = lambda c, size: F.array(*[F.sum(F.col(c)[i]) for i in range(size)]).alias(c)
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), sums("s1", dim), *([sums("s2", dim)] if second else [])).collect()
    n, s1, s2 = np.zeros(k), np.zeros((k, dim)), np.zeros((k, dim))
    for r in rows:
        n[r["k"]], s1[r["k"]] = r["n"], r["s1"]
        if second:
            s2[r["k"]] = r["s2"]
    return n, s1, s2


def one_hot(labels: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(labels), k))
    out[np.arange(len(labels)), labels] = 1
    return out


def _per_row(function, fields: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in function(vec.matrix(batch.column(1)))]], names=["id", *names])

    return lambda points: as_points(points).mapInArrow(run, f"id long, {fields}")


class _Saved:
    def to_bytes(self) -> bytes:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}).encode()

    @classmethod
    def from_bytes(cls, data: bytes):
        model = cls.__new__(cls)
        model.__dict__.update({k: np.array(v) if isinstance(v, list) else v for k, v in json.loads(data).items()})
        return model

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_bytes(),)], "model binary").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        return cls.from_bytes(bytes(spark.read.parquet(path).first()["model"]))

    def _run(self, points: DataFrame, valid: DataFrame | None, snapshot: str | None, every: int) -> float | None:
        """All iterations; at every snapshot also path-history with step, seconds since the start and the score."""
        points, began, history = as_points(points).persist(), time.time(), []
        for step in range(1, self.iters + 1):
            self.step(points)
            if snapshot and (step == self.iters or step % every == 0):
                self.save(points.sparkSession, f"{snapshot}-{step}")
                seconds = time.time() - began
                history.append((step, seconds, float(self.evaluate(valid)) if valid is not None else None))
                points.sparkSession.createDataFrame(history, "step int, seconds double, score double").coalesce(1).write.mode("overwrite").parquet(f"{snapshot}-history")
        points.unpersist()
        return self.evaluate(valid) if valid is not None else None


class KMeans(_Saved):
    """Lloyd's algorithm with a weak pull to the origin; empty='zero' or 'keep'."""

    def __init__(self, k: int, iters: int = 10, init="firstk", points: DataFrame | None = None, seed: int = 0, empty: str = "zero"):
        self.k, self.iters, self.seed, self.empty = k, iters, seed, empty
        self.centers = seed_centers(as_points(points), k, init, seed) if isinstance(init, str) else np.asarray(init, float)
        self.k = len(self.centers)

    def _labels(self):
        centers = self.centers
        return lambda x: vec.distances2(x, centers).argmin(1)

    def step(self, points: DataFrame) -> None:
        labels, k = self._labels(), self.k
        n, s1, _ = sufficient_statistics(points, lambda _, x: one_hot(labels(x), k), k, self.centers.shape[1])
        new = s1 / (n + KAPPA0)[:, None]
        self.centers = np.where((n == 0)[:, None], self.centers, new) if self.empty == "keep" else new

    def fit(self, points: DataFrame, valid: DataFrame | None = None, snapshot: str | None = None, every: int = 200) -> float | None:
        return self._run(points, valid, snapshot, every)

    def predict(self, points: DataFrame) -> DataFrame:
        labels = self._labels()
        return _per_row(lambda x: [labels(x).astype(np.int32)], "k int", ["k"])(points)

    def evaluate(self, points: DataFrame) -> float:
        """Minus the sum of squared distances to the nearest centre."""
        centers = self.centers
        score = _per_row(lambda x: [((x - centers[vec.distances2(x, centers).argmin(1)]) ** 2).sum(1)], "d2 double", ["d2"])(points)
        return -float(score.agg(F.sum("d2")).first()[0] or 0.0)

    def get_centers(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centers)], "k int, v array<double>")


class GMM(_Saved):
    """Diagonal mixture; mode 'sampled' (stochastic EM), 'map' (hard) or 'soft'."""

    def __init__(self, k: int, iters: int = 10, init="firstk", points: DataFrame | None = None, variances=None, mode: str = "sampled", seed: int = 0):
        self.iters, self.mode, self.seed, self.iteration = iters, mode, seed, 0
        pts = as_points(points) if points is not None else None
        self.means = seed_centers(pts, k, init, seed) if isinstance(init, str) else np.asarray(init, float)
        self.k, dim = self.means.shape
        if variances is None:
            row = pts.select(*[F.var_pop(F.col("v")[i]) for i in range(dim)]).first()
            variances = np.array(row)
        self.precision = np.broadcast_to(0.5 / np.asarray(variances, float), self.means.shape).copy()
        self.log_pi = np.full(self.k, -np.log(self.k))

    def _scores(self):
        means, prec, log_pi = self.means, self.precision, self.log_pi
        const = 0.5 * np.log(prec).sum(1) - (prec * means * means).sum(1) + log_pi
        return lambda x: const - (x * x) @ prec.T + 2 * x @ (prec * means).T

    def step(self, points: DataFrame) -> None:
        scores, k, mode, seed, step = self._scores(), self.k, self.mode, self.seed, self.iteration

        def assign(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
            s = scores(x)
            if mode == "map":
                return one_hot(s.argmax(1), k)
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            if mode == "soft":
                return p
            u = uniform_np(seed, step, ids, np.zeros(len(ids), np.int64))
            return one_hot(np.minimum((np.cumsum(p, 1) < u[:, None]).sum(1), k - 1), k)

        n, s1, s2 = sufficient_statistics(points, assign, k, self.means.shape[1], True)
        self.means = s1 / (n + KAPPA0)[:, None]
        var = (s2 - (n + KAPPA0)[:, None] * self.means**2 + NU0 * SIGMA0) / (3 + NU0 + n)[:, None]
        self.precision = 0.5 / var
        self.log_pi = np.log(n + ALPHA) - np.log(n.sum() + k * ALPHA)
        self.iteration += 1

    def fit(self, points: DataFrame, valid: DataFrame | None = None, snapshot: str | None = None, every: int = 200) -> float | None:
        return self._run(points, valid, snapshot, every)

    def predict(self, points: DataFrame) -> DataFrame:
        scores = self._scores()
        return _per_row(lambda x: [scores(x).argmax(1).astype(np.int32)], "k int", ["k"])(points)

    def evaluate(self, points: DataFrame, score: str = "max") -> float:
        """Mean log score: of the best component ('max') or of the mixture ('logsumexp')."""
        scores, dim = self._scores(), self.means.shape[1]

        def value(x: np.ndarray) -> list[np.ndarray]:
            s = scores(x)
            top = s.max(1)
            return [top if score == "max" else top + np.log(np.exp(s - top[:, None]).sum(1))]

        return float(_per_row(value, "s double", ["s"])(points).agg(F.avg("s")).first()[0]) - 0.5 * dim * np.log(np.pi)

    def get_centers(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m.tolist(), (0.5 / p).tolist(), float(w)) for i, (m, p, w) in enumerate(zip(self.means, self.precision, self.log_pi, strict=True))]
        return spark.createDataFrame(rows, "k int, v array<double>, var array<double>, log_pi double")
