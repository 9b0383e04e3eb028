"""Binary files: dense points, encoded corpora and model parameters; and synthetic data.

Reading goes through Spark's binaryFile source, so that any store Spark reads will do; use
many files of moderate size, or Parquet, for large data.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 65_536


def points_bytes(points: np.ndarray, version: int = 1) -> bytes:
    return struct.pack("<III", version, points.shape[1], len(points)) + np.ascontiguousarray(points, "<f8").tobytes()


def parse_points(data: bytes) -> np.ndarray:
    _, dim, n = struct.unpack("<III", data[:12])
    if len(data) < 12 + 8 * dim * n:
        raise ValueError("the file is shorter than its header says")
    return np.frombuffer(data, "<f8", dim * n, 12).reshape(n, dim)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, v; ids count within a file, file names order the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = parse_points(data)
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], names=["file", "id", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, id long, v array<double>")


def corpus_bytes(docs: list[np.ndarray]) -> bytes:
    return struct.pack("<iI", 2, len(docs)) + b"".join(struct.pack("<I", len(d)) + np.asarray(d, "<u4").tobytes() for d in docs)


def parse_corpus(data: bytes) -> list[np.ndarray]:
    version, n = struct.unpack("<iI", data[:8])
    if version != 2:
        raise ValueError(f"corpus version {version} is not 2")
    out, at = [], 8
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(np.frombuffer(data, "<u4", size, at + 4))
        at += 4 + 4 * size
    return out


def read_corpus_file(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs = parse_corpus(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs)), pa.array(range(len(docs)), pa.int64()), pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32()))], names=["file", "doc_id", "words"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, words array<int>")


def parameters_bytes(matrix: np.ndarray) -> bytes:
    """version, rows, columns, values: the layout of parameter files."""
    return struct.pack("<III", 1, *matrix.shape) + np.ascontiguousarray(matrix, "<f8").tobytes()


def synthetic_clusters(spark: SparkSession, n: int, dim: int, k: int, spread: float = 10.0, std: float = 1.0, seed: int = 3) -> DataFrame:
    """id, v, label: normals around k uniform means, generated where they are used."""
    means = np.random.default_rng(seed).uniform(-spread, spread, (k, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), ROWS):
                part = ids[at : at + ROWS]
                rng = np.random.default_rng([seed, int(part[0])])
                label = rng.integers(0, k, len(part))
                v = means[label] + std * rng.standard_normal((len(part), dim))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(v), pa.list_(pa.float64())), pa.array(label.astype(np.int32))], names=["id", "v", "label"])

    return spark.range(n).mapInArrow(run, "id long, v array<double>, label int").withColumn("id", F.col("id"))


def write_synthetic_packs(spark: SparkSession, path: str, n: int, dim: int, k: int, packs: int, std: float = 64.0, spread: float = 1000.0, seed: int = 3) -> None:
    """Synthetic points in so many files under path/points, with the means they were drawn around under path/truth."""
    synthetic_clusters(spark, n, dim, k, spread, std, seed).repartition(packs, "id").write.mode("overwrite").parquet(f"{path}/points")
    means = np.random.default_rng(seed).uniform(-spread, spread, (k, dim))
    spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(means)], "k int, v array<double>").write.mode("overwrite").parquet(f"{path}/truth")


def write_points(points: DataFrame, path: str, version: int = 1) -> None:
    """One binary file a partition, in a store that pyarrow can write; points(id, v) in the order of id within each."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(1).values).reshape(len(b), -1) for b in batches if len(b)]
        if parts:
            store, root = fs.FileSystem.from_uri(path)
            store.create_dir(root, recursive=True)
            name = f"{root}/part-{uuid.uuid4().hex}.dat"
            x = np.concatenate(parts)
            with store.open_output_stream(name) as out:
                out.write(points_bytes(x, version))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(x)], pa.int64())], names=["file", "n"])

    rows = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).sortWithinPartitions("id")
    rows.mapInArrow(run, "file string, n long").collect()  # one row a partition
