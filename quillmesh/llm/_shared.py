"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folder inside the shared one that a running stage keeps its tables in.
_INNER: ContextVar[str] = ContextVar("inner", default="")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (local
    tests) a temporary folder is made and remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("quillmesh.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("quillmesh.scratch.dir", base)
    return "/".join([base.rstrip("/"), spark.sparkContext.applicationId, *filter(None, [_INNER.get()])])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store it is."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def own_folder(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end; what is to stay is materialized to a folder named before."""
    token = _INNER.set(uuid.uuid4().hex)
    folder = shared_dir(spark)
    try:
        yield
    finally:
        _INNER.reset(token)
        delete(spark, folder)


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Hand memory that a Python worker no longer needs back to the system: idle workers live on in later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row: a lambda variable cannot be inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(docs: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
