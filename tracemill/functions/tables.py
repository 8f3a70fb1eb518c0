"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (single-machine tests) a temporary folder
    is chosen, once a session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written within it, but for the ones to be kept, are deleted at its end."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that survives the loss of any executor, and
    lets two consumers share one evaluation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tracemill/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing will read them again,
    lazily either.  What is not such a table is left alone."""
    for df in tables:
        path = df.__dict__.pop("_written", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
