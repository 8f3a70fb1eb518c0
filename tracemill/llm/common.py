"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.functions.tables import discard, materialize, shared_dir

__all__ = ["SPACE_CLASS", "batch_rows", "discard", "materialize", "schema_with", "shared_dir", "table", "text_bytes"]

#: Word separators of the contracts: space and the ASCII controls 09-0D.  These
#: are exactly the bytes that ``bytes.split()`` splits on.
SPACE_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table; the path is opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, keep: Sequence[str], added: str) -> StructType:
    """Schema of the columns ``keep`` of ``df`` and those of the DDL string ``added``."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(added).fields])


def text_bytes(col: str = "text"):
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, ``rows`` rows go to Python at once: few where they hold texts, as both
    sides keep whole batches, more where they are numbers.  It holds for what is run
    inside, and for plans made inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
