"""Positions in a global order without one task holding it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_position(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with 1-based positions in the order of (coarse, order).

    Rows are ranked inside their coarse cell; cells are counted and prefix-summed,
    which handles one row a cell.  Choose coarse columns whose cells stay small.
    """
    cells = [f"_cell{i}" for i in range(len(coarse))]
    df = df.withColumns(dict(zip(cells, coarse, strict=True)))
    before = W.orderBy(*cells).rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy(*cells).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy(*cells).orderBy(*order)
    return df.withColumn("_in", F.row_number().over(within)).join(starts, cells).withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop(*cells, "_in", "_start")
