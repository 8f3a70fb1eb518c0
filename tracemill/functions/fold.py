"""Keyed state over sorted rows.

A stateful operator is one small class with a ``step`` method.  Rows are dealt out
by key, sorted by key and time, and streamed through it, so a task holds the state
of one key at a time and no group of rows: a key with very many rows costs time in
its task, not memory.  The streaming wrappers call the same classes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], make: Callable, outputs: str, active: str | None = None) -> DataFrame:
    """``df`` with the columns ``outputs`` (a DDL string).

    For each key ``make(*key)`` gives a state; for each of its rows in ``order``
    ``state.step(*inputs)`` gives the row's output tuple.  Rows whose boolean column
    ``active`` is not true pass by: they get nulls and leave the state alone.
    """
    added = StructType.fromDDL(outputs)
    names = df.columns
    schema = StructType([*df.schema.fields, *added.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        state = at = None
        for batch in batches:
            made: list[list] = [[] for _ in kinds]
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            rows = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            on = batch.column(active).to_pylist() if active else [True] * len(of)
            for key, row, steps in zip(of, rows, on, strict=True):
                if not steps:
                    for out in made:
                        out.append(None)
                    continue
                if state is None or key != at:
                    state, at = make(*key), key
                for out, value in zip(made, state.step(*row), strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], [*names, *added.names]
            )

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
