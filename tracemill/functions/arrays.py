"""Constant arrays and search in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(values: Sequence[int], kind: str = "bigint") -> Column:
    """An array constant.  It goes to the JVM as one string and is folded there once,
    which for thousands of values is far quicker than a literal each."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def count_below(values: Sequence[int], x: Column, inclusive: bool) -> Column:
    """How many of the ascending ``values`` lie below ``x`` (or at it, if inclusive):
    a binary search as an expression, without join or Python."""
    n = len(values)
    table = constant(values)
    steps = [1 << i for i in range(max(1, n).bit_length() - 1, -1, -1)]

    def step(x, at, s):
        v = F.get(table, at + s - 1)
        inside = v <= x if inclusive else v < x
        return F.when((at + s <= n) & F.coalesce(inside, F.lit(False)), at + s).otherwise(at)

    # as an element, x is worked out once and not at each step
    search = lambda e: F.aggregate(constant(steps, "int"), F.lit(0), lambda at, s: step(e, at, s))
    return F.get(F.transform(F.array(x), search), F.lit(0))
