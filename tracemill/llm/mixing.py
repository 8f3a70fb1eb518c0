"""Mixing sources to target weights.

Documents are drawn by Efraimidis-Spirakis sampling: each gets the exponential
key ``-ln(u) / weight`` with ``u`` hashed from its identifier, and the documents
with the smallest keys of a source win.  Keys are prefix-summed in order to the
source's token budget.  Whole epochs over a source precede the fractional draw,
which takes the documents whose midpoint lies inside the remaining budget, so
a source misses its target by at most half a document.

The order within a source is never held by one task: keys are mapped through their own
distribution (a mixture of exponentials, by the counts of weights) onto slots of equal
share, slots are summed, and only the rows of one slot of one source are sorted together.
So no slot of a source expects more than its share of all rows, whatever the weights, and
the number of slots grows with the rows.  The table of sums has one row a source and slot;
the water-filling of targets works on one row a source, in one task.

Defined results: null texts have size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 words; a null or non-positive
weight counts as 1; the key is drawn from the id and a hash of the text, so rows with one
id or none are drawn apart; ties in key go by id, size and place; an empty table gives an
empty result; columns of the documents that are named like those of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.common import SPACE_CLASS, materialize

#: Weights of the sources in order of code point, repeating; null comes last.
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def targets(per_source: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Water-filling: targets are proportional to weight but for those that reach
    ``cap`` times their source's size; the level is found from prefix sums in the
    order in which sources fill up.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = per_source.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fill = W.orderBy("_fill", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_fill", F.col("_cap") / F.col("_w")).withColumns({
        "_budget": F.lit(float(share)) * F.sum("source_size").over(whole),
        "_sum_w": F.sum("_w").over(whole),
        "_cap_before": F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)),
        "_w_before": F.coalesce(F.sum("_w").over(upto), F.lit(0.0)),
    })
    # the level if the sources before this one are full and the rest share: it rises
    # up to the first source that is not, and falls after it
    s = s.withColumn("_level", (F.col("_budget") - F.col("_cap_before")) / (F.col("_sum_w") - F.col("_w_before")))
    s = s.withColumn("_settled", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_settled") * F.col("_w"), F.col("_cap")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _slotted(base: DataFrame, slots: int, rows_per_slot: int) -> DataFrame:
    """``base`` with ``_slot``, the place of its ``_key`` in the distribution of all keys.

    Weights are counted in steps of a quarter of a power of two, of which there are 512 at
    most; a key's place only has to rise with the key, so the steps cost no exactness."""
    step = F.greatest(F.least(F.round(F.log2("_w") * 4), F.lit(255)), F.lit(-256)).cast("int")
    counts = base.groupBy(step.alias("k")).count().collect()
    n = max(1, sum(r["count"] for r in counts))
    slots = max(slots, -(-n // rows_per_slot))
    shares = F.array(*[F.struct(F.lit(r["count"] / n).alias("p"), F.lit(2.0 ** (r.k / 4)).alias("w")) for r in sorted(counts)] or [F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("w"))])
    place = F.aggregate(shares, F.lit(0.0), lambda t, x: t + x["p"] * (1.0 - F.exp(-x["w"] * F.col("_key"))))
    return base.withColumn("_slot", F.least(F.floor(place * slots), F.lit(slots - 1)).cast("int"))


def draw(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column, weight: Column,
    weights: Sequence[float] = SOURCE_WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17, mark: Column | None = None,
    slots: int = 1024, rows_per_slot: int = 100_000,
) -> DataFrame:
    """``_tm_row, id, source, size, source_size, target, epochs, taken`` of each row.

    ``size`` and ``weight`` are columns over ``docs``, ``mark`` tells rows of one id apart; rows
    keep a ``_tm_row`` they have.  Sizes are computed once and written to the shared folder;
    later steps read only identifiers and numbers.  There are at least ``slots`` slots.
    """
    w = F.when(weight.cast("double") > 0, weight.cast("double")).otherwise(F.lit(1.0))
    base = docs.select(
        F.col("_tm_row") if "_tm_row" in docs.columns else F.monotonically_increasing_id().alias("_tm_row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        size.cast("long").alias("size"), w.alias("_w"), (F.lit(0) if mark is None else mark).cast("long").alias("_mark"),
    )
    # 53 bits of the hash, moved off 0 and 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("_mark")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    base = materialize(base.withColumn("_key", -F.log(u) / F.col("_w")), "mix-keys")
    base = _slotted(base, slots, rows_per_slot)
    per_slot = base.groupBy("source", "_slot").agg(F.sum("size").alias("_slot_size"))
    goal = targets(per_slot.groupBy("source").agg(F.sum("_slot_size").alias("source_size")), weights, share, cap)
    before = W.partitionBy("source").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = per_slot.withColumn("_start", F.coalesce(F.sum("_slot_size").over(before), F.lit(0)))
    starts = starts.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source")))
    starts = starts.select(F.col("a.source").alias("_source"), F.col("a._slot").alias("_of_slot"), "_start", "source_size", "target")
    rows = base.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_of_slot")))
    within = W.partitionBy("source", "_slot").orderBy("_key", F.col("id").asc_nulls_last(), "size", "_mark", "_tm_row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    drawn = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2.0 < left)
    rows = rows.withColumn("copies", F.col("epochs") + drawn.cast("long"))
    return rows.select("_tm_row", "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def with_quality(docs: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """``docs`` with ``_tm_quality``: the weight of a document by its quality label,
    1 where there is none; of several labels of a document the best counts."""
    q = labels.groupBy(F.col("doc_id").alias("_tm_id")).agg(F.max("quality").alias("_tm_q"))
    out = docs.join(q, F.col("doc_id") == F.col("_tm_id"), "left")
    return out.withColumn("_tm_quality", F.when(F.col("_tm_q") > 0, good).when(F.col("_tm_q") <= 0, poor).otherwise(1.0)).drop("_tm_id", "_tm_q")


def _drawn(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    sized = docs.select(*keep, "doc_id", "source", word_count("text").alias("_tm_size"), F.xxhash64("text").alias("_tm_mark"))
    return draw(with_quality(sized, labels), size=F.col("_tm_size"), weight=F.col("_tm_quality"), mark=F.col("_tm_mark"))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` of every document."""
    return _drawn(docs, labels).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` with a row for each copy that is taken, and ``size, source_size,
    target, taken, copies`` of the document and the number ``copy``, from 1, of the row."""
    made = ["size", "source_size", "target", "taken", "copies"]
    columns = [c for c in docs.columns if c not in made and c != "copy"]
    # columns go by place, so that names of any kind can't clash; the rows are written once,
    # so that a row has one number wherever it is read
    place = [f"_{i}" for i in range(len(columns))]
    of = dict(zip(columns, place, strict=True))
    rows = materialize(docs.select(*columns).toDF(*place).withColumn("_tm_row", F.monotonically_increasing_id()), "mix-rows")
    named = rows.select("_tm_row", *[F.col(of[c]).alias(c) for c in ("doc_id", "source", "text")])
    taken = _drawn(named, labels, "_tm_row").filter("copies > 0").select("_tm_row", *made)
    out = rows.join(taken, "_tm_row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*place, *made, "copy").toDF(*columns, *made, "copy")
