"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a maximal run of characters other than line feeds.  It is hashed
to a wide vector: four identity lanes (two 64-bit hashes of the paragraph, cut in
halves), a count lane, and sign lanes, each the number of the paragraph's word
pairs whose hash has a given bit.  A document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two, so it does not depend on their order and
paragraphs can be added to it and taken away (:func:`combine`).  Equal identity
lanes mean equal multisets; the sign lanes, read as +1/-1, are a random projection
of the multiset of word pairs, whose correlation is the likeness of two documents.

Everything runs as DataFrame expressions.  Rows are dealt into buckets of
consecutive ids with native binary search in at most ``max_buckets`` bounds; each
bucket gets a copy of the next one's first row, so the following document is found
inside the bucket and texts are shuffled once.

Defined results: null texts are empty; an empty text has all lanes 0; two texts
without lanes are alike (1.0); rows with a null id come last, in order of text hash,
and rows with one id in order of text hash; the last row is followed by the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.arrays import constant, count_below
from tracemill.llm.common import materialize

#: Sums kept a text; each holds two sign lanes, at bits 0 and 31.
SIGN_SUMS = 24
_BITS = 31
_MASK = 1 | 1 << _BITS
_LOW = (1 << 32) - 1
#: Modulus (as a power of two) of identity and count lanes, and of sign lanes.
ID_POWER, SIGN_POWER = 32, 24


def _elements(texts: DataFrame, text: str) -> DataFrame:
    """One row a word pair: ``_h`` its hash; ``_p1, _p2`` the paragraph's hashes on
    its first pair, else null.  A text without paragraphs gives one row of nulls."""
    kept = [c for c in texts.columns if c != text]
    paragraphs = F.filter(F.split(F.col(text), "\n+"), lambda p: p != "")
    out = texts.select(*kept, F.explode_outer(paragraphs).alias("_p"))
    out = out.withColumn("_w", F.transform(F.split("_p", "[\\x20\\t]+"), lambda w: F.xxhash64(w)))
    # each word with the one after it; the last with none
    pairs = F.expr("zip_with(_w, slice(_w, 2, greatest(size(_w) - 1, 0)), (a, b) -> xxhash64(a, b))")
    out = out.select(*kept, F.xxhash64("_p").alias("_h1"), F.xxhash64(F.lit(1), "_p").alias("_h2"), F.col("_p").isNotNull().alias("_is"), F.posexplode_outer(pairs).alias("_i", "_h"))
    first = F.col("_is") & (F.col("_i") == 0)
    return out.select(*kept, F.when(first, F.col("_h1")).alias("_p1"), F.when(first, F.col("_h2")).alias("_p2"), "_h")


def lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``lanes array<long>`` of each group of texts (one a group, usually)."""
    e = _elements(texts.select(*keys, text), text)
    ids = [F.sum(f(F.col(p))) for p in ("_p1", "_p2") for f in (lambda c: c.bitwiseAND(F.lit(_LOW)), lambda c: F.shiftrightunsigned(c, 32))]
    sums = [F.sum(F.shiftright("_h", j).bitwiseAND(F.lit(_MASK))) for j in range(SIGN_SUMS)]
    got = e.groupBy(*keys).agg(
        *[x.alias(f"_id{i}") for i, x in enumerate(ids)], F.count("_h").alias("_n"), *[x.alias(f"_s{j}") for j, x in enumerate(sums)]
    )

    def part(c: str, power: int, shift: int = 0) -> Column:
        x = F.coalesce(F.col(c), F.lit(0).cast("long"))
        x = F.shiftrightunsigned(x, shift) if shift else x.bitwiseAND(F.lit((1 << _BITS) - 1)) if c.startswith("_s") else x
        return x.bitwiseAND(F.lit((1 << power) - 1))

    cells = [part(f"_id{i}", ID_POWER) for i in range(4)] + [part("_n", ID_POWER)]
    cells += [part(f"_s{j}", SIGN_POWER, shift) for j in range(SIGN_SUMS) for shift in (0, _BITS)]
    return got.select(*keys, F.array(*cells).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets (``sign=1``), or of ``a`` without ``b`` (-1)."""
    def mod(i):
        return F.when(i < 5, F.lit(1 << ID_POWER)).otherwise(F.lit(1 << SIGN_POWER))

    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.pmod(x["a"] + sign * x["b"], mod(i)))


def as_text(lanes_col: str) -> Column:
    """Lower-case hex of all lanes."""
    width = [ID_POWER // 4] * 5 + [SIGN_POWER // 4] * (2 * SIGN_SUMS)
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(lanes_col)[i])), w, "0") for i, w in enumerate(width)])


def likeness(a: str, b: str) -> Column:
    """0 to 1: correlation of the sign lanes of two fingerprints, 1 if they are equal."""
    # a lane counts ones among n pairs: as +1/-1 it is 2 * ones - n
    sides = F.transform(
        F.slice(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), 6, 2 * SIGN_SUMS),
        lambda x: F.struct((2 * x["a"] - F.col(a)[4]).cast("double").alias("x"), (2 * x["b"] - F.col(b)[4]).cast("double").alias("y")),
    )
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))
    dot = F.aggregate(sides, zero, lambda s, v: F.struct((s["xy"] + v["x"] * v["y"]).alias("xy"), (s["xx"] + v["x"] * v["x"] + v["y"] * v["y"]).alias("xx")))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot["xy"] / F.nullif(dot["xx"], F.lit(0.0))))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def _bucket(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the id, by binary search; null ids come after all."""
    found = count_below(bounds, id_col, inclusive=True)
    return F.when(id_col.isNull(), F.lit(len(bounds) + 1)).otherwise(found)


def in_order(docs: DataFrame, *, per_bucket: int = 256, max_buckets: int = 16_384) -> DataFrame:
    """``doc_id, _t, _next, _b, _r, _nb, _nr``: each row with the text of the next one
    in order of id, its place (bucket, rank) and the next one's place."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    ids = base.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    buckets = min(max_buckets, math.ceil(n / per_bucket))
    bounds: list[int] = []
    if buckets > 1:
        cuts = [i / buckets for i in range(1, buckets)]
        got = ids.agg(F.percentile_approx("doc_id", cuts, max(10_000, 8 * buckets)).alias("c")).first().c
        bounds = sorted(set(got or []))
    place = _bucket(F.col("doc_id").cast("long"), bounds)
    # at most one row a bucket: the smallest id there
    firsts = sorted(ids.groupBy(place.alias("b")).agg(F.min("doc_id").alias("i")).collect())
    rows = base.select("doc_id", "_t", place.alias("_b"), F.lit(0).alias("_copy"))
    order = [F.col("_copy"), F.col("doc_id").asc_nulls_last(), F.xxhash64("_t")]
    if firsts:
        spark = docs.sparkSession
        following = [(int(b), r.i, int(firsts[k - 1].b)) for k, r in enumerate(firsts) for b in [r.b]]
        heads = spark.createDataFrame(following, "_of int, _first long, _to int")
        lead = rows.join(F.broadcast(heads), (F.col("_b") == F.col("_of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_first")))
        lead = lead.groupBy("_of", "_to", "doc_id").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
        rows = rows.unionByName(lead.select("doc_id", "_t", F.col("_to").alias("_b"), F.lit(1).alias("_copy")))
        # the bucket after each one, as a constant array by bucket number
        onward = {to: of for of, _, to in following}
        nb = F.get(constant([onward.get(b, 0) for b in range(len(bounds) + 2)], "int"), F.col("_b"))
    else:
        nb = F.lit(0)
    w = W.partitionBy("_b").orderBy(*order)
    rows = rows.select(
        "doc_id", "_t", "_b", "_copy", F.lead("_t").over(w).alias("_next"), F.lead("_copy").over(w).alias("_last"), F.row_number().over(w).alias("_r")
    ).filter(F.col("_copy") == 0)
    last = F.col("_last") == 1
    return rows.select(
        "doc_id", "_t", "_next", "_b", "_r", F.when(last, nb).otherwise(F.col("_b")).alias("_nb"), F.when(last, F.lit(1)).otherwise(F.col("_r") + 1).alias("_nr")
    )


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of every document."""
    rows = in_order(docs)
    n = F.length("_t")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "_e": F.concat(F.expr("left(_t, length(_t) - cast(floor(length(_t) / 4) as int))"), F.left("_next", k))})
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_e").cast("binary"), 256))
    meta = ["doc_id", "_b", "_r", "_nb", "_nr", "n_chars", "edited_sha256"]
    both = rows.select(*meta, F.posexplode(F.array("_t", "_e")).alias("_which", "_text"))
    made = materialize(lanes(both, [*meta, "_which"], "_text"), "fingerprints")
    own = made.filter("_which = 0").withColumnRenamed("lanes", "_own").drop("_which")
    edited = made.filter("_which = 1").select("_b", "_r", F.col("lanes").alias("_edited"))
    after = made.filter("_which = 0").select(F.col("_b").alias("_nb"), F.col("_r").alias("_nr"), F.col("lanes").alias("_after"))
    out = own.join(edited, ["_b", "_r"]).join(after, ["_nb", "_nr"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_edited").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"), likeness("_own", "_after").alias("near_next"),
    )


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lanes, fingerprint`` of every document, without its neighbours."""
    keyed = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    got = lanes(keyed, [id_col, "_row"], "_t")
    return got.select(id_col, "lanes", as_text("lanes").alias("fingerprint"))
