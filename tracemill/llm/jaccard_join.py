"""N-gram Jaccard join: documents whose shingle sets are alike, and their components.

Documents with the same set of word shingles form one class, which from there on
stands for all of them.  Classes are joined by prefix filtering: shingles are put
in one global order, rare first (by a count sketch of fixed size over the whole
corpus, ties by hash; any order gives the same result), and two sets that are alike
enough share a shingle within their prefixes.  Length and positional filters are
applied at the shared shingle, a suffix filter (counts of both sets over the same
64 hash ranges bound their overlap) before sets are fetched, and each pair is
verified once on its whole sets.

Pairs inside a group that shares a shingle are never all made.  First every member
is compared with one pivot of its group and length band, and the verified links
give first components.  Then only members of different components still meet:
those outside a group's largest component against all others in it.  Pairs left out
are connected already, so the components are exact.  Components are found by
distributed label propagation with pointer jumping; nothing of a size that grows
with the corpus reaches the driver.

Defined results: null and empty texts, and texts without words, have an empty set,
are linked with nothing and are their own component; a text of fewer words than a
shingle has its whole word sequence as its one shingle; rows with one id are one
document in the components; a null id is never a component's name where another
member has one.  Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_rows, discard, materialize, text_bytes

#: Cells of the count sketch, bits of membership filters, hash ranges of the suffix filter,
#: each as a power of two.
SKETCH_BITS, FILTER_BITS, RANGE_BITS = 22, 26, 6
_BLOCK_BITS = 16
#: Bytes above which a word is hashed by its digest, so that blocks of a long text are bounded.
_LONG_WORD = 4096

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096) * 2, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _hash_block(block: bytes, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of words joined by single spaces."""
    a = np.frombuffer(block, dtype=np.uint8)
    cut = np.flatnonzero(a == 32)
    begin = np.concatenate(([0], cut + 1))
    end = np.append(cut, len(a))
    if len(begin) > k:
        begin, end = begin[: len(begin) - k + 1], end[k - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[a] * _power(_B, len(a)), dtype=np.uint64)))
    h = (sums[end] - sums[begin]) * _power(_B_INV, len(a) + 1)[begin]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    # one rule in texts of any size, so that a word counts alike wherever it stands
    if len(data) > _LONG_WORD and max(map(len, words)) > _LONG_WORD:
        words = [w if len(w) <= _LONG_WORD else b"\x00" + hashlib.blake2b(w, digest_size=24).digest().hex().encode() for w in words]
    block = b" ".join(words)
    if len(block) > 4_000_000:
        step = 200_000
        parts = [_hash_block(b" ".join(words[i : i + step + k - 1]), k) for i in range(0, max(1, len(words) - k + 1), step)]
        return np.unique(np.concatenate([np.unique(p) for p in parts]))
    return np.unique(_hash_block(block, k))


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts.astype(np.int64), 2**32 - 1).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint32)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """First pass.  ``kind`` 0: a document's ``id, n, c`` (set size and class) and its
    counts ``r`` over hash ranges; ``kind`` 1: block ``n`` of the task's count sketch."""

    def run(batches: Iterator[pa.RecordBatch]):
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        ranges = pa.list_(pa.int32())
        names = ["kind", "id", "row", "n", "c", "r", "block"]
        for batch in batches:
            n, c, r = [], [], []
            for value in batch.column("_tm_bytes"):
                s = shingle_set(value.as_py(), k)
                n.append(len(s))
                c.append(_class_of(s) if len(s) else 0)
                r.append(np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS).astype(np.int32))
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int8)), batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(r, ranges), pa.nulls(len(n), pa.binary())], names
            )
        for i in range(1 << SKETCH_BITS - _BLOCK_BITS):
            part = cells[i << _BLOCK_BITS : i + 1 << _BLOCK_BITS]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1], pa.int8()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, ranges), pa.array([_pack(part)], pa.binary())], names
                )

    return texts.mapInArrow(run, "kind tinyint, id long, row long, n long, c long, r array<int>, block binary")


def _sketch(first: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: blocks are added up where they are dealt to, and
    ``2**SKETCH_BITS`` counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("n").to_pylist(), batch.column("block"), strict=True):
                part = _unpack(data.as_py())
                total[i] = total[i] + part if i in total else part.astype(np.int64)
        for i, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([_pack(counts)], pa.binary())], ["n", "block"])

    got = first.filter("kind = 1").select("n", "block").repartition("n").mapInArrow(run, "n long, block binary").toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for i, data in zip(got.column("n").to_pylist(), got.column("block").to_pylist(), strict=True):
        sketch[i << _BLOCK_BITS : i + 1 << _BLOCK_BITS] = _unpack(data)
    return sketch


def _least(n: int | Column, num: int, den: int):
    """ceil(num * n / den) in integers."""
    return (n * num + den - 1) // den


def _prefixes(texts: DataFrame, sketch: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """Second pass: ``s, c, n, pos`` of each shingle in a class's prefix, rare first.

    A class seen before in the same task is left out; other copies do no harm."""
    # a fine logarithmic scale fits 16 bits, whose stable sort is linear
    rank = np.minimum(65_535, np.log2(sketch + np.float32(1)) * np.float32(2000)).astype(np.uint16)
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]):
        order_of = shared.value
        seen: set[int] = set()
        for batch in batches:
            s_all, c_all, n_all, size = [], [], [], []
            for value in batch.column("_tm_bytes"):
                s = shingle_set(value.as_py(), k)
                n = len(s)
                if not n:
                    continue
                c = _class_of(s)
                if c in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                # s is in order of hash, and the sort keeps that order among equals
                order = np.argsort(order_of[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                p = n - _least(n, num, den) + 1
                s_all.append(s[order[:p]])
                c_all.append(c)
                n_all.append(n)
                size.append(p)
            if size:
                size = np.array(size)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(s_all).view(np.int64)), pa.array(np.repeat(np.array(c_all, np.int64), size)), pa.array(np.repeat(np.array(n_all, np.int32), size)), pa.array(pos.astype(np.int32))],
                    ["s", "c", "n", "pos"],
                )

    return texts.select("_tm_bytes").mapInArrow(run, "s long, c long, n int, pos int")


def _viable(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Length and positional filter of two sets that share a shingle at these positions."""
    low, high = F.least(n1, n2).cast("long"), F.greatest(n1, n2).cast("long")
    bound = F.least(n1 - p1, n2 - p2).cast("long")
    return (low * den >= high * num) & (bound * (num + den) >= (n1.cast("long") + n2) * num)


def _most(n: Column, pos: Column, num: int, den: int) -> Column:
    """Size of the largest set that one of size ``n`` may link with, if its first shared
    shingle is at ``pos``.  Two rows pass :func:`_viable` exactly where neither set is
    larger than the other's row allows."""
    n = n.cast("long")
    return F.least(F.floor(n * den / F.lit(num)), F.floor((n - pos) * (num + den) / F.lit(num)) - n)


def _across(rest: DataFrame, num: int, den: int) -> DataFrame:
    """``c1, c``: viable pairs of rows ``s, c, n, l, most`` with one shingle and different
    components ``l``, one of which is not the group's largest.

    Rows meet by shingle and both sizes: which sizes of a group can meet is settled on
    one row a size, so only viable pairs are made, and no task holds a whole group."""
    largest = materialize(rest.groupBy("s", "l").count().groupBy("s").agg(F.max_by("l", F.struct("count", "l")).alias("big")), "largest")
    minor = materialize(rest.join(largest, "s").filter("l <> big").select("s", F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("l").alias("l1"), F.col("most").alias("most1")), "minor")
    mine = minor.groupBy("s", "n1").agg(F.max("most1").alias("_up1"))
    yours = rest.groupBy("s", "n").agg(F.max("most").alias("_up"))
    sizes = materialize(mine.join(yours, "s").filter("n <= _up1 and n1 <= _up").select("s", "n1", "n"), "sizes")
    a = minor.join(sizes, ["s", "n1"]).filter("n <= most1").select("s", "n1", "n", "c1", "l1")
    b = rest.join(sizes, ["s", "n"]).filter("n1 <= most").select("s", "n1", "n", "c", "l")
    a, b = materialize(a, "minor-sizes"), materialize(b, "rest-sizes")
    discard(largest, minor, sizes)
    return a.join(b, ["s", "n1", "n"]).filter("l1 <> l")


def _bits(cells: DataFrame) -> np.ndarray:
    """A membership filter of fixed size, of the hashes ``b``."""
    b = F.col("b").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = cells.select(b.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _among(bits: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter: all that are, and few others."""
    b = b & ((1 << FILTER_BITS) - 1)
    return (bits[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _shared(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of ``prefix`` whose shingle lies in the prefixes of several classes.

    Where just two rows meet, their pair is judged at once."""
    # size and what the set has left from the shingle on, as one number
    v = F.shiftleft(F.col("n").cast("long"), 32) + (F.col("n") - F.col("pos"))
    met = prefix.groupBy("s").agg(F.count("*").alias("k"), F.min("c").alias("_a"), F.max("c").alias("_b"), F.min(v).alias("_v"), F.max(v).alias("_w")).filter("_a < _b")
    n1, n2 = F.shiftright("_v", 32), F.shiftright("_w", 32)
    r1, r2 = F.col("_v").bitwiseAND(F.lit((1 << 32) - 1)), F.col("_w").bitwiseAND(F.lit((1 << 32) - 1))
    met = materialize(met.filter((F.col("k") > 2) | _viable(n1, n1 - r1, n2, n2 - r2, num, den)).select("s"), "met")
    shared = prefix.sparkSession.sparkContext.broadcast(_bits(met.select(F.col("s").alias("b"))))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(_among(shared.value, batch.column("s").to_numpy())))

    with batch_rows(prefix.sparkSession, 50_000):
        out = materialize(prefix.mapInArrow(run, prefix.schema).join(met, "s"), "shared")
    discard(met)
    return out


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


class _Verifier:
    """Verifies pairs of classes on the whole sets of one document each."""

    def __init__(self, texts: DataFrame, reps: DataFrame, k: int, num: int, den: int):
        self.texts, self.reps, self.k, self.num, self.den = texts, reps, k, num, den

    def links(self, pairs: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        r = self.reps.select("c", "n", "r")
        slim = pairs.join(r.toDF("x", "n1", "r1"), "x").join(r.toDF("y", "n2", "r2"), "y")
        # suffix filter: the sets share no more than the smaller count in each hash range
        most = F.aggregate(F.zip_with("r1", "r2", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda t, v: t + v)
        pairs = slim.filter(most * (num + den) >= (F.col("n1") + F.col("n2")) * num).select("x", "y", "n1", "n2")
        pairs = materialize(pairs, "pairs")
        sets = self._sets(pairs)
        both = pairs.join(sets.toDF("x", "s1"), "x").join(sets.toDF("y", "s2"), "y")
        shared = F.size(F.array_intersect("s1", "s2")).cast("long")
        out = materialize(both.filter(shared * (num + den) >= (F.col("n1") + F.col("n2")) * num).select("x", "y"), "links")
        discard(pairs, sets)
        return out

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """``c, s``: the sets of (at least) the classes in ``pairs``, from their first
        documents.  Texts pass a filter of fixed size; what it lets through wrongly, or
        twice, only repeats or misses in the join."""
        involved = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()
        wanted = involved.join(self.reps.select("c", "rep"), "c").filter("rep is not null")
        shared = pairs.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.xxhash64("rep").alias("b"))))
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                missing = batch.column("missing").to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(_among(shared.value, batch.column("b").to_numpy()) | missing)
                if len(hit):
                    got = [shingle_set(v.as_py(), k) for v in batch.column("_tm_bytes").take(pa.array(hit))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_class_of(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["c", "s"]
                    )

        # a class of documents without ids has no first one: they all pass
        given = self.texts.select(F.xxhash64("id").alias("b"), F.col("id").isNull().alias("missing"), "_tm_bytes")
        return materialize(given.mapInArrow(run, "c long, s array<long>"), "sets")


def components(links: DataFrame) -> DataFrame:
    """``c, label`` of every node of ``x, y``: the smallest node reachable."""
    edges = materialize(links.select(F.col("x").alias("u"), F.col("y").alias("v")).union(links.select("y", "x")).distinct(), "edges")
    labels = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("c"), "label"), "labels")
    before = labels
    while True:
        near = edges.join(labels, F.col("v") == F.col("c")).groupBy("u").agg(F.min("label").alias("_near"))
        lower = labels.join(near, F.col("c") == F.col("u")).select("c", F.col("label").alias("_old"), F.least("label", "_near").alias("_to"))
        # pointer jump: to the label that the label's own node had
        target = labels.select(F.col("c").alias("_to"), F.col("label").alias("_up"))
        moved = materialize(lower.join(target, "_to").select("c", "_old", F.least("_to", "_up").alias("label")), "labels")
        discard(before)
        before, labels = moved, moved.select("c", "label")
        if moved.filter(F.col("_old") != F.col("label")).isEmpty():
            discard(edges)
            return labels


def find(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id, n, c, component_id``, and ``row, label`` if ``row_col``
    numbers the rows (``label`` tells components apart, null for an empty set), of every row of ``docs``, and the
    verified pairs ``x, y`` of classes on which the components rest.

    ``id_col, text_col, shingle, num, den``: sets link where
    ``den * intersection >= num * union``.
    """
    with batch_rows(docs.sparkSession):
        return _find(docs, **options)


def _find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"), text_bytes(text_col).alias("_tm_bytes"))
    first = materialize(_sets(texts, shingle), "sets")
    members = first.filter("kind = 0")
    sketch = _sketch(first)
    reps = materialize(members.filter("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("r").alias("r")), "classes")

    whole = materialize(_prefixes(texts, sketch, shingle, num, den), "prefixes")
    prefix = _shared(whole, num, den)
    discard(whole)
    verifier = _Verifier(texts, reps, shingle, num, den)

    # each member against the pivot of its shingle and length band: the member with the
    # fewest rarer shingles of its own, which of edited copies is the least edited
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int") if num < den else F.col("n")
    banded = prefix.withColumn("band", band)
    # written, as are other sums below, so that a join is alone in its stage and a hot key can be split
    pivots = materialize(banded.groupBy("s", "band").agg(F.min(F.struct("pos", "n", "c")).alias("p")), "pivots")
    star = banded.join(pivots, ["s", "band"]).filter(F.col("c") != F.col("p.c"))
    star = star.filter(_viable(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), num, den)).withColumn("pc", F.col("p.c"))
    tried = materialize(_pairs(star, "c", "pc"), "star-pairs")
    links = verifier.links(tried)
    discard(pivots)

    # members of a shingle's group that lie in different components
    label = components(links).toDF("_c", "label")
    placed = prefix.join(label, F.col("c") == F.col("_c"), "left").select("s", "c", "n", "pos", F.coalesce("label", "c").alias("l"))
    placed = materialize(placed, "placed")
    discard(prefix)
    split = materialize(placed.groupBy("s").agg(F.min("l").alias("_a"), F.max("l").alias("_b")).filter("_a < _b").select("s"), "split-keys")
    rest = materialize(placed.join(split, "s").withColumn("most", _most(F.col("n"), F.col("pos"), num, den)), "split")
    discard(placed, split)
    cross = _across(rest, num, den)
    discard(rest)
    left = _pairs(cross, "c1", "c").join(tried, ["x", "y"], "left_anti")
    more = verifier.links(materialize(left, "cross-pairs"))
    links = links.union(more)

    label = components(links).toDF("_c", "label") if not more.isEmpty() else label
    placed = reps.select("c", "rep").join(label, F.col("c") == F.col("_c"), "left").select("c", "rep", F.coalesce("label", "c").alias("l"))
    placed = materialize(placed, "components")
    names = placed.groupBy("l").agg(F.min("rep").alias("component_id"))
    of = placed.join(names, "l").select(F.col("c").alias("_c"), "component_id", F.col("l").alias("label"))
    out = members.select("id", "row", "n", "c").join(of, (F.col("c") == F.col("_c")) & (F.col("n") > 0), "left")
    rows = ["row", "label"] if row_col else []
    return out.select("id", *rows, "n", "c", F.coalesce("component_id", F.when(F.col("n") == 0, F.col("id"))).alias("component_id")), links


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` at four words and a similarity of 0.85."""
    members, _ = find(docs, shingle=4, num=85, den=100)
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null last),
    then class, then place.  Rows are told apart by place, as ids may repeat or be null.

    The rows that go are broadcast only if they are at most ``max_broadcast``."""
    # columns go by place, so that names of any kind can't clash; the rows are written once,
    # so that a row has one number wherever it is read
    place = [f"_{i}" for i in range(len(docs.columns))]
    rows = materialize(docs.toDF(*place).withColumn("row", F.monotonically_increasing_id()), "rows")
    of = dict(zip(docs.columns, place, strict=True))
    members, _ = find(rows, id_col=of[id_col], text_col=of[text_col], row_col="row", **options)
    members = materialize(members.filter("label is not null"), "members")
    best = members.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "c", "row")).alias("b")).select(F.col("b.row").alias("row"))
    gone = materialize(members.join(best, "row", "left_anti").select("row"), "gone")
    hint: Callable[[DataFrame], DataFrame] = F.broadcast if gone.count() <= max_broadcast else (lambda d: d)
    return rows.join(hint(gone), "row", "left_anti").select(*place).toDF(*docs.columns)
