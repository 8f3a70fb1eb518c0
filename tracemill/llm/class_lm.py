"""Brown class-based bigram language model.

Words are counted over all training texts.  Exchange clustering of the ``n_words``
commonest words and of ``n_groups`` groups of the others (by their last three bytes)
gives the first classes: items move between ``n_classes`` classes while the likelihood
of the class bigrams of the whole training corpus rises.  Then, in rounds, words of the
training texts are counted with the classes before and after them, in a table that stays
distributed, and go to the class that makes their own contexts likeliest: the common ones
in every round, as their classes are what the next one sees beside a word, and all words in
the last.  A word's group decides, as a few tokens besides, for one hardly ever seen; its
class stands for a rare word beside others, and for a word never seen.  The probability of a word is the smoothed
transition between classes times its emission from its class, with absolute
discounting that leaves mass for words never seen.

What is broadcast is bounded: a matrix of class transitions, and the counts and classes
of at most ``n_head`` common words of at most ``max_bytes`` bytes.  The other words of each document are joined with
the table of counts and classes; common words, being broadcast, cannot make that join
uneven.

Defined results: null and empty texts have one token, the end; a null id counts as
the empty text where the held-out rows are chosen; without training tokens the
score is the base score; repeated rows are each counted and scored; words of any
length are counted whole; ties between classes go to the lower number; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_rows, discard, materialize, schema_with, text_bytes

#: Stands for the end of a text; it holds a separator, so it is no word.
END = b"\n"


def words_of(data: bytes) -> list[bytes]:
    """Words of a text with ASCII letters in lower case."""
    return data.lower().split()


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def group_of(word: bytes, n_groups: int) -> int:
    return zlib.crc32(word[-3:]) % n_groups


def count_words(texts: DataFrame, col: str = "_tm_bytes", flush: int = 400_000) -> DataFrame:
    """``word binary, c long`` over all texts; each task counts before it shuffles."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for value in batch.column(0):
                seen.update(words_of(value.as_py()))
                seen[END] += 1
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.select(col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _encode(texts: DataFrame, head: dict[bytes, int], n_groups: int) -> DataFrame:
    """The texts' words, each text finished by END, as ``codes``: the place of a common
    word in ``head``, or ``-1 - i`` for the i-th of the text's other words, ``_tail``, whose
    groups are ``_groups``."""
    shared = texts.sparkSession.sparkContext.broadcast(head)
    names = [c for c in texts.columns if c != "_tm_bytes"]

    def run(batches):
        get, end = shared.value.get, shared.value[END]
        for batch in batches:
            codes, tails, groups = [], [], []
            for value in batch.column("_tm_bytes"):
                words, tail = words_of(value.as_py()), {}
                ids = np.empty(len(words) + 1, dtype=np.int32)
                ids[:-1] = np.fromiter((x if (x := get(w)) is not None else -1 - tail.setdefault(w, len(tail)) for w in words), np.int32, len(words))
                ids[-1] = end
                codes.append(ids.tobytes())
                tails.append(list(tail))
                groups.append(np.array([group_of(w, n_groups) for w in tail], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(codes, pa.binary()), pa.array(tails, pa.list_(pa.binary())), pa.array(groups, pa.binary())], [*names, "codes", "_tail", "_groups"]
            )

    return texts.mapInArrow(run, schema_with(texts, names, "codes binary, _tail array<binary>, _groups binary"))


def _encoded_texts(batch):
    """(codes, groups of the other words) of each text of a batch of :func:`_encode`."""
    for codes, groups in zip(batch.column("codes").to_pylist(), batch.column("_groups").to_pylist(), strict=True):
        yield np.frombuffer(codes, dtype=np.int32), np.frombuffer(groups, dtype=np.int32)


def count_bigrams(encoded: DataFrame, item_of: np.ndarray, end: int, n_words: int, n_groups: int) -> np.ndarray:
    """Matrix of item bigrams of all texts; a text begins and finishes with END."""
    n = n_words + n_groups
    shared = encoded.sparkSession.sparkContext.broadcast(item_of)

    def run(batches):
        total = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for codes, groups in _encoded_texts(batch):
                a = np.full(len(codes) + 1, shared.value[end], dtype=np.int64)
                a[1:] = _looked_up(codes, shared.value, n_words + groups)
                pairs = a[:-1] * n + a[1:]
                if len(pairs) > 50_000:
                    total += np.bincount(pairs, minlength=n * n)
                else:
                    np.add.at(total, pairs, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 500_000):
            part = at[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["pair", "c"])

    got = encoded.select("codes", "_groups").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    matrix = np.zeros(n * n, dtype=np.float64)
    matrix[got.column("pair").to_numpy()] = got.column("c").to_numpy()
    return matrix.reshape(n, n)


def _looked_up(codes: np.ndarray, of_head: np.ndarray, of_tail) -> np.ndarray:
    """What belongs to each code: from ``of_head``, or of the text's own other words."""
    out = of_head[np.maximum(codes, 0)]
    if len(of_tail):
        rare = np.flatnonzero(codes < 0)
        out[rare] = np.asarray(of_tail, dtype=out.dtype)[-1 - codes[rare]]
    return out


#: A context of a word: the class after it, or ``n_classes`` plus the class before it.
_CTX = np.dtype([("slot", "<u2"), ("n", "<u4")])


def _resolve(encoded: DataFrame, words: DataFrame) -> DataFrame:
    """``encoded`` with ``_seen``: place, count and class of its other words in ``words``."""
    tail = encoded.select("_row", F.posexplode("_tail").alias("i", "w"))
    tail = tail.join(words, F.col("w") == F.col("word")).groupBy("_row").agg(F.collect_list(F.struct("i", "c", "k")).alias("_seen"))
    return encoded.drop("_tail").join(tail, "_row", "left")


def _tail_known(batch, group_class: np.ndarray):
    """(codes, counts and classes of the other words) of each text of a batch; a word never
    counted has count 0 and the class of its group."""
    seen = None
    if "_seen" in batch.schema.names:
        column = batch.column("_seen")
        flat = column.flatten()
        seen = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("i", "c", "k")]
        stop = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    for row, (codes, groups) in enumerate(_encoded_texts(batch)):
        c, k = np.zeros(len(groups), dtype=np.int64), group_class[groups]
        if seen is not None:
            own = slice(stop[row - 1] if row else 0, stop[row])
            c[seen[0][own]], k[seen[0][own]] = seen[1][own], seen[2][own]
        yield codes, c, k


def _contexts(encoded: DataFrame, head: list[bytes], head_class: np.ndarray, group_class: np.ndarray, n_classes: int, only_head: bool, flush: int = 4_000_000) -> DataFrame:
    """Word x class counts: ``word, ctx`` with the packed contexts of a word (of ``head``, or
    any) in part of the texts, and ``pair, n``, the class bigrams, where the word is null."""
    shared = encoded.sparkSession.sparkContext.broadcast((head, head_class, group_class))
    slots = 2 * n_classes

    def run(batches):
        words, of_head, of_group = shared.value
        end = words.index(END)
        pair = np.zeros(n_classes * n_classes, dtype=np.int64)
        more: dict[bytes, int] = {}
        keys, held = [], 0

        def out():
            u, n = np.unique(np.concatenate(keys), return_counts=True)
            packed = np.empty(len(u), dtype=_CTX)
            packed["slot"], packed["n"] = u % slots, n
            u //= slots
            begin = np.flatnonzero(np.diff(u, prepend=-1))
            names, stop = list(more), np.append(begin[1:], len(u))
            for i in range(0, len(begin), 20_000):
                part = u[begin[i : i + 20_000]].tolist()
                ctx = [packed[x:y].tobytes() for x, y in zip(begin[i : i + 20_000].tolist(), stop[i : i + 20_000].tolist(), strict=True)]
                word = [words[x] if x < len(words) else names[x - len(words)] for x in part]
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(ctx, pa.binary()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64())], ["word", "ctx", "pair", "n"])

        for batch in batches:
            tails = [()] * len(batch) if only_head else batch.column("_tail").to_pylist()
            for tail, (codes, _, k) in zip(tails, _tail_known(batch, of_group), strict=True):
                cls = np.empty(len(codes) + 1, dtype=np.int64)
                cls[0], cls[1:] = of_head[end], _looked_up(codes, of_head, k)
                word = np.empty(len(codes) + 1, dtype=np.int64)
                word[0], word[1:] = end, codes
                if tail:
                    rare = np.flatnonzero(word < 0)
                    word[rare] = np.array([len(words) + more.setdefault(w, len(more)) for w in tail])[-1 - word[rare]]
                made = np.concatenate((word[:-1] * slots + cls[1:], word[1:] * slots + n_classes + cls[:-1]))
                keys.append(made[made >= 0])
                np.add.at(pair, cls[:-1] * n_classes + cls[1:], 1)
                held += len(keys[-1])
                if held > flush:
                    yield from out()
                    more, keys, held = {}, [], 0
        if keys:
            yield from out()
        at = np.flatnonzero(pair)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(pair[at], pa.int64())], ["word", "ctx", "pair", "n"])

    names = ["codes", "_groups"] if only_head else ["codes", "_groups", "_tail"]
    return encoded.select(*names).mapInArrow(run, "word binary, ctx binary, pair int, n long")


def _pair_matrix(pairs: DataFrame, n_classes: int) -> np.ndarray:
    pair = np.zeros(n_classes * n_classes)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pair[r.pair] = r.n
    return pair.reshape(n_classes, n_classes)


def _context_logs(pair: np.ndarray) -> np.ndarray:
    """What a context (row) adds to the class bigram likelihood if its word is in a class."""
    m = pair + 0.01
    return np.concatenate(((np.log(m) - np.log(m.sum(axis=1, keepdims=True))).T, np.log(m) - np.log(m.sum(axis=0, keepdims=True))))


def _assign(contexts: DataFrame, fixed: dict[bytes, int], logs: np.ndarray, group_logs: np.ndarray, group_class: np.ndarray) -> DataFrame:
    """``word, c, k``: count and likeliest class of every word; ``fixed`` ones keep theirs.
    ``group_logs`` is what a word's group says for each class before its own contexts do."""
    # rows of a word follow each other, so a task holds the contexts of a few words at a time,
    # however many tasks counted a common one
    ordered = contexts.filter("word is not null").select("word", "ctx").repartition("word").sortWithinPartitions("word")
    shared = contexts.sparkSession.sparkContext.broadcast((fixed, logs, group_logs, group_class))
    slots, n_classes = logs.shape

    def run(batches):
        keep, of_ctx, of_group, default = shared.value
        live = np.unique(np.concatenate((default, np.fromiter(keep.values(), np.int64))))
        dead = np.setdiff1d(np.arange(n_classes), live)

        def out(words, x):
            score = x @ of_ctx + of_group[[group_of(w, len(default)) for w in words]]
            score[:, dead] = -np.inf
            k = score.argmax(axis=1)
            for i, w in enumerate(words):
                if w in keep:
                    k[i] = keep[w]
            c = x[:, n_classes:].sum(axis=1).astype(np.int64)  # every token has one before it
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(k, pa.int32())], ["word", "c", "k"])

        held = None
        for batch in batches:
            each, data = batch.column("word").to_pylist(), batch.column("ctx").to_pylist()
            new = np.array([a != b for a, b in zip(each, [None, *each], strict=False)])
            words = [each[i] for i in np.flatnonzero(new)]
            if not words:
                continue
            owner = np.repeat(np.cumsum(new) - 1, [len(x) // _CTX.itemsize for x in data])
            got = np.frombuffer(b"".join(data), dtype=_CTX)
            x = np.bincount(owner * slots + got["slot"], weights=got["n"], minlength=len(words) * slots).reshape(-1, slots)
            if held is not None:
                if held[0] == words[0]:
                    x[0] += held[1]
                else:
                    yield out([held[0]], held[1][None])
            held = words[-1], x[-1].copy()
            if len(words) > 1:
                yield out(words[:-1], x[:-1])
        if held is not None:
            yield out([held[0]], held[1][None])

    with batch_rows(contexts.sparkSession, 4000):
        return materialize(ordered.mapInArrow(run, "word binary, c long, k int"), "word-classes")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, n_classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each item: items move one at a time to the class that raises the
    class bigram likelihood most, until a sweep moves none."""
    n = len(bigrams)
    mass = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    cls = np.empty(n, dtype=np.int64)
    cls[order] = np.arange(n) % n_classes
    member = np.zeros((n, n_classes))
    member[np.arange(n), cls] = 1.0
    to = bigrams @ member  # item -> class
    of = bigrams.T @ member  # class -> item
    pair = member.T @ to
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            a, self_pair = cls[w], bigrams[w, w]
            # the item's pairs with the classes, itself apart
            out_w, in_w = to[w].copy(), of[w].copy()
            out_w[a] -= self_pair
            in_w[a] -= self_pair
            rest = pair.copy()
            rest[a, :] -= out_w
            rest[:, a] -= in_w
            rest[a, a] -= self_pair
            # what a class has in all, whichever class the item joins
            row, col = rest.sum(axis=1) + in_w, rest.sum(axis=0) + out_w
            # joining class b adds out_w to its row, in_w to its column, all to [b, b]
            gain = (_xlogx(rest + out_w) - _xlogx(rest)).sum(axis=1) + (_xlogx(rest + in_w[:, None]) - _xlogx(rest)).sum(axis=0)
            d = np.diagonal(rest)
            gain += _xlogx(d + out_w + in_w + self_pair) - _xlogx(d + out_w) - _xlogx(d + in_w) + _xlogx(d)
            gain -= _xlogx(row + out_w.sum() + self_pair) - _xlogx(row) + _xlogx(col + in_w.sum() + self_pair) - _xlogx(col)
            b = int(np.argmax(gain))
            pair = rest
            if gain[b] > gain[a] + 1e-9:
                moved += 1
                to[:, a] -= bigrams[:, w]
                to[:, b] += bigrams[:, w]
                of[:, a] -= bigrams[w]
                of[:, b] += bigrams[w]
                cls[w] = b
            else:
                b = a
            pair[b, :] += out_w
            pair[:, b] += in_w
            pair[b, b] += self_pair
        if not moved:
            break
    return cls


@dataclass
class Model:
    """All logarithms are to base 10."""

    tokens: int  # N
    types: int  # V
    discount: float
    n_words: int
    n_groups: int
    head: dict[bytes, int]
    head_class: np.ndarray
    head_emit: np.ndarray  # log P(word | class)
    head_base: np.ndarray
    group_class: np.ndarray
    step: np.ndarray  # log P(class | class before)
    class_log: np.ndarray  # log of the tokens of each class
    unseen_log: np.ndarray  # log of the mass kept for unseen words, in tokens


def train(texts: DataFrame, counts: DataFrame, **options) -> Model:
    """Fit on the training ``texts`` (``_tm_bytes``) and their word ``counts``."""
    return _fit(texts.select("_tm_bytes", F.lit(False).alias("held_out")), counts, **options)[0]


def _fit(
    texts: DataFrame, counts: DataFrame, *, n_words: int = 512, n_groups: int = 512, n_classes: int = 48, n_head: int = 262_144, pull: float = 20.0, rounds: int = 2, trust: float = 4.0,
    max_bytes: int = 128,
) -> tuple[Model, DataFrame]:
    """The model fitted on the ``texts`` that are not ``held_out``, whose words are counted
    in ``counts``, and all texts placed in classes (:func:`_place`).

    Each of ``rounds`` gives words the class that their own contexts make likeliest; their
    group's contexts count as ``trust`` tokens besides."""
    # counts of counts in steps of an eighth of a power of two: at most 512 rows
    bands = counts.groupBy(F.floor(F.log2("c") * 8).alias("band")).agg(
        F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")
    ).collect()
    types, tokens = sum(r.v for r in bands), sum(r.n for r in bands)
    n1, n2 = sum(r.n1 for r in bands), sum(r.n2 for r in bands)
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    least, room = None, n_head
    for r in sorted(bands, key=lambda r: -r.band):
        if r.v > room:
            break
        least, room = r.band, room - r.v
    # a word of many bytes is never broadcast: it is joined like the others
    is_common = (F.floor(F.log2("c") * 8) >= least if least is not None else F.lit(False)) & (F.octet_length("word") <= max_bytes) | (F.col("word") == F.lit(END))
    got = counts.filter(is_common).toArrow()
    head = sorted(((c, bytes(w)) for w, c in zip(got.column("word").to_pylist(), got.column("c").to_pylist(), strict=True)), key=lambda x: (-x[0], x[1]))
    if not any(w == END for _, w in head):
        head.append((0, END))
    place = {w: i for i, (_, w) in enumerate(head)}
    items = {w: i for i, (_, w) in enumerate([(0, END), *[x for x in head if x[1] != END]][:n_words])}
    n_words = min(n_words, len(items))
    encoded = materialize(_encode(texts.withColumn("_row", F.monotonically_increasing_id()), place, n_groups), "codes")
    training = encoded.filter(~F.col("held_out"))
    item_of = np.array([items[w] if w in items else n_words + group_of(w, n_groups) for _, w in head], dtype=np.int64)
    bigrams = count_bigrams(training, item_of, place[END], n_words, n_groups)
    cls = exchange(bigrams, n_classes)
    fixed, group_class = {w: int(cls[i]) for w, i in items.items()}, cls[n_words:]
    head_class = cls[item_of]
    member = np.zeros((len(cls), n_classes))
    member[np.arange(len(cls)), cls] = 1.0
    near = np.concatenate((bigrams[n_words:] @ member, bigrams[:, n_words:].T @ member), axis=1)
    near *= trust / np.maximum(near[:, n_classes:].sum(axis=1, keepdims=True), 1.0)
    for r in range(rounds):
        contexts = materialize(_contexts(training, [w for _, w in head], head_class, group_class, n_classes, only_head=r < rounds - 1), "contexts")
        logs = _context_logs(_pair_matrix(contexts.filter("word is null"), n_classes))
        words = _assign(contexts, fixed, logs, near @ logs, group_class)
        discard(contexts)
        got = words.filter(is_common).select("word", "k").toArrow()
        for w, k in zip(got.column("word").to_pylist(), got.column("k").to_pylist(), strict=True):
            head_class[place[w]] = k
    size, kinds = np.zeros(n_classes), np.zeros(n_classes)
    for r in words.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        size[r.k], kinds[r.k] = r.n, r.v
    size = np.maximum(size, 1e-9)
    head_c = np.array([c for c, _ in head], dtype=np.float64)
    class_log = np.log10(size)
    model = Model(
        tokens, types, discount, n_words, n_groups, place, head_class,
        np.log10(np.maximum(head_c - discount, 1e-9)) - class_log[head_class], np.log10((head_c + 0.1) / (tokens + 0.1 * (types + 1))),
        group_class, np.zeros((n_classes, n_classes)), class_log, np.log10(np.maximum(discount * kinds, 0.1)),
    )
    placed = materialize(_place(_resolve(encoded, words), model), "classes")
    pair = _pair_matrix(_class_pairs(placed.filter(~F.col("held_out")), n_classes, int(head_class[place[END]])), n_classes)
    prior = (size + 0.5) / (size + 0.5).sum()
    model.step = np.log10((pair + pull * prior) / (pair.sum(axis=1, keepdims=True) + pull))
    return model, placed


def _place(resolved: DataFrame, model: Model) -> DataFrame:
    """Of each text: token count, known words, base score, what the words give in their
    classes, and the ``classes`` of its tokens."""
    shared = resolved.sparkSession.sparkContext.broadcast(model)
    names = [c for c in resolved.columns if c not in ("codes", "_tail", "_groups", "_seen")]
    whole = math.log10(max(model.tokens + 0.1 * (model.types + 1), 1e-9))

    def run(batches):
        m = shared.value
        for batch in batches:
            n_tokens, known, base, score, classes = [], [], [], [], []
            for codes, c, k in _tail_known(batch, m.group_class):
                emit = np.where(c > 0, np.log10(np.maximum(c - m.discount, 1e-9)), m.unseen_log[k]) - m.class_log[k]
                n_tokens.append(len(codes))
                known.append(int(_looked_up(codes, np.ones(len(m.head), dtype=np.int64), c > 0).sum()))
                base.append(float(_looked_up(codes, m.head_base, np.log10(c + 0.1) - whole).sum()))
                score.append(float(_looked_up(codes, m.head_emit, emit).sum()))
                classes.append(_looked_up(codes, m.head_class, k).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(classes, pa.binary())],
                [*names, "n_tokens", "_known", "_base", "_score", "classes"],
            )

    return resolved.select(*names, "codes", "_groups", "_seen").mapInArrow(run, schema_with(resolved, names, "n_tokens long, _known long, _base double, _score double, classes binary"))


def _steps(value, end: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(value.as_py(), dtype=np.int16).astype(np.int64)
    return np.concatenate(([end], a[:-1])), a


def _class_pairs(placed: DataFrame, n_classes: int, end: int) -> DataFrame:
    def run(batches):
        total = np.zeros(n_classes * n_classes, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                before, after = _steps(value, end)
                np.add.at(total, before * n_classes + after, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    return placed.select("classes").mapInArrow(run, "pair int, n long")


def _score(placed: DataFrame, model: Model) -> DataFrame:
    """``placed`` with the class steps added to ``_score``."""
    step, end = model.step, int(model.head_class[model.head[END]])
    names = [c for c in placed.columns if c not in ("classes", "_score")]

    def run(batches):
        for batch in batches:
            got = [s + float(step[_steps(v, end)].sum()) for s, v in zip(batch.column("_score").to_pylist(), batch.column("classes"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, pa.float64())], [*names, "_score"])

    return placed.mapInArrow(run, schema_with(placed, names, "_score double"))


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and the
    model's ``perplexity`` of every document."""
    with batch_rows(docs.sparkSession):
        return _report(docs, **options)


def _report(docs: DataFrame, **options) -> DataFrame:
    texts = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("_tm_bytes"))
    counts = materialize(count_words(texts.filter(~F.col("held_out"))), "word-counts")
    model, placed = _fit(texts, counts, **options)
    out = _score(placed, model)
    # END is among the common words even where training gave none
    score = F.col("_score") if model.tokens else F.col("_base")
    known = F.col("_known") if model.tokens else F.lit(0)
    return out.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("_base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
