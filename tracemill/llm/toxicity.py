"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its hashed features (the word itself and its
character 3- to 5-grams with boundary marks), a passage the mean of its words, and
a linear softmax over two classes scores it.  Vectors and softmax are trained
jointly in numpy, so a misspelling never seen shares the n-gram vectors of the
words it resembles.

A document is as toxic as its worst passage: labels are of documents, so training
starts from all passages of labelled documents and then repeatedly keeps, of a
toxic document, the passages that the model itself finds worst, and misspelt copies
of these and of as many clean ones.  Half of a word's features are left out at each
step, so that each learns to speak for it.  A logistic calibration maps the worst
passage's margin to a score.

The model is fitted on at most ``max_docs`` labelled documents a class, whole texts of
``max_docs * max_chars`` characters in all: those of at most ``max_chars`` first, then
longer ones, each in order of a hash of the id.  Every whole text is scored.
What is broadcast is one margin a feature bucket, ``2**bits`` floats.

Defined results: null and empty texts have no passage and score 0; without labelled
texts with words of both classes the score is the share of toxic ones among them (0 if
there are none), of a text without words too; each row is scored by its own text; of
rows with one id the shortest text, then the one with the least hash, is learned from;
of several labels of an id a toxic one counts; null ids are scored and not learned from;
an empty table gives an empty result; columns of any name come back as they were.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import schema_with, text_bytes

_ORDERS = (3, 4, 5)
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(63, _P, dtype=np.uint64))), dtype=np.uint64)
_STRIP = b".,;:!?\"'()[]{}<>"
#: Bytes of a word that is left whole, and characters of a piece of a longer one.
_LONG, _PIECE = 64, 24
_JOINTS = re.compile(r"[\s_/-]+")


def _pieces(word: bytes) -> list[bytes]:
    """A long word cut at Unicode spaces and at ``_ / -``, and what is still long into
    pieces that overlap by all but one of the characters of the longest n-gram."""
    text = word.decode(errors="replace")
    out = []
    for run in _JOINTS.split(text) if _JOINTS.sub("", text) else [text]:
        if run:
            out += [run[i : i + _PIECE] for i in range(0, max(1, len(run) - _ORDERS[-1] + 1), _PIECE - _ORDERS[-1] + 1)]
    return [x.encode() for x in out]


def tokens(data: bytes) -> list[bytes]:
    """Words of a text, ASCII lower-cased, those of more than ``_LONG`` bytes in pieces; a
    word repeated at once counts once, so that one odd word does not fill a passage."""
    words = data.lower().split()
    if any(len(w) > _LONG for w in words):
        words = [x for w in words for x in (_pieces(w) if len(w) > _LONG else (w,))]
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _P >> np.uint64(64 - bits)).astype(np.int64)


def features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of the subword features of the words."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = "".join(f"<{(w.strip(_STRIP) or w).decode(errors='replace')}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    raw_begin = np.flatnonzero(codes == ord("<"))
    # a word may itself hold the marks: count boundaries from the lengths instead
    if len(raw_begin) != len(words):
        size = np.array([len((w.strip(_STRIP) or w).decode(errors="replace")) + 2 for w in words])
        begin = np.cumsum(size) - size
    else:
        begin = raw_begin
        size = np.diff(np.append(begin, len(codes)))
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - begin[owner]
    left = size[owner] - place
    whole = np.add.reduceat((codes + np.uint64(1)) * _POWERS[place % 64], begin)
    buckets, owners = [_mixed(whole + np.uint64(7), bits)], [np.arange(len(words))]
    for n in _ORDERS:
        if len(codes) < n:
            break
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for j in range(n):
            h = h * _P + codes[j : len(codes) - n + 1 + j] + np.uint64(1)
        ok = left[: len(h)] >= n
        buckets.append(_mixed(h[ok] + np.uint64(n), bits))
        owners.append(owner[: len(h)][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def feature_table(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, and where each word's begin; worked
    out for some words at a time, as the arrays on the way are many times larger."""
    feats, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        bucket, of = features(part, bits)
        feats.append(bucket[np.argsort(of, kind="stable")].astype(np.int32))
        counts.append(np.bincount(of, minlength=len(part)))
    return np.concatenate(feats), np.cumsum(np.concatenate(counts))


def _word_margins(margin: np.ndarray, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(margin.astype(np.float32)[feats], starts[:-1]) / np.diff(starts)


@dataclass
class Model:
    """``margin`` of each feature bucket, the passage bias, and the calibration."""

    bits: int
    width: int
    margin: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def learn_words(self, words: set[bytes]) -> None:
        if len(self._cache) + len(words) > 100_000:
            self._cache.clear()
        new = [w for w in words if w not in self._cache]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            bucket, owner = features(part, self.bits)
            n = np.bincount(owner, minlength=len(part))
            s = np.bincount(owner, weights=self.margin[bucket], minlength=len(part)) / np.maximum(n, 1)
            self._cache.update(zip(part, s.tolist(), strict=True))

    def worst(self, words: list[bytes]) -> float:
        """Largest passage margin; passages overlap by half."""
        if not words:
            return -np.inf
        best = -np.inf
        step = 100_000
        for i in range(0, len(words), step):
            part = words[i : i + step + self.width]
            self.learn_words(set(part))
            get = self._cache.__getitem__
            sums = np.concatenate(([0.0], np.cumsum(np.fromiter(map(get, part), dtype=np.float64, count=len(part)))))
            if len(part) <= self.width:
                top = sums[-1] / len(part)
            else:
                at = np.append(np.arange(0, len(part) - self.width, max(1, self.width // 2)), len(part) - self.width)
                top = (sums[at + self.width] - sums[at]).max() / self.width
            best = max(best, top)
        return best + self.bias

    def score(self, words: list[bytes]) -> float:
        if self.constant is not None:
            return self.constant
        if not words:
            return 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * self.worst(words) + self.shift, -35, 35))))


def misspell(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one inner letter changed, doubled, dropped or swapped."""
    w = word.decode(errors="replace")
    if len(w) < 4:
        return word
    i, kind = int(rng.integers(1, len(w) - 1)), int(rng.integers(4))
    if kind == 0:
        w = w[:i] + chr(97 + int(rng.integers(26))) + w[i + 1 :]
    elif kind == 1:
        w = w[:i] + w[i] + w[i:]
    elif kind == 2:
        w = w[:i] + w[i + 1 :]
    else:
        w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    return w.encode()


def _fit_passages(words_of, feats, starts, passages, targets, weight, bits, dim, epochs, rng, state):
    """Adagrad on the softmax over passages; each is an array of word indices."""
    vec, out, bias, g_vec, g_out, g_bias = state
    order = np.arange(len(passages))
    size = 512
    for _ in range(epochs):
        rng.shuffle(order)
        for b in range(0, len(order), size):
            pick = order[b : b + size]
            rows = [passages[i] for i in pick]
            n_words = np.array([len(r) for r in rows])
            w = np.concatenate(rows)
            p_of_w = np.repeat(np.arange(len(rows)), n_words)
            n_feat = starts[w + 1] - starts[w]
            base = np.repeat(starts[w], n_feat)
            within = np.arange(len(base)) - np.repeat(np.cumsum(n_feat) - n_feat, n_feat)
            bucket = feats[base + within]
            # half of a word's features are left out at random, so that each learns to
            # speak for the word: a misspelling keeps only some of them
            w_of_f = np.repeat(np.arange(len(w)), n_feat)
            stay = rng.random(len(w_of_f)) < 0.5
            bucket, w_of_f = bucket[stay], w_of_f[stay]
            left = np.maximum(np.bincount(w_of_f, minlength=len(w)), 1)
            p_of_f = p_of_w[w_of_f]
            share = (1.0 / (left * n_words[p_of_w]))[w_of_f].astype(np.float32)
            hidden = np.stack([np.bincount(p_of_f, weights=vec[bucket, k] * share, minlength=len(rows)) for k in range(dim)], axis=1)
            logits = hidden @ out + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            wrong = prob
            wrong[np.arange(len(rows)), targets[pick]] -= 1.0
            wrong *= weight[pick][:, None]
            d_out, d_bias, d_hidden = hidden.T @ wrong, wrong.sum(axis=0), wrong @ out.T
            used, where = np.unique(bucket, return_inverse=True)
            d_vec = np.stack([np.bincount(where, weights=d_hidden[p_of_f, k] * share, minlength=len(used)) for k in range(dim)], axis=1)
            g_vec[used] += d_vec**2
            vec[used] -= 0.5 * d_vec / np.sqrt(g_vec[used] + 1e-8)
            g_out += d_out**2
            out -= 0.2 * d_out / np.sqrt(g_out + 1e-8)
            g_bias += d_bias**2
            bias -= 0.2 * d_bias / np.sqrt(g_bias + 1e-8)
    return state


def train(
    texts: list[bytes], toxic: list[int], *, bits: int = 16, dim: int = 6, width: int = 3, rounds: int = 3,
    max_passages: int = 40, seed: int = 11,
) -> Model:
    """Fit on labelled texts.  A text gives at most ``max_passages`` passages, chosen
    at random, to the clean side; all of a toxic text's passages are considered."""
    rng = np.random.default_rng(seed)
    worded = [i for i, t in enumerate(texts) if t.split()]
    texts, toxic = [texts[i] for i in worded], [toxic[i] for i in worded]
    n_toxic = sum(map(bool, toxic))
    if not n_toxic or n_toxic == len(toxic):
        return Model(bits, width, np.zeros(1 << bits), 0.0, constant=float(n_toxic / len(toxic)) if toxic else 0.0)
    vocab: dict[bytes, int] = {}
    passages, owner = [], []
    for d, data in enumerate(texts):
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in tokens(data)], dtype=np.int64)
        cuts = list(range(0, max(len(ids), 1), width))
        if not toxic[d] and len(cuts) > max_passages:
            cuts = rng.choice(cuts, max_passages, replace=False).tolist()
        for c in cuts:
            if len(ids[c : c + width]):
                passages.append(ids[c : c + width])
                owner.append(d)
    owner = np.array(owner, dtype=np.int64)
    words = list(vocab)
    feats, starts = feature_table(words, bits)
    truth = np.array([int(bool(t)) for t in toxic])[owner]
    init = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    start_out = rng.normal(0, 0.5, (dim, 2))
    keep = np.ones(len(passages), dtype=bool)
    model, extra, extra_truth = None, [], np.empty(0, dtype=np.int64)
    for r in range(rounds):
        state = (init.copy(), start_out.copy(), np.zeros(2), np.zeros((1 << bits, dim), np.float32), np.zeros((dim, 2)), np.zeros(2))
        sel = np.flatnonzero(keep)
        chosen, goal = [passages[i] for i in sel] + extra, np.concatenate((truth[sel], extra_truth))
        share = np.where(goal == 1, 0.5 / max(1, goal.sum()), 0.5 / max(1, (goal == 0).sum())) * len(goal)
        vec, out, bias, *_ = _fit_passages(words, feats, starts, chosen, goal, share, bits, dim, 2 if r < rounds - 1 else 3, rng, state)
        model = Model(bits, width, (vec @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
        s = _word_margins(model.margin, feats, starts)
        margin = np.array([s[p].mean() for p in passages]) + model.bias
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, margin)
        # of a toxic text: the worst passage and those as bad as the toxic side's usual worst
        bar = np.quantile(top[np.array(toxic, dtype=bool)], 0.25)
        worst = (margin >= top[owner]) | (margin >= bar)
        keep = (truth == 0) | worst
        # misspelt copies of the worst passages, and of as many clean ones
        bad, fine = np.flatnonzero(worst & (truth == 1)), np.flatnonzero(truth == 0)
        copied = np.concatenate((bad, rng.choice(fine, min(len(fine), len(bad)), replace=False)))
        extra, made = [], []
        for i in copied.tolist():
            extra.append(np.arange(len(words) + len(made), len(words) + len(made) + len(passages[i])))
            made += [misspell(words[j], rng) for j in passages[i].tolist()]
        extra_truth = truth[copied]
        more, begin = feature_table(made, bits)
        feats, starts = np.concatenate((feats, more)), np.concatenate((starts, starts[-1] + begin[1:]))
        words = words + made
    # calibration of the worst passage's margin
    # and of the misspelt worst passages, which are toxic too
    s = _word_margins(model.margin, feats, starts)
    odd = np.array([s[p].mean() for p, t in zip(extra, extra_truth, strict=True) if t]) + model.bias
    x = np.concatenate(([model.worst(tokens(t)) for t in texts], odd))
    y = np.concatenate(([float(bool(t)) for t in toxic], np.ones(len(odd))))
    # both classes weigh the same; misspelt copies are a fifth of the toxic side
    part = np.concatenate((np.full(len(texts), 0.8 / n_toxic), np.full(len(odd), 0.2 / max(1, len(odd)))))
    weight = np.where(y == 1, 0.5 * part, 0.5 / (1 - y).sum())
    mid = float(np.average(x, weights=weight))
    spread = float(np.sqrt(np.average((x - mid) ** 2, weights=weight))) or 1.0
    z = (x - mid) / spread
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        e = weight * (p - y)
        v = np.maximum(weight * p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(e * z).sum() + 1e-3 * a, e.sum()]))
        step = np.clip(step, -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.scale, model.shift = a / spread, b - a * mid / spread
    return model


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0.  A null id
    counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 1500, max_chars: int = 20_000, **options) -> Model:
    """Train on labelled documents: at most ``max_docs``, and ``max_docs * max_chars``
    characters, a class."""
    marks = labels.select(F.col("doc_id").alias("_tm_id"), F.col("toxic").alias("_tm_toxic")).dropna()
    marks = marks.filter(~held_out("_tm_id")).groupBy("_tm_id").agg((F.max("_tm_toxic") > 0).alias("_tm_toxic"))
    # identifiers and numbers only: texts are fetched for the few that are picked
    size, mark = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)), F.xxhash64(text_bytes())
    sized = docs.select("doc_id", size.alias("_size"), mark.alias("_mark")).join(marks, F.col("doc_id") == F.col("_tm_id"))
    sized = sized.groupBy("_tm_id", "_tm_toxic").agg(F.min(F.struct((F.col("_size") > max_chars).alias("long"), "_size", "_mark")).alias("_t"))
    sized = sized.select("_tm_id", "_tm_toxic", "_t.*", F.xxhash64(F.lit("fit"), "_tm_id").alias("_draw"))
    sides = [sized.filter(side).orderBy("long", "_draw", "_tm_id").limit(max_docs) for side in (F.col("_tm_toxic"), ~F.col("_tm_toxic"))]
    wanted, room = [], {True: max_docs * max_chars, False: max_docs * max_chars}
    for r in sorted(sides[0].unionAll(sides[1]).collect(), key=lambda r: (r.long, r._draw, r._tm_id)):
        if r._size <= room[r._tm_toxic]:
            room[r._tm_toxic] -= r._size
            wanted.append((r._tm_id, r._mark, int(r._tm_toxic)))
    if not wanted:
        return train([], [], **options)
    # at most 2 * max_docs rows of three numbers
    picked = docs.sparkSession.createDataFrame(wanted, schema_with(marks, ["_tm_id"], "_mark long, y int"))
    texts = docs.select("doc_id", text_bytes().alias("b")).join(F.broadcast(picked), (F.col("doc_id") == F.col("_tm_id")) & (F.xxhash64("b") == F.col("_mark")))
    rows = texts.dropDuplicates(["doc_id"]).select("doc_id", "b", "y").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([bytes(r.b) for r in rows], [r.y for r in rows], **options)


def _score_only(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, _tm_score`` without carrying the texts back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("_tm_bytes"))

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.score(tokens(v.as_py())) for v in batch.column("_tm_bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64())], ["doc_id", "held_out", "_tm_score"])

    return given.mapInArrow(run, schema_with(given, ["doc_id", "held_out"], "_tm_score double"))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = _score_only(docs, fit(docs, labels, **options))
    return scored.select("doc_id", "held_out", F.col("_tm_score").alias("score"), (F.col("_tm_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    # columns go by place, so that names of any kind can't clash
    place = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    given = place.withColumn("bytes", text_bytes(f"_{docs.columns.index(text_col)}"))

    def run(batches):
        m = shared.value
        for batch in batches:
            clean = [m.score(tokens(v.as_py())) < threshold for v in batch.column("bytes")]
            yield batch.filter(pa.array(clean, pa.bool_())).drop_columns(["bytes"])

    return given.mapInArrow(run, place.schema).toDF(*docs.columns)
