"""Personal data by weak supervision.

Four kinds of span are found: email, ip, card, phone.  *Base* spans follow fixed
patterns and checks and always stay.  A wider net gathers candidates (spaced or
bracketed addresses, numbers without a country sign, dotted cards); on each
candidate several labelers vote for, against or not at all: a pattern labeler,
checksums, gazetteers, context words, shape and boundaries.  Expectation-
maximisation over the counts of vote patterns of *all* candidates estimates how
reliable each labeler is, without labels; the posteriors then train a logistic
span classifier per kind, whose candidates above ``threshold`` join the base
spans where they overlap none.

Only the counts of vote patterns reach the driver: at most kinds x 3**labelers x
shapes rows, whatever the size of the corpus.

Defined results: null and empty texts have no spans; an empty table gives a model
that adds nothing; spans are [start, end) in code points of the whole text; repeated
rows are each counted and reported; ties in probability go by start, then kind; null
and repeated ids change nothing; columns of any name come back as they were; the work
on a text grows in proportion to its candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import schema_with, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape", "boundary")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and ends where one ends
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAY = re.compile(rb"[0-9@]|[(\[{]at[)\]}]", re.IGNORECASE)

_AT = re.compile(r"\x20?(?:@|[(\[{]at[)\]}])\x20?", re.IGNORECASE)
_WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{](?:dot|\.)[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
_WIDE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20.\-]?[0-9]){12,18}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![\w+])(?:\+|00)?\(?[0-9][0-9\x20()./\-]{5,30}[0-9](?![0-9])")

# Fixed gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz de fr es it nl uk us ch at be pl eu".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CONTEXT_FOR = {
    "email": "email e-mail mail contact write kontakt correo courriel".split(),
    "ip": "ip address server host login adresse client from".split(),
    "card": "card visa mastercard amex credit debit karte tarjeta carte pay".split(),
    "phone": "phone tel call mobile fax telefon telefono anruf whatsapp".split(),
}
CONTEXT_AGAINST = frozenset("version release section chapter isbn license figure page token password sha commit build order".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, p + 1) if a < p else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        p = text.find("@", max(p + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns: leftmost, non-overlapping per kind; a match that
    fails its check is dropped and not retried."""
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if _octets(m[0])],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


def _candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _AT.finditer(text):
        a = m.start()
        while a and m.start() - a < 64 and text[a - 1] in _LOCAL:
            a -= 1
        d = _WIDE_DOMAIN.match(text, m.end())
        if a < m.start() and d:
            out.append(("email", a, d.end()))
    out += [("ip", *m.span()) for m in _WIDE_IP.finditer(text)]
    out += [("card", *m.span()) for m in _WIDE_CARD.finditer(text)]
    out += [("phone", *m.span()) for m in _WIDE_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    return out


class _Spans:
    """Answers whether any of fixed spans overlaps [a, b)."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def meets(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)
        return before > 0 and self.reach[before - 1] > a


class _Taken:
    """Spans that overlap none of each other, added in any order: cells of fixed width
    list the spans that reach into them."""

    WIDTH = 512

    def __init__(self):
        self.cells: dict[int, list[tuple[int, int]]] = {}

    def meets(self, a: int, b: int) -> bool:
        return any(x < b and a < y for cell in range(a // self.WIDTH, (b - 1) // self.WIDTH + 1) for x, y in self.cells.get(cell, ()))

    def add(self, a: int, b: int) -> None:
        for cell in range(a // self.WIDTH, (b - 1) // self.WIDTH + 1):
            self.cells.setdefault(cell, []).append((a, b))


def _context(text: str, kind: str, a: int, b: int) -> int:
    near = [w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])[-4:]] + [w.lower() for w in _WORD.findall(text[b : b + 20])[:1]]
    if any(w in CONTEXT_AGAINST for w in near):
        return -1
    return int(any(w in CONTEXT_FOR[kind] for w in near))


def votes(text: str, kind: str, a: int, b: int, base: dict[str, _Spans]) -> tuple[int, ...]:
    """One vote a labeler: 1 for, -1 against, 0 none."""
    s = text[a:b]
    d = _digits(s)
    pattern = int(base[kind].meets(a, b))
    if kind == "card":
        checksum = 1 if luhn(d) else -1
        gazetteer = 1 if d.startswith(CARD_PREFIXES) else -1
        shape = 1 if len(d) == 16 and re.fullmatch(r"[0-9]{16}|[0-9]{4}(?:([\x20.\-])[0-9]{4})(?:\1[0-9]{4}){2}", s) else 0
    elif kind == "ip":
        parts = re.findall("[0-9]+", s)
        checksum = 1 if all(int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if all(int(p) < 10 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        shape = 1 if sum(map(len, parts)) >= 7 else 0
    elif kind == "phone":
        checksum = 1 if 8 <= len(d) <= 15 else -1
        lead = d[2:] if s.startswith("00") else d
        gazetteer = 1 if s.startswith(("+", "00")) and lead.startswith(CALLING_CODES) else 0
        shape = 1 if re.search(r"\)\x20?[0-9]|[0-9]{2,4}[\x20./\-][0-9]{3,4}[\x20./\-][0-9]{2,4}", s) else -1 if s.isdigit() or re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", s) else 0
    else:
        tail = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
        checksum = 0
        gazetteer = 1 if tail in TOP_DOMAINS else -1
        shape = 1 if " " not in s else 0
    before, after = text[a - 1 : a], text[b : b + 1]
    boundary = -1 if before.isalnum() or after.isalnum() or before in ("/", "#", "=", "-") and before else 1
    return pattern, checksum, gazetteer, _context(text, kind, a, b), shape, boundary


def gather(data: bytes) -> tuple[str, dict, list]:
    """(text, base spans, candidates with votes) of a text; nothing for most."""
    if not _MAY.search(data):
        return "", {}, []
    text = data.decode(errors="replace")
    base = base_spans(text)
    of = {k: _Spans(v) for k, v in base.items()}
    found = []
    for k, a, b in _candidates(text):
        # what a base span of another kind covers is settled
        if not any(of[other].meets(a, b) for other in KINDS if other != k):
            found.append((k, a, b, votes(text, k, a, b, of)))
    return text, base, found


def _row(v: tuple[int, ...], n: int) -> np.ndarray:
    """Features of the span classifier: votes one-hot, size bucket, constant."""
    x = np.zeros(2 * len(LABELERS) + 4 + 1)
    for j, vote in enumerate(v):
        if vote:
            x[2 * j + (vote > 0)] = 1.0
    x[2 * len(LABELERS) + n] = 1.0
    x[-1] = 1.0
    return x


def _size(kind: str, a: int, b: int) -> int:
    n = b - a
    return 0 if n < 12 else 1 if n < 16 else 2 if n < 20 else 3


@dataclass
class Model:
    """Classifier weights of each kind; ``reliability`` of each kind and labeler:
    P(vote | truth) as a (2, 3) array over votes -1, 0, 1."""

    weights: dict[str, np.ndarray]
    reliability: dict[str, np.ndarray]

    def probability(self, kind: str, v: tuple[int, ...], a: int, b: int) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(w @ _row(v, _size(kind, a, b)), -35, 35))))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of truth for each vote pattern, and the labelers' reliabilities."""
    seen = patterns + 1
    post = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for y, weight in ((0, counts * (1 - post)), (1, counts * post)):
            for j in range(patterns.shape[1]):
                t = np.bincount(seen[:, j], weights=weight, minlength=3) + 1.0
                table[y, j] = t / t.sum()
        prior = (counts @ post + 1) / (counts.sum() + 2)
        ll = [np.log(p) + sum(np.log(table[y, j, seen[:, j]]) for j in range(patterns.shape[1])) for y, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -35, 35)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, table


def fit_counts(rows: list[tuple[str, tuple[int, ...], int, int]]) -> Model:
    """Fit on (kind, votes, size bucket, count) of all candidates."""
    weights, reliability = {}, {}
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        if not own:
            continue
        patterns = np.array([r[1] for r in own], dtype=np.int64)
        counts = np.array([r[3] for r in own], dtype=np.float64)
        post, table = em(patterns, counts)
        x = np.array([_row(r[1], r[2]) for r in own])
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            g = x.T @ (counts * (p - post)) + 0.5 * w
            h = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(len(w))
            step = np.linalg.solve(h, g)
            step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        weights[kind], reliability[kind] = w, table
    return Model(weights, reliability)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Estimate labelers and classifier from every candidate of every text."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for value in batch.column(0):
                for kind, a, b, v in gather(value.as_py())[2]:
                    key = (kind, ",".join(map(str, v)), _size(kind, a, b))
                    seen[key] = seen.get(key, 0) + 1
            if seen:
                kind, v, n = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(v), pa.array(n, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "size", "n"]
                )

    got = docs.select(text_bytes(text_col).alias("_tm_bytes")).mapInArrow(run, "kind string, votes string, size int, n long")
    rows = got.groupBy("kind", "votes", "size").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return fit_counts([(r[0], tuple(int(x) for x in r[1].split(",")), r[2], r[3]) for r in rows])


def spans_of(data: bytes, model: Model, threshold: float = 0.5) -> tuple[str, dict, list[tuple[str, int, int]]]:
    """(text, base spans, all spans by kind and start); text is empty where nothing is found."""
    text, base, found = gather(data)
    every = [(k, a, b) for k in KINDS for a, b in base.get(k, ())]
    settled, taken = _Spans((a, b) for _, a, b in every), _Taken()
    scored = sorted(((model.probability(k, v, a, b), k, a, b) for k, a, b, v in found), key=lambda x: (-x[0], x[2], KINDS.index(x[1])))
    for p, k, a, b in scored:
        if p >= threshold and not settled.meets(a, b) and not taken.meets(a, b):
            every.append((k, a, b))
            taken.add(a, b)
    every.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return text, base, every


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document;
    counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    given = docs.select("doc_id", text_bytes().alias("_tm_bytes"))

    def run(batches):
        model = shared.value
        for batch in batches:
            counts, base_text, all_text = [[] for _ in KINDS], [], []
            for value in batch.column("_tm_bytes"):
                _, base, every = spans_of(value.as_py(), model, threshold)
                for k, out in zip(KINDS, counts, strict=True):
                    out.append(len(base.get(k, ())))
                base_text.append(_joined((k, a, b) for k in KINDS for a, b in base.get(k, ())))
                all_text.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    added = ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    out = given.mapInArrow(run, schema_with(given, ["doc_id"], added))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span replaced by ``<KIND>``; an ``n_chars`` column is brought
    up to date where the text changed.  Overlapping spans are replaced as one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    # columns go by place, so that names of any kind can't clash
    place = [f"_{i}" for i in range(len(docs.columns))]
    text, out = place[docs.columns.index(text_col)], docs.toDF(*place)

    @F.udf("string", useArrow=True)
    def masked(data):
        whole, _, every = spans_of(bytes(data), shared.value, threshold)
        if not every:
            return None
        parts, at = [], 0
        for k, a, b in sorted(every, key=lambda x: (x[1], -x[2])):
            if a >= at:
                parts += [whole[at:a], f"<{k.upper()}>"]
            at = max(at, b)
        return "".join([*parts, whole[at:]])

    out = out.withColumn("new", masked(text_bytes(text)))
    hit = F.col("new").isNotNull()
    out = out.withColumn(text, F.when(hit, F.col("new")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n, kind = place[docs.columns.index("n_chars")], docs.schema["n_chars"].dataType
        out = out.withColumn(n, F.when(hit, F.length(text).cast(kind)).otherwise(F.col(n)))
    return out.select(*place).toDF(*docs.columns)
