"""Benchmark decontamination with a generalised suffix automaton.

The benchmark items are normalised (``A-Z`` lower-cased, words are maximal runs
of digits, letters and non-ASCII characters) and put into one generalised suffix
automaton over word identifiers.  Document words are streamed through it while
the longest matching length is tracked; a position whose match is at least
``window`` words long lies at the end of a benchmark window.

An automaton is built per chunk of about ``max_chunk_words`` item words (a longer
item is cut into parts that overlap by all but one of a window's words), so what is
broadcast has a fixed bound.  With a benchmark of several chunks the texts are written
once, numbered; each chunk then reads them and gives only the documents that it hits,
whose spans are united by row at the end.

Defined results: null and empty texts have no words and no hits; an item with
fewer words than the window is one window as a whole; an item without words is
never found; items with a null id mark words but are not listed; repeated ids of
items are listed once, rows of documents are each judged by themselves, whatever
their ids; an empty table of documents or items gives no hits; columns of any name
come back as they were.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, schema_with, text_bytes

#: Byte -> itself in lower case if it belongs to a word, else a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the words of (id, bytes) items."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        read = []
        for item_id, data in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(data)]
            if ids:
                read.append((item_id, ids))
                last = 0
                for x in ids:
                    last = self._extend(last, x)
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        # the state that holds the last `window` words of any match that long
        self.top = [-1] * n
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.top[s] = self.top[up] if self.length[up] >= window else s
        owners: dict[int, set] = {}
        own_short: dict[int, list] = {}
        self.least = window
        for item_id, ids in read:
            s = 0
            for x in ids:
                s = self.next[s][x]
                if self.top[s] >= 0:
                    owners.setdefault(self.top[s], set()).add(item_id)
            if len(ids) < window:
                while self.length[self.link[s]] >= len(ids):
                    s = self.link[s]
                own_short.setdefault(s, []).append((len(ids), item_id))
                self.least = min(self.least, len(ids))
        self.owners = {s: tuple(v) for s, v in owners.items()}
        # short items that end where a state ends: its own and those of its suffixes
        self.short: dict[int, tuple] = {}
        if own_short:
            for s in order:
                found = tuple(own_short.get(s, ())) + self.short.get(self.link[s], ())
                if found:
                    self.short[s] = found

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last]:
            q = nxt[last][x]
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return cur

    def _clone(self, p: int, x: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = made
        while p != -1 and nxt[p].get(x) == q:
            nxt[p][x] = made
            p = link[p]
        return made

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [from, to) of hit words, merged, and the ids of the items found."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if len(words) < self.least or not self.vocab:
            return spans, found
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        # a match lies in a run of benchmark words that is long enough
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], ids, [-1])) >= 0))
        begin, end = edge[0::2], edge[1::2]
        keep = end - begin >= self.least
        nxt, link, length, top, w = self.next, self.link, self.length, self.top, self.window
        for b, e in zip(begin[keep].tolist(), end[keep].tolist(), strict=True):
            s = size = 0
            for i, x in enumerate(ids[b:e].tolist(), b):
                while s and x not in nxt[s]:
                    s = link[s]
                    size = length[s]
                if x in nxt[s]:
                    s = nxt[s][x]
                    size += 1
                hit = 0
                if size >= w:
                    hit = w
                    # the match may be shorter than the state's longest string
                    found.update(self.owners[top[s]])
                if s in self.short:
                    for k, item_id in self.short[s]:
                        if k <= size:
                            hit = max(hit, k)
                            found.add(item_id)
                if hit:
                    lo = i + 1 - hit
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, found


def _chunks(items: DataFrame, id_col: str, text_col: str, window: int, max_chunk_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of consecutive items; one at a time is held on the driver."""
    rows = items.select(F.col(id_col).cast("string"), text_bytes(text_col)).distinct()
    most = max(max_chunk_words, window)
    held, size = [], 0
    for item_id, data in rows.toLocalIterator():
        words = words_of(bytes(data))
        # parts share a window less one word, so that each window lies in a part
        for i in range(0, max(1, len(words) - window + 1), most):
            part = words[i : i + most + window - 1]
            if held and size + len(part) > max_chunk_words:
                yield SuffixAutomaton(held, window)
                held, size = [], 0
            held.append((item_id, b" ".join(part)))
            size += len(part)
    yield SuffixAutomaton(held, window)


_FOUND = "n_words long, spans array<long>, items array<string>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(texts: DataFrame, automaton: SuffixAutomaton, keep: list[str], only_hits: bool) -> DataFrame:
    """``keep`` columns with ``n_words, spans, items`` of the ``bytes`` of each row."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        a = shared.value
        for batch in batches:
            n_words, spans, ids, at = [], [], [], []
            for i, value in enumerate(batch.column("bytes")):
                words = words_of(value.as_py())
                s, found = a.scan(words)
                if s or not only_hits:
                    at.append(i)
                    n_words.append(len(words))
                    spans.append([x for pair in s for x in pair])
                    ids.append(sorted(x for x in found if x is not None))
            kept = batch.select(keep)
            if len(at) < len(batch):
                kept = kept.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))],
                [*keep, "n_words", "spans", "items"],
            )

    return texts.select(*keep, "bytes").mapInArrow(run, schema_with(texts, keep, _FOUND))


def find_spans(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, max_chunk_words: int = 200_000, keep_text: bool = True,
) -> DataFrame:
    """The columns of ``docs`` by place, as ``_0, _1, ...``, with ``n_words``, ``spans`` (flat
    [from, to) word positions of merged hit spans) and ``items`` (ids of items found).

    ``keep_text=False`` leaves the text column out.
    """
    place = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    keep = place if keep_text else place[:at] + place[at + 1 :]
    texts = docs.toDF(*place).withColumn("bytes", text_bytes(place[at]))
    chunks = _chunks(items, item_id_col, item_text_col, window, max_chunk_words)
    automaton, following = next(chunks), next(chunks, None)
    if following is None:
        return _scan(texts, automaton, keep, only_hits=False)
    # written once, so that a row has one number wherever it is read
    rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = []
    while automaton is not None:
        found.append(materialize(_scan(rows, automaton, ["row"], only_hits=True), "hits"))
        automaton, following = following, next(chunks, None)
    parts = functools.reduce(DataFrame.unionAll, found).groupBy("row").agg(F.collect_list("spans").alias("parts"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    @F.udf("struct<n: long, spans: array<long>>", useArrow=True)
    def united(data, parts):
        spans = _merge([pair for flat in parts or () for pair in zip(flat[0::2], flat[1::2], strict=True)])
        return len(words_of(bytes(data))), [x for pair in spans for x in pair]

    out = rows.join(parts, "row", "left").withColumn("u", united("bytes", "parts"))
    none = F.array().cast("array<string>")
    return out.select(*keep, F.col("u.n").alias("n_words"), F.col("u.spans").alias("spans"), F.coalesce("items", none).alias("items"))


def n_hit(spans: str = "spans"):
    """Words inside flat [from, to) spans."""
    # x - a alternates signs: to_k - (from_k - (... )), which telescopes to the sum of lengths
    return F.expr(f"aggregate({spans}, 0L, (a, x) -> x - a)")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Contamination of each document: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``."""
    found = find_spans(docs.select("doc_id", "text"), items, keep_text=False, **options)
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select(
        F.col("_0").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int], min_words: int) -> tuple[str, int]:
    """``text`` without its spans of at least ``min_words`` words, from the first
    word's start to the last one's end; and the number of words removed."""
    data = text.encode()
    folded = data.translate(_FOLD)
    drop = [(a, b) for a, b in zip(spans[0::2], spans[1::2], strict=True) if b - a >= min_words]
    if not drop:
        return text, 0
    kept, at, word, pos, removed = [], 0, 0, 0, 0
    ends = iter(drop)
    a, b = next(ends)
    for piece in folded.split():
        pos = folded.index(piece, pos)
        if word == a:
            kept.append(data[at:pos])
        pos += len(piece)
        word += 1
        if word == b:
            at = pos
            removed += b - a
            a, b = next(ends, (-1, -1))
    kept.append(data[at:])
    return b"".join(kept).decode(), removed


def remove(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = 10, min_span: int = 1,
    max_coverage: float = 0.5, **options,
) -> DataFrame:
    """``docs`` without benchmark passages.

    Hit spans of at least ``min_span`` words are cut out of the text; a document of
    which more than ``max_coverage`` of the words are hit goes altogether.  Other
    columns are kept; an ``n_chars`` column is brought up to date.
    """
    found = find_spans(docs, items, text_col=text_col, window=window, **options)
    found = found.filter(n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    place = [f"_{i}" for i in range(len(docs.columns))]
    text = place[docs.columns.index(text_col)]

    @F.udf("string", useArrow=True)
    def cut(text, spans):
        return cut_spans(text, spans, min_span)[0] if text is not None and len(spans) else text

    hit = F.size("spans") > 0
    out = found.withColumn("new", cut(F.when(hit, F.col(text)), "spans"))
    out = out.withColumn(text, F.when(hit, F.col("new")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n, kind = place[docs.columns.index("n_chars")], docs.schema["n_chars"].dataType
        out = out.withColumn(n, F.when(hit, F.length(text).cast(kind)).otherwise(F.col(n)))
    return out.select(*place).toDF(*docs.columns)


def items_digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
