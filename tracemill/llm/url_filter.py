"""URL filtering with a weighted vocabulary and host/path rules.

An Aho-Corasick automaton over a fixed vocabulary finds strict and soft terms in a URL.
A term counts only between boundaries: no ASCII letter or digit next to it; where terms
lie inside a longer one, the longest counts alone.  Terms have weights: a strict one (of
``STRICT`` weight) rejects a URL at once, soft ones (1 unless given) where the weights of
the distinct ones reach ``soft_limit``.  A rule that fits the URL overrides the method;
of several the longest wins.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the vocabulary (null: allowed); URLs of any length are
searched whole; repeated rows are each judged; rules of one length go by name; an empty
table gives an empty result; columns named like those of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import schema_with

# Fixed vocabulary: one strict term rejects a URL.
STRICT_TERMS = (
    "bestiality", "camgirl", "camgirls", "camsex", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai", "keygen",
    "malware", "milf", "phishing", "porn", "porno", "pornhub", "sexcam", "torrent", "torrents", "warez", "webcamsex", "xvideos", "xxx",
)
# Fixed vocabulary: several distinct soft terms reject a URL.
SOFT_TERMS = (
    "adult", "ads", "affiliate", "babes", "banner", "bet", "bets", "betting", "bonus", "bingo", "casino", "cash", "cheap", "cialis", "click",
    "coupon", "crack", "credit", "dating", "deal", "deals", "diet", "discount", "download", "erotic", "farm", "free", "gamble", "gambling", "girls",
    "hot", "jackpot", "loan", "loans", "lottery", "mortgage", "naked", "nude", "payday", "pharmacy", "pills", "poker", "popup", "prize", "promo",
    "replica", "serial", "sex", "sexy", "singles", "slots", "spam", "streaming", "teen", "track", "tracker", "viagra", "webcam", "weightloss", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Weight of a strict term: no sum of soft ones reaches it.
STRICT = float("inf")


class Vocabulary:
    """Weighted terms by Aho-Corasick; terms and texts are compared in lower case."""

    def __init__(self, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] | Mapping[str, float] = SOFT_TERMS):
        self.automaton = ahocorasick.Automaton()
        weights = {t.lower(): float(w) for t, w in (soft.items() if isinstance(soft, Mapping) else ((t, 1.0) for t in soft))}
        weights |= {t.lower(): STRICT for t in strict}
        for t, w in weights.items():
            if t:
                self.automaton.add_word(t, (t, w))
        self.empty = len(self.automaton) == 0
        self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, dict[str, float]]:
        """Number of strict hits, and the distinct soft terms hit with their weights."""
        if not url or self.empty:
            return 0, {}
        text = url.lower()
        if len(text) != len(url):  # a letter whose lower case is longer
            text = "".join(c.lower() if c.isascii() else c for c in url)
        # hits by end; one that begins no later than those before it holds them
        hits: list[tuple[int, int, str, float]] = []
        for end, (term, weight) in self.automaton.iter(text):
            a, b = end + 1 - len(term), end + 1
            if a and _inner(text[a - 1]) or b < len(text) and _inner(text[b]):
                continue
            while hits and a <= hits[-1][0]:
                hits.pop()
            if not hits or b > hits[-1][1]:
                hits.append((a, b, term, weight))
        strict = sum(w == STRICT for _, _, _, w in hits)
        return strict, {t: w for _, _, t, w in hits if w != STRICT}


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def count_terms(
    df: DataFrame, url_col: str, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] | Mapping[str, float] = SOFT_TERMS
) -> DataFrame:
    """``df`` with ``n_strict`` (hits), ``soft_terms`` (distinct, sorted) and ``soft_weight`` of a URL column."""
    made = ["n_strict", "soft_terms", "soft_weight"]
    keep = [c for c in df.columns if c not in made]
    given = df.select(*keep, F.col(url_col).cast("string").alias("_tm_url"))

    def run(batches):
        vocabulary = Vocabulary(strict, soft)
        for batch in batches:
            got = [vocabulary.count(u.as_py()) for u in batch.column("_tm_url")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep), pa.array([n for n, _ in got], pa.int64()), pa.array([sorted(s) for _, s in got], pa.list_(pa.string())),
                    pa.array([sum(s.values()) for _, s in got], pa.float64()),
                ],
                [*keep, *made],
            )

    return given.mapInArrow(run, schema_with(given, keep, "n_strict long, soft_terms array<string>, soft_weight double"))


def split_url(url):
    """Columns (host, path) of a URL column; both empty where there is no ``://``."""
    rest = F.expr("substring(_tm_u, locate('://', _tm_u) + 3)")
    has = F.coalesce(F.locate("://", F.col("_tm_u")) > 0, F.lit(False))
    host = F.when(has, lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def judge(
    df: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES, *, strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] | Mapping[str, float] = SOFT_TERMS, soft_limit: float = 2,
) -> DataFrame:
    """``df`` with ``host, path, rule, verdict, n_strict, soft_terms, soft_weight``.

    Columns of ``df`` with these names are replaced.
    """
    made = ("host", "path", "rule", "verdict", "n_strict", "soft_terms", "soft_weight")
    keep = [c for c in df.columns if c not in made or c == url_col]
    out = count_terms(df.select(*keep), url_col, strict, soft).withColumn("_tm_u", F.col(url_col).cast("string"))
    host, path = split_url("_tm_u")
    out = out.withColumns({"_tm_host": host, "_tm_path": path})
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        h = r.host.lower()
        fits = ((F.col("_tm_host") == h) | F.col("_tm_host").endswith("." + h)) & F.col("_tm_path").startswith(r.path)
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    method = F.when((F.col("n_strict") > 0) | (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    out = out.withColumns({
        "_tm_rule": F.lit(None).cast("string") if rule is None else rule,
        "_tm_verdict": method if verdict is None else F.coalesce(verdict, method),
    })
    return out.select(
        *[c for c in keep if c not in made],
        F.col("_tm_host").alias("host"), F.col("_tm_path").alias("path"), F.col("_tm_rule").alias("rule"),
        F.col("_tm_verdict").alias("verdict"), "n_strict", "soft_terms", "soft_weight",
    )


def oracle() -> str:
    """DuckDB SQL of the registered query, from the same fixed values."""
    def terms(xs):
        return "|".join(xs)

    edge = "(^|[^a-z0-9])({})($|[^a-z0-9])"
    rules = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for r, f in zip(rules, fits, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in zip(rules, fits, strict=True))
    soft = " + ".join(f"regexp_matches(lower(url), '{edge.format(t)}')::INT" for t in SOFT_TERMS)
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN regexp_matches(lower(url), '{edge.format(terms(STRICT_TERMS))}') OR {soft} >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
