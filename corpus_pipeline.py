"""A training corpus from ``documents``: five stages, each a written table.

Each stage works on all that the one before it kept.  A stage takes
``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet to the
shared folder and reread as the next one's ``docs``.  All but the last return the
columns of ``documents``.

Defined results, of every stage: an empty table stays empty; null and empty texts are kept as
they are (the mix takes documents without words in whole epochs only); texts of any length are
read whole; rows that repeat are rows of their own (near copies of each other, of which one
stays); null and repeated ids change nothing but which row of near copies stays; columns that
``documents`` does not have pass through whatever their names (the mix replaces those that
are named like its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.functions.tables import discard, materialize, scratch
from tracemill.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from tracemill.llm.common import table


def _few_texts_at_once(spark: SparkSession) -> None:
    """Texts go to Python 500 at a time: both sides keep whole batches, and what one
    stage's workers keep lasts into the next.  A smaller setting stays.  It is left so,
    as a stage's rows are made only when they are written, after the stage returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 500:
        spark.conf.set(key, "500")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go."""
    _few_texts_at_once(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of five-word Jaccard links of 0.8."""
    return jaccard_join.keep_one(docs, shingle=5, num=80, den=100)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    _few_texts_at_once(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind."""
    _few_texts_at_once(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix takes it, with its text."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark", cut_benchmark),
    ("personal data", mask_personal_data),
    ("mix", mix_sources),
]

#: SQL expresses neither the trained models nor the hashed draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            after = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
        discard(docs)  # nothing reads the stage before any more
        docs = after
    return docs
