"""From raw documents to a training mix: language, near duplicates, benchmark leaks, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet into the shared folder and reads it again as the next one's input.

Rows with odd values: a null text, or one without a letter, has no language and leaves in the first stage, which also
replaces a null language. Documents whose id is null stay in all stages, for nothing tells them apart (near copies and leaks are
found by id); they are redacted and mixed like all others. Of equal rows one stays; rows of one id but other texts are judged apart.
Ties go to the smaller id, and to the language first in sorted order. Texts of any length are read whole. Null sources are a source of
their own. An empty table, of documents or of the benchmark, gives an empty result or drops nothing. Further columns of the documents,
whatever their names, are left out, so they can't clash with those that operators add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm import decontaminate, jaccard, langid, mixing, pii
from quadrill.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language is less probable than this are rejected, and so are those without any letter.
SURE = 0.35
#: Tokens of the mixture as a share of all tokens that reach it.
SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no recognised language; a missing label becomes the predicted one."""
    seen = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that 5-word shingles at 0.8 link."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a benchmark item contaminates."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; every document stays."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select each source's prefix of seeded epochs by hierarchical budgets."""
    return mixing.mix(docs.select(*COLUMNS), mixing.document_path(), mixing.WEIGHTS, share=SHARE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL can't express the recurrent network, so the rows are tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
