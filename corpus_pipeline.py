"""A corpus pipeline over ``documents``: good texts, one of each group of near
duplicates, without repeats, not in the benchmark, encoded.

Each stage takes all rows that its predecessor kept. A stage's result is
written as Parquet and read again as the next one's ``docs``.

Defined cases, by stage: null and empty texts are scored by the first stage as any
other, stand alone in the second (each is kept), pass the third and fourth unchanged,
and have null (empty) ids in the last. Rows without doc_id are scored, kept by the
second, count as one document behind all others in the third. Repeated rows of one
doc_id are one document in the second, so one of them stays; ties there go to the
smallest text. Very long texts are taken whole by every stage, in slices of their own.
Extra columns are carried by all stages but the last, whatever their names; an empty
table gives empty results; without labels every document is good, without a benchmark
none is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import op1_decontaminate, op4_quality, op6_repeats, op9_minhash, op10_sentencepiece
from loanlens.llm.common import read_table
from loanlens.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these texts and ``labels``, scores 0.7 or more."""
    return op4_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return op9_minhash.dedup(docs, op9_minhash.NEAR_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; bytes of repeats of 50 bytes or more that a smaller doc_id holds are cut out."""
    return op6_repeats.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth stand in benchmark windows."""
    return op1_decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, and whether decoding gives the text back."""
    return op10_sentencepiece.encoding_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: A trained classifier and hashed candidates: not SQL. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to and read from the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{spark._jvm.java.util.UUID.randomUUID()}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
