"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, then token ids.

Each stage takes the documents that its predecessor kept and returns the columns of ``documents``, the last one the
digests of the encoded texts. Stages are written as Parquet to the shared folder and read again, so that each starts
from files that outlive executors.

Defined cases, for all stages: an empty ``documents`` table gives no rows, with the columns of each stage; null and empty
texts are kept by all but the exact dedup, which keeps one of them; further columns of ``documents``, whatever their
names, pass through the filters unread. Filters address rows by doc_id: rows that share one stay if any of them is kept,
and rows without one stay, but for what a stage says below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from quirefold.llm.common import materialize
from quirefold.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts above their language's quantile of perplexity; without labels, or trusted text of a language, none."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts; repeated rows of one doc_id and text all stay."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of texts that link, directly or by others; texts without words all stay."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with a window of eight consecutive words of one benchmark item, or with two items of any length."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, repeated ones and those without an id included."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", token_ids),
]

#: The language model of the first stage is beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
