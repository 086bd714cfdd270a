"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage works on all that the one before kept; all but the last return the columns of ``documents``. Between stages the rows
are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import exact_dedup, jaccard, mixing, packing, quality
from corvid.llm.common import release, saved, table, workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go: those whose score is below 0.3.

    Null and empty texts are scored like any other; equal texts share their fate; an empty table stays one. Without labels all
    documents score 0.5 and stay. Columns pass through, whatever their names.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays: the longest, then the smallest doc_id.

    Null counts as empty, so of null and empty texts one stays. Rows that are the same in doc_id and text stay or go together.
    """
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays: shingles of five words, similarity 0.8.

    Documents without words link with nothing and stay; so do rows without doc_id.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics approach their target shares; null source and language are a
    share of their own. The draw depends on doc_id and the shares alone."""
    return mixing.sampled(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, neighbours together: a row for each piece; null and empty texts have the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("packing", curve_packing),
]

#: SQL can express neither the trained classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage wrote for itself is deleted once its rows are written, and so are the rows of the
    stage before; the last stage's own tables stay, as its result reads them."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with workspace():
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
