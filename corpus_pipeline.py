"""The corpus pipeline: five operators, one after the other, over whole documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.

Defined cases, besides those of the operators: rows without text or without words stay in every stage that doesn't score
them below the threshold, and have no tokens; of rows that repeat an id and a text one stays, whichever, and with it its
other columns; a row whose text is cut to nothing stays with an empty text; an empty table stays empty; without labels
no document is rejected; other columns, whatever their names, are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandgrid.llm._common import drop_written, table, written
from strandgrid.llm.bpe import default_path
from strandgrid.llm.fm_decontamination import without_leaks
from strandgrid.llm.quality_classifier import keep_quality
from strandgrid.llm.signature_join import one_of_each
from strandgrid.llm.speculative_bpe import digests, encode_decode
from strandgrid.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier doesn't reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join connects."""
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return without_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows; those with windows of several items go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return digests(encode_decode(docs, default_path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("tokens", tokens)]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
