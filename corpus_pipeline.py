"""A corpus pipeline of five stages, each made of one operator of skein.llm.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import cut, sweep, table, written
from skein.llm.decontaminate import clean
from skein.llm.exact_dedup import unique_documents
from skein.llm.jaccard_join import one_of_each
from skein.llm.packing import pack
from skein.llm.quality import accepted
from skein.llm.queries import public_tokenizer

PACK_TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return unique_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in token sequences."""
    return pack(docs, public_tokenizer(PACK_TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(docs, since)  # what this stage no longer needs, the output of the one before included
    return STAGES[-1][1](spark, docs, sf_dir)
