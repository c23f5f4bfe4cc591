"""A corpus pipeline in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs; all but the last return the
columns of documents.

1. quality_rules: documents that the distribution rules reject go.
2. simhash: one document of each group of near copies (five-word shingles, Jaccard similarity
   of 0.8) stays, the one with the smallest id.
3. suffix_dedup: passages that start in a document with a smaller id are taken out of the
   others' texts, in whole characters; `n_chars` follows. Documents stay, emptied ones too.
4. mixing: documents are taken as often as their source's target says, in whole documents.
5. packing: one row per piece of a document, placed into sequences of 1024 tokens.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are
handled as each operator's module states. There is no SQL for the whole: the stages hash,
tokenize and pack in ways that SQL cannot express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velarium.llm._common import table, written
from velarium.llm.mixing import mixed
from velarium.llm.packing import pack_documents, public_byte_bpe
from velarium.llm.quality_rules import quality_filter
from velarium.llm.simhash import keep_one
from velarium.llm.suffix_dedup import remove_passages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, **public_byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash", simhash),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
