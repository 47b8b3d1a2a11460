"""The training corpus pipeline: documents in, packed token sequences out.

Each stage works on all that its predecessor kept, takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes every stage's result to the folder in spark.checkpoint.dir and reads it again,
so a lost executor costs one stage's tasks at most.

Defined results: null and empty texts, and texts without a letter, have no language and go in the first stage; rows that share an id are
documents of their own; of equal rows one stays; an id may be null; a document of which nothing is left, or that holds any benchmark window, goes; texts of
any length are worked on whole; an empty table gives no rows in every stage. Other columns of `documents` are kept up to the last stage, whatever
their names, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heatgrid.llm import decontam, langid, minhash, substring
from heatgrid.llm.common import written
from heatgrid.llm.queries import packed_documents, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found (the network learns from three quarters of the labelled documents)."""
    learned = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    return langid.keep_identified(docs, langid.fit_language(learned))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows of 35 words out of the texts."""
    return substring.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packed_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: Models, tokenizers and similarity search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
