"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mixture, retrieval packing.

Each stage takes the documents that its predecessor kept and returns the columns of documents, the last one the packed
pieces with their ids. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import materialize
from evigrid.llm.line_dedup import dedup_lines
from evigrid.llm.mixing import mixed_documents
from evigrid.llm.ngram_join import drop_near_duplicates
from evigrid.llm.packing import pack_by_retrieval
from evigrid.llm.queries import tokenizer_files, toxic_model
from evigrid.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model learns from the labelled documents of sf_dir outside the held-out fold.
    Null texts stay; columns other than those of documents are left behind here."""
    return drop_toxic(docs.select(*COLUMNS), toxic_model(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the largest doc_id alone; every document stays."""
    out = dedup_lines(docs, keep=COLUMNS)
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link at a similarity of 0.8 or more, the one with the smallest doc_id stays. Documents
    without words all stay; of rows equal in id and text one stays; a null doc_id comes after all others."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a last partial time with the words that it takes."""
    out = mixed_documents(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, each filled with lexical neighbours of its first document. A null text is the end id alone;
    repeated rows and null ids are documents like others."""
    return pack_by_retrieval(docs, **tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("source_mix", source_mix), ("packing", packing),
]

#: Compression distances and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
