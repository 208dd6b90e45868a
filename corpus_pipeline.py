"""From documents to packed training sequences, stage by stage. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadweave.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from threadweave.llm.common import scratch_path
from threadweave.llm.queries import WORD_BPE, table
from threadweave.llm.tokens import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts have their language's average and stay; a null language
    is one of its own; ties at the threshold stay; repeated rows are judged alike; an empty table stays empty."""
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id; of rows that share it, one. A null text is empty; a null
    id yields to any other; an empty table stays empty."""
    return exact_dedup.dedup_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by similarity, that of the smallest id. Documents without words all stay; rows
    that share the smallest id each do; an empty table stays empty."""
    return jaccard_join.one_of_each(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Each row is judged by itself; null and wordless texts stay; without items, or
    without documents, nothing changes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null text has the end id alone; repeated rows and null ids are packed like others; an
    empty table has no pieces."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A Kneser-Ney model and a tokenizer are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. Each stage's rows are written to the shared folder and read again as the next one's, so that a
    lost executor costs no finished stage. Other columns are carried through to the last stage, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
