"""Registered queries of tokens and chunks. A tokenizer is beyond SQL; tests compare them with the library, text by text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.functions.chunks import answer_text
from threadweave.operators import tokenized as K
from threadweave.plans.catalogue import QUERIES, query, r6, t  # noqa: F401
from threadweave.sources.files import kept

LIMIT, CHUNK, SHOWN = 2048, 256, 512


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def titled(spark, sf) -> DataFrame:
    """Documents as answers to a question that their source stands for."""
    d = t(spark, sf, "documents")
    return d.withColumn("answer", answer_text(F.col("source"), F.col("text")))


@query()
def token_length_report(spark, sf) -> DataFrame:
    """Lengths of all documents by language: exact percentiles, and how many are longer than a model's 2,048 tokens."""
    lengths = kept(K.token_lengths(t(spark, sf, "documents"), ["doc_id", "lang"], F.col("text"), tokenizer()), "lengths")
    out = K.length_report(lengths, ["lang"], LIMIT)
    return out.select("lang", "n", r6(F.col("mean"), "mean"), "p50", r6(F.col("p95"), "p95"), "longest", "n_above", r6(F.col("pct_above"), "pct_above"), r6(F.col("chars_per_token"), "chars_per_token"))


@query()
def documents_within_tokens(spark, sf) -> DataFrame:
    """Documents of which title and text have 2,048 tokens at most."""
    return K.within_tokens(titled(spark, sf), F.col("answer"), tokenizer(), LIMIT).select("doc_id", "n_tokens")


@query()
def document_chunks(spark, sf) -> DataFrame:
    """Every document's pieces of 256 tokens, each with its digest."""
    rows = K.chunk_rows(t(spark, sf, "documents"), ["doc_id"], F.col("text"), tokenizer(), CHUNK)
    return rows.select("doc_id", "chunk", "n_chunks", "n_tokens", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def truncated_answers(spark, sf) -> DataFrame:
    """Documents with their titles, cut after 512 tokens."""
    rows = K.truncated(titled(spark, sf), ["doc_id"], F.col("answer"), tokenizer(), SHOWN)
    return rows.select("doc_id", "n_tokens", "truncated", F.sha2("text", 256).alias("text_sha256"))
