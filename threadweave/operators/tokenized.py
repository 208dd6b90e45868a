"""Tables of texts measured and cut by a tokenizer: lengths, filters by length, chunks, truncations and reports of them.

Each pass encodes a text once, in the task that reads it, and shuffles none; what is grouped afterwards are numbers. Rows that share an
id each count. `path` is the tokenizer's file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.functions.chunks import token_count, token_pieces
from threadweave.operators.tables import percentiles_of, share


def token_lengths(docs: DataFrame, keys: list[str], text: Column, path: str) -> DataFrame:
    """keys, n_tokens, n_chars. A null text has none of either."""
    return docs.select(*keys, token_count(text, path).alias("n_tokens"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"))


def within_tokens(docs: DataFrame, text: Column, path: str, limit: int) -> DataFrame:
    """The rows of docs whose text has at most `limit` tokens, with n_tokens. A text has no more tokens than bytes where each token
    stands for a byte at least, but that isn't so with every file, so all are encoded."""
    return docs.withColumn("n_tokens", token_count(text, path)).where(F.col("n_tokens") <= limit)


def length_report(lengths: DataFrame, by: list[str], limit: int) -> DataFrame:
    """by, n, mean, p50, p95, longest, n_above and pct_above (of more than `limit` tokens), chars_per_token (null without tokens).
    Percentiles are linear and exact. A null in `by` is a group."""
    n = F.col("n_tokens")
    above = F.count_if(n > limit)
    sums = lengths.groupBy(*by).agg(F.avg(n).alias("mean"), above.alias("n_above"), (100 * above / F.count("*")).alias("pct_above"), F.when(F.sum(n) > 0, F.sum("n_chars") / F.sum(n)).alias("chars_per_token"))
    places = percentiles_of(lengths, by, "n_tokens", {"p50": share(0.5), "p95": share(0.95), "longest": share(1.0)}).withColumnsRenamed({c: f"__{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return sums.join(places, on).select(*by, "n", "mean", "p50", "p95", F.col("longest").cast("bigint").alias("longest"), "n_above", "pct_above", "chars_per_token")


def chunk_rows(docs: DataFrame, keys: list[str], text: Column, path: str, limit: int) -> DataFrame:
    """keys, chunk (from 0), n_chunks, n_tokens, text: pieces of at most `limit` tokens, without
    overlap, that make up the text. An empty text has one empty piece."""
    pieces = docs.select(*keys, token_pieces(text, path, limit).alias("__p"))
    rows = pieces.select(*keys, F.size("__p").cast("bigint").alias("n_chunks"), F.posexplode("__p").alias("__at", "__piece"))
    return rows.select(*keys, F.col("__at").cast("bigint").alias("chunk"), "n_chunks", "__piece.n_tokens", "__piece.text")


def truncated(docs: DataFrame, keys: list[str], text: Column, path: str, limit: int) -> DataFrame:
    """keys, n_tokens (of the whole text), truncated, text: its first `limit` tokens."""
    pieces = docs.select(*keys, token_pieces(text, path, limit).alias("__p"))
    whole = F.aggregate("__p", F.lit(0).cast("bigint"), lambda s, p: s + p["n_tokens"])
    return pieces.select(*keys, whole.alias("n_tokens"), (F.size("__p") > 1).alias("truncated"), F.element_at("__p", 1)["text"].alias("text"))
