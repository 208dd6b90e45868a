"""Token counts through a cache keyed by content digest and tokenizer-version digest: a table is joined with the stored counts,
only distinct contents without a count are encoded, and their counts are appended to the cache.

Normalisation of content is null to empty and nothing else, since anything more could change a count."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.common import slices, text_bytes, text_of, written
from threadweave.llm.tokens import encoder

CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file and of the library that reads it."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(kind).__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{kind} {version}".encode()).hexdigest()


def counted(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                if path.endswith(".model"):
                    import sentencepiece

                    sp = sentencepiece.SentencePieceProcessor(model_file=path)
                    n = np.array([len(x) for x in sp.encode(column.to_pylist(), num_threads=1)], np.int64)
                else:
                    n = np.diff(encoder(path).encode(column, *text_bytes(column))[1])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return count


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """Stored counts of this tokenizer, each digest once (two writers may have counted the same text); None: no cache yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: a file, .json (tokenizers) or .model (sentencepiece). cache: a path that Spark can read and write; it is made
    when missing. A null text counts as empty, which has no tokens. Repeated rows and ids each have their row, a null id too;
    an empty table gives an empty result; other columns are ignored."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    stored = read_cache(spark, cache, version)
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]) if stored is None else keyed.select("digest", "text").join(stored, "digest", "left_anti").dropDuplicates(["digest"])
    misses.mapInArrow(counted(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    # written, so that a digest that very many rows share can be split in the join: no aggregation lies before it
    stored = written(read_cache(spark, cache, version), "counts")
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sized.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
