"""Token-id files: Parquet with one list of ids a document, in ascending order of document id. Ids are dictionary-encoded
(delta-encoded where a chunk's dictionary would grow too large), row groups and pages have set sizes and carry page indexes,
so that a reader may fetch the lengths alone, or the ids of a range of documents, without touching the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm.common import slices, small, text_bytes, text_of
from threadweave.llm.tokens import encoder, with_end

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 32 << 20, 256 << 10, 2_000, 1 << 20
FILE = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


def encoded(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                ids, bounds = with_end(*encoder(path).encode(part.column("text"), *text_bytes(part.column("text"))), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                columns = [pa.array(np.full(part.num_rows, number, np.int32)), part.column("doc_id"), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), lists]
                before += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids"])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the texts and writes their ids to `path`.

    Texts, smaller than their ids, are what is shuffled: into ranges of document ids, encoded in order. A null text is
    empty and has the end id alone; a null id comes first; rows that share an id go by a hash of the text, so that very many of
    them can be split into ranges too, then by text. An empty table writes a file without rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    ranged = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    (
        ranged.select("doc_id", "text").mapInArrow(encoded(tokenizer, end_id), FILE)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .parquet(path)
    )


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens from the files' small columns; the ids are not read. start: ids of all documents before."""
    return _started(spark.read.schema(FILE).parquet(path).select("part", "doc_id", "local_start", "n_tokens"), spark, path)


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows with the start in the whole for that in the part. Parts go by number; there is one row of sums a part."""
    sums = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    firsts = sums.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS first")
    return rows.join(small(firsts), "part").withColumn("start", F.col("first") + F.col("local_start")).drop("part", "first", "local_start")


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """What write_tokens wrote, with start; filters on doc_id reach the page indexes."""
    return _started(spark.read.schema(FILE).parquet(path), spark, path).select(*columns)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        off, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids of read_tokens."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(summed, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
