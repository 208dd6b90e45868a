"""Judged batches of a stream: results, failures and resolutions that survive a restart at any point.

A batch writes three folders that carry its number. Should the driver stop between them, Spark hands out the same batch again, and
what it had written is replaced; what other batches wrote is never touched. Failures stay where they are: an item that fails and
is judged later has a row in each of the three tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadweave.sources.files import file_system

RESULTS, FAILURES, RESOLVED = "results", "failures", "resolved"


def stored(like: DataFrame, path: str, kind: str) -> DataFrame:
    """The rows of a kind (columns of `like`, and batch), none if there is no such folder yet."""
    fs, as_path = file_system(like, path)
    schema = ", ".join(f"`{c}` {t}" for c, t in like.dtypes) + ", batch bigint"
    spark = like.sparkSession
    return spark.read.schema(schema).parquet(f"{path}/{kind}") if fs.exists(as_path(f"{path}/{kind}")) else spark.createDataFrame([], schema)


def settle(judged: DataFrame, batch: int, path: str, keys: list[str], answer: str) -> None:
    """Writes a batch: rows with an answer are results, others failures. What an earlier batch has a result for isn't stored again, of
    rows with one key one is; a result whose key failed in an earlier batch or in this one is a resolution."""
    judged = judged.persist()
    try:
        before = lambda kind: stored(judged, path, kind).where(F.col("batch") < batch).select(*keys).distinct()
        fresh = judged.join(before(RESULTS), keys, "left_anti")
        results = fresh.where(F.col(answer).isNotNull()).dropDuplicates(keys)
        failures = fresh.where(F.col(answer).isNull()).dropDuplicates(keys)
        failed = before(FAILURES).unionByName(failures.select(*keys)).distinct()
        for kind, rows in ((RESULTS, results), (FAILURES, failures), (RESOLVED, results.join(failed, keys, "left_semi"))):
            write_batch(rows, f"{path}/{kind}/batch={batch}")
    finally:
        judged.unpersist()


def write_batch(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def open_failures(like: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """keys that failed and have no result in any batch: what a retry would take."""
    return stored(like, path, FAILURES).select(*keys).distinct().join(stored(like, path, RESULTS), keys, "left_anti")


def pending(items: DataFrame, like: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """items without a result, failed ones among them."""
    return items.join(stored(like, path, RESULTS).select(*keys).distinct(), keys, "left_anti")


def judge_stream(items: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str], answer: str) -> StreamingQuery:
    """Judges what there is of a stream, batch by batch, and stops; a restart with the same checkpoint goes on where it was."""
    run = items.writeStream.foreachBatch(lambda rows, batch: settle(judge(rows), batch, path, keys, answer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, so many of them a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)
