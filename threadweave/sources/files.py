"""Readers and writers. Readers take an explicit schema and keep malformed rows apart instead of failing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None, lines_in_fields: bool = True) -> DataFrame:
    """Rows of CSV files with a header; unfit rows are skipped, or kept in column `corrupt`. lines_in_fields: fields may have line breaks, so
    that a file is one task; without it, large files are split."""
    reader = spark.read.option("header", True).option("multiLine", lines_in_fields).option("escape", '"')
    if corrupt:
        return reader.option("columnNameOfCorruptRecord", corrupt).schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(path)
    return reader.option("mode", "DROPMALFORMED").schema(schema).csv(path)


def read_xml_rows(spark: SparkSession, path: str, attributes: dict[str, str], required: list[str]) -> DataFrame:
    """`<row a=".." b=".."/>` elements: the named attributes with their types; rows that lack a required one are dropped."""
    schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in attributes])
    rows = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    return rows.select(*[F.expr(f"try_cast(`_{k}` AS {t})").alias(k) for k, t in attributes.items()]).dropna(subset=required)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Post links of the kinds 1 (Linked) and 3 (Duplicate)."""
    rows = read_xml_rows(spark, path, {"PostId": "bigint", "RelatedPostId": "bigint", "LinkTypeId": "bigint", "CreationDate": "string"}, ["PostId", "RelatedPostId", "LinkTypeId"])
    return rows.where(F.col("LinkTypeId").isin(1, 3)).withColumn("link_type_label", F.when(F.col("LinkTypeId") == 1, "Linked").otherwise("Duplicate"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; bad or torn lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_latency_log(spark: SparkSession, path: str) -> DataFrame:
    """`[latency] cond=B Id=12 retrieval_sec=0.3 ...` lines: cond, id, retrieval_sec, generation_sec, end_to_end_sec."""
    lines = spark.read.text(path).where(F.col("value").contains("[latency]"))

    def field(name: str, kind: str) -> F.Column:
        return F.nullif(F.regexp_extract("value", rf"\b{name}=([^\s]+)", 1), F.lit("")).cast(kind)

    return lines.select(field("cond", "string").alias("cond"), field("Id", "bigint").alias("id"), *[field(n, "double").alias(n) for n in ("retrieval_sec", "generation_sec", "end_to_end_sec")])


def preview(df: DataFrame) -> DataFrame:
    """A row a column: its type, its nulls, all rows; one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return counts.unpivot(["rows"], df.columns, "column", "nulls").withColumn("type", kinds[F.col("column")])


def file_system(df: DataFrame, path: str):
    """The Hadoop file system of a path, and a function that makes paths."""
    spark = df.sparkSession
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), as_path


def overwrite_verified(df: DataFrame, path: str, backup: str) -> int:
    """Replaces the Parquet table at `path`: the rows are written aside, counted against df's, and only then take its place; what was
    there goes to `backup`, which must not exist. Returns the rows. Should the new table not take its place, the old one is put back."""
    spark = df.sparkSession
    new = f"{path}.new"
    df.write.mode("overwrite").parquet(new)
    n, want = spark.read.parquet(new).count(), df.count()
    if n != want:
        raise ValueError(f"{new} has {n} rows instead of {want}")
    fs, as_path = file_system(df, path)
    if fs.exists(as_path(backup)):
        raise FileExistsError(backup)
    had = fs.exists(as_path(path))
    if had and not fs.rename(as_path(path), as_path(backup)):
        raise OSError(f"{path} could not be moved to {backup}")
    if not fs.rename(as_path(new), as_path(path)):
        if had:
            fs.rename(as_path(backup), as_path(path))
        raise OSError(f"{new} could not be moved to {path}")
    return n


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends as JSON lines only rows whose key isn't stored yet, so that a broken-off run can be repeated."""
    fs, as_path = file_system(df, path)
    if fs.exists(as_path(path)):
        done = df.sparkSession.read.schema(df.select(*keys).schema).option("mode", "DROPMALFORMED").json(path)
        df = df.join(done, keys, "left_anti")
    df.dropDuplicates(keys).write.mode("append").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session has to name; local sessions, as in tests, get a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for a table that a query uses several times."""
    path = f"{shared_folder(df.sparkSession)}/threadweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overwrite_parts(df: DataFrame, path: str, by: str) -> None:
    """Writes df as a Parquet table with a folder for each value of `by`; of a table that is there, only values that df has are replaced."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_part(df: DataFrame, path: str, by: str, value: str) -> DataFrame:
    """The rows of one value, which are all that is read; df: any table with the columns that were written."""
    return df.sparkSession.read.schema(df.schema).parquet(path).where(F.col(by) == value)


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Columns that a table should have and lacks, in the order asked for."""
    return [c for c in needed if c not in df.columns]


def reputations(spark: SparkSession, parquet: str, csv: str, wanted: DataFrame) -> DataFrame:
    """id, reputation of the users asked for (id): from the Parquet table if it is there, else from the CSV file (columns Id and
    Reputation), else of nobody."""
    there = lambda path: (lambda fs, as_path: fs.exists(as_path(path)))(*file_system(wanted, path))
    if there(parquet):
        users = spark.read.parquet(parquet).select(F.col("id").cast("bigint").alias("id"), F.col("reputation").cast("bigint").alias("reputation"))
    elif there(csv):
        users = spark.read.option("header", True).csv(csv).select(F.expr("try_cast(Id AS bigint)").alias("id"), F.expr("try_cast(Reputation AS bigint)").alias("reputation"))
    else:
        users = spark.createDataFrame([], "id bigint, reputation bigint")
    return users.join(wanted.select("id").distinct(), "id", "left_semi")
