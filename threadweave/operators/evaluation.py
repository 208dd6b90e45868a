"""Evaluation of retrieval and judged answers: precision, reciprocal rank, panel votes, contingency, latency, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.tables import percentiles_of, share


def rank_metrics(items: DataFrame, query: str, rank: str, relevant: Column) -> DataFrame:
    """query, precision, reciprocal_rank (0 if nothing is relevant), n."""
    r = items.withColumn("__rel", F.coalesce(relevant, F.lit(False)))
    return r.groupBy(query).agg(F.count("*").alias("n"), F.avg(F.col("__rel").cast("double")).alias("precision"), F.coalesce(1.0 / F.min(F.when(F.col("__rel"), F.col(rank))), F.lit(0.0)).alias("reciprocal_rank"))


def panel_vote(votes: DataFrame, item: str, level: str) -> DataFrame:
    """item, n_votes, verdict: of ordinal votes the median; of two that differ the more severe (greater); null votes don't count."""
    v = votes.where(F.col(level).isNotNull()).groupBy(item).agg(F.sort_array(F.collect_list(level)).alias("__v"))
    middle = (F.floor(F.size("__v") / 2) + 1).cast("int")
    return v.select(item, F.size("__v").cast("bigint").alias("n_votes"), F.element_at("__v", middle).alias("verdict"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, p50 and p95 (linear), max_value, p95_nearest (the value of rank round(0.95 n), half to even, at least 1)."""
    nearest = F.greatest(F.lit(1), F.bround(F.col("__size") * 0.95).cast("bigint")) - 1
    return percentiles_of(df, by, value, {"p50": share(0.5), "p95": share(0.95), "max_value": share(1.0), "p95_nearest": nearest})


def outliers(df: DataFrame, by: list[str], value: str, ratio: float = 0.5) -> DataFrame:
    """df with outlier: below `ratio` of the group's greatest value, in groups of two or more."""
    w = Window.partitionBy(*by)
    return df.withColumn("outlier", (F.count("*").over(w) >= 2) & (F.col(value) < ratio * F.max(value).over(w)))


def binned(df: DataFrame, value: str) -> DataFrame:
    """df with bin: zero apart, the others by quartiles of all values above zero."""
    q = percentiles_of(df.where(F.col(value) > 0), [], value, {f"__q{k}": share(k / 4) for k in (1, 2, 3)}).drop("n")
    v = F.col(value)
    name = F.when(v <= 0, "zero").when(v <= F.col("__q1"), "q1").when(v <= F.col("__q2"), "q2").when(v <= F.col("__q3"), "q3").otherwise("q4")
    return df.join(F.broadcast(q), F.lit(True), "left").withColumn("bin", name).drop("__q1", "__q2", "__q3")
