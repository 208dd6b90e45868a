"""Union, deduplication, upserts, set differences and guards on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows by column name, with match_source naming the source; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("match_source", F.lit(n)) for n, d in sources.items()])


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in this order, which should be total. Spark prunes before the shuffle (group limit)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of greatest `at` of each key, by one aggregation without a sort; ties go to the greatest row."""
    rest = [c for c in df.columns if c not in keys and c != at]
    return df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("r")).select(*keys, "r.*").select(*df.columns)


def provenance(df: DataFrame, key: str) -> DataFrame:
    """key, match_source (sorted list of sources as text), n_sources."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("match_source")), ",").alias("match_source"), F.count_distinct("match_source").alias("n_sources"))


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_ids"), (F.count("*") - F.count_distinct(key)).alias("n_extra"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the first in this order."""
    new = first_by(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def key_differences(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with state missing (expected only), foreign (stored only) or repeated (stored more than once)."""
    have = stored.groupBy(*keys).agg(F.count("*").alias("n"))
    want = expected.select(*keys).distinct().withColumn("w", F.lit(True))
    both = want.join(have, keys, "full")
    state = F.when(F.col("w").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(*keys, state.alias("state")).where("state IS NOT NULL")


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Largest |a - b| over all keys; infinite if a side lacks a value that the other has."""
    both = a.select(*keys, F.col(col).alias("x")).join(b.select(*keys, F.col(col).alias("y")), keys, "full")
    gap = F.when(F.col("x").isNull() != F.col("y").isNull(), F.lit(float("inf"))).otherwise(F.abs(F.col("x") - F.col("y")))
    return both.agg(F.max(gap).alias("max_abs_diff"))


def one_value_guard(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """Groups that hold several values of a column that must be one (a configuration, a judge version)."""
    return df.groupBy(*group).agg(F.count_distinct(col).alias("n_values"), F.min(col).alias("least"), F.max(col).alias("greatest")).where("n_values > 1")


def same_group(by: list[str], mark: str = "__") -> Column:
    """Rows of one group, the other side's columns being marked; a null is a group."""
    return reduce(lambda a, b: a & b, [F.col(f"{mark}{c}").eqNullSafe(F.col(c)) for c in by], F.lit(True))


def beside(df: DataFrame, groups: DataFrame, by: list[str], *also: Column) -> DataFrame:
    """df with its group's columns of `groups`. Without groups that is one row, or as many as `also` tells apart by a range, which is
    broadcast; with groups Spark chooses by their size."""
    marked = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    on = reduce(lambda a, b: a & b, also, same_group(by))
    return df.join(marked if by else F.broadcast(marked), on).drop(*[f"__{c}" for c in by])


def ranges_of(df: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """df with __range, from 0: which of the ranges of its group, cut by approximate percentiles, the value is in."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("__cuts"))
    return beside(df, cuts, by).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def ranges_before(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """by, __r, __above, __in: each range's rows (a sum of n), and rows in lower ranges, of which there are some hundreds a group."""
    totals = counts.groupBy(*by, F.col("__range").alias("__r")).agg(F.sum(n).alias("__in"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return totals.withColumn("__above", F.coalesce(F.sum("__in").over(group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def running_counts(df: DataFrame, by: list[str], value: str, buckets: int = 200) -> DataFrame:
    """by, value, n, before: how often each value occurs in its group, and how many rows have a smaller one.

    Values go into ranges by approximate percentiles, so that a group of very many values is summed in many tasks: a window
    over each range, and the ranges' totals, of which there are at most `buckets` a group, on top."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = ranges_of(counts, by, value, buckets)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = beside(placed.withColumn("__inside", inside), ranges_before(placed, by, "n"), by, F.col("__range") == F.col("__r"))
    return out.select(*by, value, "n", (F.col("__above") + F.col("__inside")).alias("before"))


def percentiles_of(df: DataFrame, by: list[str], value: str, places: dict[str, Column], buckets: int = 48) -> DataFrame:
    """by, n and a percentile for each of `places`: a place counts from 0 in order of value and may lie between two (linear); it is an
    expression of the group's number of values, __size. Nulls don't count; a group without values has no row.

    By selection: rows are counted in ranges, and only the ranges that hold a wanted place are looked at value by value."""
    rows = ranges_of(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), by, "__v", buckets)
    ranges = ranges_before(rows.groupBy(*by, "__range").agg(F.count("*").alias("__n")), by, "__n")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranges = ranges.withColumn("__size", F.sum("__in").over(group))
    ends = [f(c) for c in places.values() for f in (F.floor, F.ceil)]
    wanted = ranges.where(F.exists(F.array(*ends), lambda k: (F.col("__above") <= k) & (k < F.col("__above") + F.col("__in"))))
    near = beside(rows, wanted, by, F.col("__range") == F.col("__r")).groupBy(*by, "__range", "__above", "__size", "__v").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("__before", F.col("__above") + before)
    at = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), F.col("__v")))
    parts = [x.alias(f"__{k}{name}") for name, c in places.items() for k, x in (("lo", at(F.floor(c))), ("hi", at(F.ceil(c))), ("part", F.max(c - F.floor(c))))]
    out = near.groupBy(*by).agg(F.max("__size").alias("n"), *parts)
    low, high, part = (lambda name, k=k: F.col(f"`__{k}{name}`") for k in ("lo", "hi", "part"))
    return out.select(*by, "n", *[F.when(part(x) == 0, low(x)).otherwise((1 - part(x)) * low(x) + part(x) * high(x)).alias(x) for x in places])


def share(p: float) -> Column:
    """The place of a percentile, for percentiles_of."""
    return (F.col("__size") - 1) * F.lit(p)
