"""Samples by hash order: seeded and repeatable, nested (a smaller one is a prefix of a larger one), with disjoint slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions.scalars import hash_order
from threadweave.operators.tables import first_by


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with their place in the permutation, from 1. Spark sorts only n rows a task."""
    top = df.withColumn("__h", hash_order(seed, key)).orderBy("__h", key).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("__h", key)).cast("bigint")).drop("__h")


def slices(df: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Disjoint consecutive slices of the permutation, named in column slice."""
    out, start = sample(df, key, sum(sizes.values()), seed), 0
    name = F.lit(None).cast("string")
    for k, n in sizes.items():
        name, start = F.when((F.col("place") > start) & (F.col("place") <= start + n), k).otherwise(name), start + n
    return out.withColumn("slice", name)


def stratified(df: DataFrame, key: str, strata: list[str], quota: int, total: int, seed: int = 42) -> DataFrame:
    """`quota` rows of each stratum (all it has, if fewer), topped up from the rest in hash order to `total`."""
    rows = df.withColumn("__h", hash_order(seed, key))
    chosen = first_by(rows, strata, ["__h", key], quota)
    rest = rows.join(chosen.select(key), key, "left_anti")
    both = chosen.withColumn("topped_up", F.lit(False)).unionByName(rest.withColumn("topped_up", F.lit(True)))
    return both.orderBy("topped_up", "__h", key).limit(total).drop("__h")


def even_split(groups: DataFrame, group: str, total: int) -> DataFrame:
    """group, quota: total in equal parts, the remainder to the first groups in order."""
    g = groups.select(group).distinct()
    n = g.count()
    place = F.row_number().over(Window.orderBy(group))
    return g.select(group, (F.lit(total // max(1, n)) + F.when(place <= total % max(1, n), 1).otherwise(0)).cast("bigint").alias("quota"))


def guaranteed(df: DataFrame, key: str, label: str, group: str, least: dict[str, int], total: int, seed: int = 42) -> DataFrame:
    """At least so many rows of each label (all, if it has fewer), drawn evenly over groups, then rows of any label, evenly over
    groups again, up to `total`. Guarantees are kept even where they add up to more."""
    rows = df.withColumn("__h", hash_order(seed, key))
    turn = F.row_number().over(Window.partitionBy(label, group).orderBy("__h", key))
    wanted = reduce(lambda c, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(c), least.items(), F.lit(0))
    # by turns: the groups' first rows, then their second ones
    place = F.row_number().over(Window.partitionBy(label).orderBy("__turn", group, key))
    chosen = rows.withColumn("__turn", turn).withColumn("__place", place).where(F.col("__place") <= wanted).select(*df.columns, "__h")
    rest = rows.join(chosen.select(key), key, "left_anti").withColumn("__turn", F.row_number().over(Window.partitionBy(group).orderBy("__h", key)))
    free = F.greatest(F.lit(0), F.lit(total) - F.count("*"))
    left = rest.orderBy("__turn", group, key).limit(total).withColumn("__n", F.row_number().over(Window.orderBy("__turn", group, key)))
    left = left.join(F.broadcast(chosen.agg(free.alias("__free"))), F.col("__n") <= F.col("__free"))
    return chosen.select(*df.columns, F.lit(True).alias("guaranteed")).unionByName(left.select(*df.columns, F.lit(False).alias("guaranteed")))


def out_of_place(frozen: DataFrame, df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """key, expected, place: rows of a stored sample (key, place) that aren't at that place of the permutation now; none, if it holds."""
    now = sample(df, key, n, seed).select(key, F.col("place").alias("__now"))
    return frozen.join(now, key, "full").where(~F.col("place").eqNullSafe(F.col("__now"))).select(key, F.col("place").alias("expected"), F.col("__now").alias("place"))


def shuffled(items: Column, seed: int, key: Column) -> Column:
    """An array of texts in a seeded order of its key's own."""
    rank = lambda x: F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), x))
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(rank(x).alias("h"), x.alias("x")))), lambda s: s["x"])


def beyond(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows but the first n of the permutation: a pool to draw donors from that no test row is in."""
    return df.join(sample(df.select(key).distinct(), key, n, seed).select(key), key, "left_anti")
