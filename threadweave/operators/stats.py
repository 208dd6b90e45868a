"""Agreement, effect size and test statistics as aggregations; results are one row or one row a group.

Statistics that are undefined (no variance, one category) are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.tables import running_counts


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n over the full grid of categories seen on either side."""
    seen = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cats = seen.select(F.explode(F.array(a, b)).alias("c")).distinct()
    grid = F.broadcast(cats.agg(F.collect_set("c").alias("cs"))).select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b"))
    counts = seen.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Cohen's kappa with linear weights 1 - |a - b| / (levels - 1) over ordinals from 0; two levels give the plain kappa."""
    m = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows = F.broadcast(m.groupBy("a").agg(F.sum("n").alias("ra")))
    cols = F.broadcast(m.groupBy("b").agg(F.sum("n").alias("cb")))
    # the margins have a row a level, so every pair of levels is a handful of rows
    total = m.agg(F.sum("n").alias("t"), F.sum(F.col("n") * (1 - F.abs(F.col("a") - F.col("b")) / (levels - 1))).alias("agree"))
    pairs = rows.withColumn("j", F.lit(1)).join(cols.withColumn("j", F.lit(1)), "j")
    chance = pairs.agg(F.sum(F.col("ra") * F.col("cb") * (1 - F.abs(F.col("a") - F.col("b")) / (levels - 1))).alias("chance"))
    both = total.withColumn("j", F.lit(1)).join(F.broadcast(chance.withColumn("j", F.lit(1))), "j")
    po, pe = F.col("agree") / F.col("t"), F.col("chance") / (F.col("t") * F.col("t"))
    return both.select(F.col("t").cast("bigint").alias("n"), po.alias("p_observed"), pe.alias("p_chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Over items with equally many ratings (the most frequent number of them, in practice all)."""
    counts = ratings.groupBy(item, label).agg(F.count("*").cast("double").alias("k"))
    per = counts.groupBy(item).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    observed = per.agg(F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("t"))
    share = counts.groupBy(label).agg(F.sum("k").alias("c"))
    both = share.withColumn("j", F.lit(1)).join(F.broadcast(observed.withColumn("j", F.lit(1))), "j")
    out = both.groupBy("po").agg(F.sum((F.col("c") / F.col("t")) * (F.col("c") / F.col("t"))).alias("pe"))
    return out.select("po", "pe", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def krippendorff_nominal(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """1 - observed / expected disagreement from label counts of each item with two ratings or more; no pairs are made."""
    counts = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").cast("double").alias("k"))
    per = counts.groupBy(item).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq")).where("m > 1")
    used = counts.join(per.select(item), item, "left_semi").groupBy(label).agg(F.sum("k").alias("c"))
    observed = per.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d_o"), F.sum("m").alias("n"))
    expected = used.agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    both = observed.withColumn("j", F.lit(1)).join(F.broadcast(expected.withColumn("j", F.lit(1))), "j")
    d_o, d_e = F.col("d_o") / F.col("n"), (F.col("n") * F.col("n") - F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return both.select(F.col("n").cast("bigint").alias("n"), F.when(d_e > 0, 1 - d_o / d_e).alias("alpha"))


def krippendorff_ordinal(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """The same for labels with an order, their own. The ordinal distance of two labels is that of their mid-ranks among all
    ratings, so both disagreements are sums of squares of mid-ranks (as shares, around their mean); no pairs are made."""
    counts = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").cast("double").alias("k"))
    used = counts.withColumn("m", F.sum("k").over(Window.partitionBy(item))).where("m > 1")
    # a row a label
    every = Window.partitionBy(F.lit(1))
    share = used.groupBy(label).agg(F.sum("k").alias("c")).withColumn("n", F.sum("c").over(every))
    placed = share.select(label, "c", "n", ((F.sum("c").over(every.orderBy(label)) - F.col("c") / 2) / F.col("n") - 0.5).alias("r"))
    ranked = used.join(placed.select(label, "r"), label)
    per = ranked.groupBy(item).agg(F.first("m").alias("m"), F.sum(F.col("k") * F.col("r")).alias("s"), F.sum(F.col("k") * F.col("r") * F.col("r")).alias("q"))
    observed = per.agg(F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("d_o"))
    expected = placed.agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("r")).alias("s"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("q"))
    both = observed.withColumn("j", F.lit(1)).join(F.broadcast(expected.withColumn("j", F.lit(1))), "j")
    d_o, d_e = F.col("d_o") / F.col("n"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return both.select(F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), F.when(d_e > 1e-15, 1 - d_o / d_e).alias("alpha"))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with rank: ties share the mean of their ranks. Ranks come from counts of distinct values, summed in ranges."""
    placed = running_counts(df, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    return df.join(placed, [*by, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), [], x).withColumnRenamed("rank", "rx")
    both = average_ranks(both, [], y).withColumnRenamed("rank", "ry")
    return both.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """n1, n2, u1 (of rows where `group` holds), cliffs_delta = 2 * u1 / (n1 * n2) - 1 and its size; from ranks, not from pairs."""
    r = average_ranks(df.where(F.col(value).isNotNull()).select(value, group.alias("g")), [], value)
    s = r.agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2"), F.sum(F.when(F.col("g"), F.col("rank"))).alias("r1"))
    s = s.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    delta = F.when((F.col("n1") > 0) & (F.col("n2") > 0), 2 * F.col("u1") / (F.col("n1") * F.col("n2")) - 1)
    return s.select("n1", "n2", "u1", delta.alias("cliffs_delta")).withColumn("magnitude", cliffs_size(F.col("cliffs_delta")))


def cliffs_size(delta: Column) -> Column:
    # fixed values: the bands' limits
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").when(size.isNotNull(), "large")


def wilcoxon(df: DataFrame, diff: Column) -> DataFrame:
    """Signed ranks of nonzero differences: n, w_plus, w_minus, z (normal approximation without continuity correction)."""
    d = df.select(diff.alias("d")).where("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).alias("up"))
    s = average_ranks(d, [], "m").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("up"), F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(~F.col("up"), F.col("rank"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")  # the cube of some millions is beyond a bigint
    return s.withColumn("z", F.when(n > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def paired_outcomes(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The four cells of two paired yes/no outcomes, the rate difference, and McNemar's exact two-sided p."""
    s = df.select(a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL").agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("only_a"), F.count_if(F.expr("NOT a AND b")).alias("only_b"), F.count_if(F.expr("NOT a AND NOT b")).alias("neither"))
    total = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    s = s.withColumn("rate_difference", (F.col("only_a") - F.col("only_b")) / total)
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log-binomial terms from running sums of logs
    terms = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.exp(log_choose(n, i) - n * F.log(F.lit(2.0))))
    return s.withColumn("p_exact", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda x, y: x + y))))


def log_choose(n: Column, k: Column) -> Column:
    zero = F.lit(0.0)
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, lambda s, i: s + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def holm(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """df with p_holm: step-down adjusted p, running maximum in order of p."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(p, *[c for c in df.columns if c not in (*by, p)])
    m = F.count("*").over(w)
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(ordered) + 1))
    return df.withColumn("__raw", raw).withColumn("p_holm", F.max("__raw").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def point_biserial(df: DataFrame, by: list[str], value: str, flag: Column) -> DataFrame:
    """n, n_flagged and Pearson's r of a number with a yes/no; null below three rows or without variance."""
    x, y = F.col(value).cast("double"), F.col("__y")
    rows = df.withColumn("__y", flag.cast("double")).where(F.col(value).isNotNull() & F.col("__y").isNotNull())
    fine = (F.count("*") >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("n_flagged"), F.when(fine, F.corr(x, y)).alias("r"))
