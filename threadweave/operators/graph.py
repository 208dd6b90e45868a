"""The typed graph: node and edge tables, weights, densification by tags, degrees, reachability, capped neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions.scalars import min_max
from threadweave.operators.tables import first_by
from threadweave.sources.files import kept

# Defaults of the densification steps.
MAX_DF, TAG_JACCARD, TAG_TOP_K, TAG_WEIGHT = 200, 0.6, 20, 0.6
#: Informative tags of an item up to which it is met by pairs of its tags.
FEW = 12


def thread_weights(answers: DataFrame, question: str, score: str) -> DataFrame:
    """answers with weight: the score's min-max over its thread, 0.5 where all are equal."""
    return answers.withColumn("weight", min_max(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), [question], 0.5))


def informative_tags(tagged: DataFrame, item: str, tag: str, max_df: int = MAX_DF) -> DataFrame:
    """Distinct (item, tag) of tags that at most max_df items carry."""
    one = tagged.select(item, tag).distinct()
    often = one.groupBy(tag).agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    return one.join(often, tag)


def pair_bound(informative: DataFrame, tag: str) -> DataFrame:
    """How many directed pairs the self-join of these tags can make at most: sum of df * (df - 1)."""
    return informative.select(tag, "df").distinct().agg(F.sum(F.col("df") * (F.col("df") - 1)).alias("max_pairs"))


def tag_cooccurrence(tagged: DataFrame, item: str, tag: str, max_df: int = MAX_DF, threshold: float = TAG_JACCARD, top_k: int = TAG_TOP_K, weight: float = TAG_WEIGHT, most_pairs: int | None = None) -> DataFrame:
    """src, dst, jaccard, weight: each item's top_k others by Jaccard of tag sets, at least `threshold`.

    Sets have all tags, pairs arise from informative ones. The cap on df bounds each join key's rows; where `most_pairs` is given, more
    pairs than that are an error. A row knows the sizes of its item's set (n) and of its informative part (m), so that nothing has to be
    joined after the counts. Pairs are made once (a < b) and turned round only after the filter.

    Most pairs of items with one tag in common need two or more for the threshold. Items of few informative tags (FEW) find those
    partners by two tags at once, which hardly any others have in common; by single tags only such pairs are made as one tag may
    suffice for, or as have an item of many tags."""
    sets = tagged.groupBy(item).agg(F.collect_set(tag).alias("__tags")).select(F.col(item).alias("a"), F.size("__tags").alias("n"), F.explode("__tags").alias("tag"))
    often = sets.groupBy("tag").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    short = kept(sets.join(often, "tag").select("a", "n", "tag", "df", F.count("*").over(Window.partitionBy("a")).alias("m")), "informative")
    if most_pairs is not None and (bound := short.agg(F.sum(F.col("df") - 1)).first()[0] or 0) > most_pairs:
        raise ValueError(f"up to {bound} pairs; lower max_df")
    short = short.select("tag", "a", "n", "m")
    other = lambda rows: rows.select("tag", F.col("a").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    needed = lambda n, nb: F.ceil(threshold * (n + nb) / (1 + threshold) - 1e-9)
    reachable = F.least("m", "mb") >= needed(F.col("n"), F.col("nb"))
    by_two = (needed(F.col("n"), F.col("nb")) >= 2) & (F.col("m") <= FEW) & (F.col("mb") <= FEW)
    wide, small = F.col("m") > FEW, needed(F.col("n"), F.lit(1)) < 2
    single, rest = short.where(small | wide), short.where(~small & ~wide)
    ones = single.join(other(single), "tag").where((F.col("a") < F.col("b")) & reachable & ~by_two).select("a", "b", "n", "nb")
    far = rest.join(other(short.where(wide)), "tag").where(reachable)
    far = far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("nb")).alias("n"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("n")).alias("nb"))
    common = ones.union(far).groupBy("a", "b", "n", "nb").agg(F.count("*").alias("k"))
    few = short.where(~wide & (F.col("m") > 1)).groupBy("a", "n").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    pairs = few.select("a", "n", "tags", F.posexplode("tags").alias("at", "tag")).select("tag", F.explode(F.slice("tags", F.col("at") + 2, FEW)).alias("and"), "a", "n")
    met = pairs.join(pairs.select("tag", "and", F.col("a").alias("b"), F.col("n").alias("nb")), ["tag", "and"]).where((F.col("a") < F.col("b")) & (needed(F.col("n"), F.col("nb")) >= 2))
    # k tags make k (k - 1) / 2 pairs
    twos = met.groupBy("a", "b", "n", "nb").agg(F.round((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("bigint").alias("k"))
    common = common.union(twos)
    scored = common.select("a", "b", (F.col("k") / (F.col("n") + F.col("nb") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= threshold)
    both = scored.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "jaccard"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "jaccard"))))
    return first_by(both, ["src"], [F.desc("jaccard"), "dst"], top_k).withColumn("weight", F.lit(weight))


def degrees(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """node, degree (edges at either end), zero for isolated nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(node)).groupBy(node).agg(F.count("*").alias("degree"))
    return nodes.select(node).join(ends, node, "left").select(node, F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_report(degree: DataFrame, most_isolated: float = 30.0, mean: float = 3.0, median: float = 1.0) -> DataFrame:
    out = degree.agg((100.0 * F.count_if(F.col("degree") == 0) / F.count("*")).alias("isolated_pct"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree"))
    return out.withColumn("ok", (F.col("isolated_pct") <= most_isolated) & (F.col("mean_degree") >= mean) & (F.col("median_degree") >= median))


def within_two(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node: all nodes one or two steps from each seed over undirected edges, the seed left out."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src")).distinct()
    one = seeds.select(F.col("node").alias("x"), F.col("node").alias("seed")).join(both, "x").select("seed", F.col("y").alias("node"))
    two = one.withColumnRenamed("node", "x").join(both, "x").select("seed", F.col("y").alias("node"))
    return one.union(two).where("seed <> node").distinct()


def capped_neighbours(edges: DataFrame, most: int) -> DataFrame:
    """Each src's `most` edges of greatest weight, ties to the smaller dst."""
    return first_by(edges, ["src"], [F.desc("weight"), "dst"], most)


def missing_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps (src, dst, edge_type) of explanation paths that no edge, in either direction, stands for."""
    both = edges.select("src", "dst", "edge_type").union(edges.select("dst", "src", "edge_type"))
    return paths.select("src", "dst", "edge_type").distinct().join(both, ["src", "dst", "edge_type"], "left_anti")


def gap_batches(df: DataFrame, by: list[str], at: str, seconds: int, width: int = 86_400) -> DataFrame:
    """df with batch: numbered from 1 in each group, a new one where more than `seconds` lie since the row before.

    A group is cut into ranges of `width` seconds, each a window of its own; the last row of the range before decides whether a
    range's first row begins a batch, and the ranges' numbers of batches, a row a range, are added up over the group. Rows of one
    moment are in one batch, whatever their order."""
    ts = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.withColumn("__t", ts).withColumn("__range", F.floor(ts / (width * 1_000_000)))
    group, inside = Window.partitionBy(*by), Window.partitionBy(*by, "__range").orderBy("__t")
    ends = rows.groupBy(*by, "__range").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(group.orderBy("__range")))
    far = lambda now, last: last.isNull() | (now - last > seconds * 1_000_000)
    begins = rows.withColumn("__prev", F.lag("__t").over(inside)).withColumn("__new", F.when(F.col("__prev").isNotNull() & far(F.col("__t"), F.col("__prev")), 1).otherwise(0))
    count = begins.groupBy(*by, "__range").agg(F.sum("__new").alias("__within"))
    ends = ends.join(count, [*by, "__range"]).withColumn("__opens", F.when(far(F.col("__first"), F.col("__before")), 1).otherwise(0))
    total = F.sum(F.col("__opens") + F.col("__within")).over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select(*by, "__range", (total - F.col("__within")).alias("__start"))
    out = begins.withColumn("__nth", F.sum("__new").over(inside.rangeBetween(Window.unboundedPreceding, 0))).join(ends, [*by, "__range"])
    return out.select(*df.columns, (F.col("__start") + F.col("__nth")).alias("batch"))
