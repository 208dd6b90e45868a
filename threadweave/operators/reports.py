"""Reports over runs, judges and histories: distributions, fixed orders, verdicts on sets, differences, and changes that can be taken back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.tables import first_by, percentiles_of, same_group, share
from threadweave.operators.judging import ABSTAIN, FACTUAL, FULLY, PARTLY, UNRESOLVED, UNSPECIFIED, judge_pairs, known_label, ratio


def distribution(df: DataFrame, col: str, none: str = "(none)") -> DataFrame:
    """value (`none` for null), n, pct of all rows."""
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(none)).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("value", "n", (100 * F.col("n") / F.col("total")).alias("pct"))


def tag_count(tags: Column) -> Column:
    """How many tags a text such as `<a><b>` has."""
    return F.length(tags) - F.length(F.replace(tags, F.lit("<"), F.lit("")))


def positive_percentile(df: DataFrame, col: str, p: float) -> DataFrame:
    """One row: the percentile (linear); the query fails where it isn't above 0, as nothing could be scaled by it."""
    top = percentiles_of(df, [], col, {"top": share(p)}).agg(F.max("top").alias("top"))
    return top.select(F.when(F.col("top") > 0, F.col("top")).otherwise(F.raise_error(F.lit(f"percentile of {col} is not above 0")).cast("double")).alias("top"))


def profile(df: DataFrame, by: list[str], col: str, ps: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95), above: float | None = None) -> DataFrame:
    """n, mean, percentiles and the share above a limit, by group."""
    over = [] if above is None else [(100 * F.avg((F.col(col) > above).cast("double"))).alias("pct_above")]
    means = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), *over)
    names = {f"p{round(100 * p)}": share(p) for p in ps}
    found = percentiles_of(df, by, col, names).drop("n").withColumnsRenamed({c: f"__{c}" for c in by})
    return means.join(found if by else F.broadcast(found), same_group(by), "left").select(*by, "n", "mean", *names, *["pct_above"] * len(over))


def metric_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, metric, n, mean, median: a row a metric; nulls don't count."""
    long = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value")
    return profile(long, [*by, "metric"], "value", (0.5,)).withColumnRenamed("p50", "median")


def judge_shares(votes: DataFrame) -> DataFrame:
    """judge, label (failed for null), n, pct: failed calls stay in the denominator."""
    counts = votes.groupBy("judge", F.coalesce("label", F.lit("failed")).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("judge")))


def pairwise_kappa(votes: DataFrame) -> DataFrame:
    """judge_a, judge_b, n, kappa: Cohen's kappa of each pair over items that both judged; null where it is undefined."""
    p = judge_pairs(votes).groupBy("judge_a", "judge_b", "label_a", "label_b").agg(F.count("*").cast("double").alias("c"))
    key = ["judge_a", "judge_b"]
    total = p.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("c")).otherwise(0.0)).alias("same"))
    a = p.groupBy(*key, F.col("label_a").alias("label")).agg(F.sum("c").alias("x"))
    b = p.groupBy(*key, F.col("label_b").alias("label")).agg(F.sum("c").alias("y"))
    chance = a.join(b, [*key, "label"]).groupBy(*key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return total.join(chance, key, "left").select(*key, F.col("n").cast("bigint").alias("n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def even_panel_labels(votes: DataFrame, upper: bool) -> DataFrame:
    """item, panel_label of panels of three judges or more, an even number too: abstentions win by majority; of two middle
    severities the lower or the upper one counts; a missing severity that matters stays unspecified. An unknown label fails."""
    votes = votes.withColumn("label", known_label("label"))
    label = F.col("label")
    low = F.when(label.isin(PARTLY, UNSPECIFIED), 1).when(label == FULLY, 2).when(label.isNotNull(), 0)
    high = F.when(label == PARTLY, 1).when(label.isin(FULLY, UNSPECIFIED), 2).when(label.isNotNull(), 0)
    v = votes.groupBy("item").agg(F.count("label").alias("n"), F.count_if(label == ABSTAIN).alias("abs"), F.sort_array(F.collect_list(low)).alias("low"), F.sort_array(F.collect_list(high)).alias("high"))
    at = F.floor((F.col("n") - (0 if upper else 1)) / 2).cast("int")
    a, b = F.get("low", at), F.get("high", at)
    name = F.when(a != b, UNSPECIFIED).when(a == 0, FACTUAL).when(a == 1, PARTLY).otherwise(FULLY)
    return v.select("item", F.when(F.col("n") < 3, UNRESOLVED).when(2 * F.col("abs") > F.col("n"), ABSTAIN).otherwise(name).alias("panel_label"))


def claim_table(records: DataFrame, claims: str = "claims") -> DataFrame:
    """verdict, severity, n over all claims, nulls as (none)."""
    c = records.select(F.explode(claims).alias("c"))
    none = lambda f: F.coalesce(F.col(f"c.{f}"), F.lit("(none)")).alias(f)
    return c.groupBy(none("verdict"), none("severity")).agg(F.count("*").alias("n"))


def limit_binding(sizes: DataFrame, n: str, limit: int) -> DataFrame:
    """One row: queries, those whose number of candidates is the limit, and the pool's mean, median and maximum."""
    return sizes.agg(F.count("*").alias("n_queries"), F.count_if(F.col(n) == limit).alias("n_at_limit"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.max(n).alias("largest"))


def in_fixed_order(summary: DataFrame, key: str, order: list[str]) -> DataFrame:
    """place, key and the summary's columns: a row for each key of `order`, those without a summary too."""
    spark = summary.sparkSession
    fixed = spark.createDataFrame(list(enumerate(order, 1)), f"place int, {key} string")
    return fixed.join(summary, key, "left")


def set_verdicts(lists: DataFrame, a: str, b: str) -> Column:
    """How two lists of ids relate: equal (same order), same_set, prefix, nested, overlapping or disjoint."""
    x, y = F.col(a), F.col(b)
    shorter = F.least(F.size(x), F.size(y))
    common = F.size(F.array_intersect(x, y))
    prefix = (shorter > 0) & (F.slice(x, F.lit(1), F.greatest(shorter, F.lit(1))) == F.slice(y, F.lit(1), F.greatest(shorter, F.lit(1))))
    distinct = F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    same = (common == F.size(F.array_distinct(x))) & (common == F.size(F.array_distinct(y)))
    return F.when(x == y, "equal").when(same, "same_set").when(prefix, "prefix").when(common == distinct, "nested").when(common > 0, "overlapping").otherwise("disjoint")


def config_differences(configs: DataFrame, a: str, b: str) -> DataFrame:
    """key, value_a, value_b of the entries in which two maps differ, missing ones included. configs: one row, two maps."""
    x = configs.select(F.explode(a).alias("key", "value_a"))
    y = configs.select(F.explode(b).alias("key", "value_b"))
    return x.join(y, "key", "full").where(~F.col("value_a").eqNullSafe(F.col("value_b"))).select("key", "value_a", "value_b")


def config_hash(config: Column, chars: int = 10) -> Column:
    """The first digits of the SHA-256 of a map's entries in order of their keys."""
    entries = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.substring(F.sha2(F.array_join(entries, "\n"), 256), 1, chars)


def without_key(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows of these keys; the others stay as they are."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def applied_changes(before: DataFrame, after: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, old, new of rows whose derived column changed, which is what has to be stored to take the change back."""
    a, b = before.select(*keys, F.col(col).alias("old")), after.select(*keys, F.col(col).alias("new"))
    return a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def restored(after: DataFrame, changes: DataFrame, keys: list[str], col: str) -> DataFrame:
    """after with the old values of `changes`."""
    old = changes.select(*keys, F.col("old"), F.lit(True).alias("__was"))
    return after.join(old, keys, "left").withColumn(col, F.when(F.col("__was"), F.col("old")).otherwise(F.col(col))).drop("old", "__was")


def three_sources(questions: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Each question with the label of each source (key, label; null where a source has none) and how many sources have one."""
    out = questions.select(key).distinct()
    for name, s in sources.items():
        out = out.join(s.groupBy(key).agg(F.max("label").alias(name)), key, "left")
    return out.withColumn("n_sources", reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in sources]))


def phrase_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """pattern, phrase (lower case, white space collapsed), n over all texts."""
    parts = [df.select(F.lit(n).alias("pattern"), F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("phrase")) for n, p in patterns.items()]
    rows = reduce(lambda a, b: a.union(b), parts)
    return rows.groupBy("pattern", F.trim(F.regexp_replace(F.lower("phrase"), r"\s+", " ")).alias("phrase")).agg(F.count("*").alias("n"))


def counts_with_zero(items: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """key, n: how many events each item has, 0 where none."""
    n = events.groupBy(key).agg(F.count("*").alias("n"))
    return items.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def match_rate(items: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """One row: n, those with a match, and their share."""
    hit = items.join(others.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.agg(F.count("*").alias("n"), F.count("__hit").alias("n_matched"), (100 * ratio(F.count("__hit"), F.count("*"))).alias("pct"))


def path_graph(paths: DataFrame) -> DataFrame:
    """kind, id, role, weight: nodes and edges of records' retrieval paths. paths: query, anchor, via, aid, score."""
    node = lambda kind, c: paths.select(F.lit("node").alias("kind"), F.concat(F.lit(kind + "-"), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("role"), F.lit(None).cast("double").alias("weight"))
    edge = lambda a, x, b, y, role: paths.select(F.lit("edge").alias("kind"), F.concat(F.lit(a + "-"), F.col(x).cast("string"), F.lit(">" + b + "-"), F.col(y).cast("string")).alias("id"), F.lit(role).alias("role"), F.col("score").alias("weight"))
    edges = edge("query", "query", "question", "anchor", "ANCHOR").union(edge("question", "anchor", "question", "via", "STEP").where("id NOT LIKE '%self'")).union(edge("question", "via", "answer", "aid", "ANSWER"))
    rows = node("query", "query").union(node("question", "anchor")).union(node("question", "via")).union(node("answer", "aid")).union(edges)
    return rows.groupBy("kind", "id", "role").agg(F.max("weight").alias("weight"))


def evenly_probed(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in hash order."""
    from threadweave.functions.scalars import hash_order

    return first_by(df.withColumn("__h", hash_order(seed, key)), [group], ["__h", key], n).drop("__h")


def global_min_max(df: DataFrame, col: str, name: str, constant: float = 0.5) -> DataFrame:
    """df with the min-max of a column over all rows, `constant` where all are equal: a one-row aggregate, no window over the table."""
    ends = df.agg(F.min(col).alias("__low"), F.max(col).alias("__high"))
    spread = F.col("__high") - F.col("__low")
    scaled = F.when(spread == 0, F.lit(constant)).otherwise((F.col(col) - F.col("__low")) / spread)
    return df.join(F.broadcast(ends), F.lit(True)).withColumn(name, scaled).drop("__low", "__high")


def judged_json(df: DataFrame, col: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """df with value (the parsed JSON), and problem: unreadable, or the first rule that isn't kept, or null. Rules are about `value`."""
    parsed = df.withColumn("value", F.from_json(col, schema, {"mode": "PERMISSIVE"}))
    broken = F.col(col).isNull() | F.col("value").isNull() | (F.get_json_object(col, "$").isNull())
    problem = F.when(broken, "unreadable")
    for name, rule in rules.items():
        problem = problem.when(~F.coalesce(rule, F.lit(False)), name)
    return parsed.withColumn("problem", problem)


def mode_sensitivity(narrow: DataFrame, wide: DataFrame, near: DataFrame) -> DataFrame:
    """query, n_more, n_more_similar: what a wider exclusion mode rules out on top, and how much of that is similar to the query. narrow,
    wide: query, question_ids; near: query, id."""
    more = wide.join(narrow.select("query", F.col("question_ids").alias("__narrow")), "query", "left").select("query", F.explode(F.array_except("question_ids", F.coalesce("__narrow", F.array().cast("array<bigint>")))).alias("id"))
    hits = more.join(near.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hits.groupBy("query").agg(F.count("*").alias("n_more"), F.count("hit").alias("n_more_similar"))


def condition_of_file(path: Column) -> tuple[Column, Column]:
    """Condition and mode in a file's name, such as b_dup+linked.jsonl; no mode is thread."""
    name = F.element_at(F.split(path, "/"), -1)
    condition = F.regexp_extract(name, r"^([A-Za-z]+)", 1)
    mode = F.regexp_extract(name, r"^[A-Za-z]+_([a-z+0-9.]+?)\.[a-z]+$", 1)
    return condition, F.when(mode == "", "thread").otherwise(mode)


def latency_target(runs: DataFrame, answers: DataFrame, key: str, value: str, target: float, applies: Column) -> DataFrame:
    """key, n, n_timed, fallback, value, meets: the 95th percentile of a run's latencies where all of its answers have one; else the run's
    duration per answer, which meets nothing. meets is null where the target doesn't apply. runs: key, duration, and what `applies` needs."""
    sizes = answers.groupBy(key).agg(F.count("*").alias("n"), F.count(value).alias("n_timed"))
    late = percentiles_of(answers, [key], value, {"p95": share(0.95)}).drop("n")
    rows = runs.join(sizes, key, "left").join(late, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_timed", F.coalesce("n_timed", F.lit(0)))
    whole = (F.col("n") > 0) & (F.col("n") == F.col("n_timed"))
    found = F.when(whole, F.col("p95")).otherwise(ratio(F.col("duration"), F.col("n")))
    return rows.select(key, "n", "n_timed", (~whole).alias("fallback"), found.alias("value"), F.when(whole & applies, F.col("p95") <= target).alias("meets"))


def history_table(history: DataFrame, judged: DataFrame, group: list[str], order: str) -> DataFrame:
    """group, place (newest first in its group, ties by id), history_id, condition, and the latest judge's record of the run's condition.

    history: history_id, condition, group, order. judged: condition, order, and what is to be shown; of a condition's records the
    newest counts, whatever run it judged; a condition that was never judged shows nulls."""
    shown = [c for c in judged.columns if c not in ("condition", order)]
    newest = first_by(judged.where(F.col("condition").isNotNull()), ["condition"], [F.desc(order), *shown]).select("condition", *shown)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order), "history_id")).cast("bigint")
    return history.withColumn("place", place).join(newest, "condition", "left").select(*group, "place", "history_id", "condition", *shown)
