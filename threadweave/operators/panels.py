"""Panels of judges against the items that they should have judged: votes that are missing, summaries on every level, agreement.

votes: item, judge, label (null: the call failed). items: item and any columns to group by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.operators.judging import ABSTAIN, FACTUAL, HALLUCINATED, INCOMPLETE, UNRESOLVED, majority_labels, ratio

USABLE, FAILED, MISSING = "usable", "failed", "missing"
#: Readings of labels for agreement: what an abstention, an error and a right answer count as; null leaves the item out.
READINGS = {
    "three_categories": ("abstain", "hallucinated", "not_hallucinated"), "abstain_excluded": (None, "hallucinated", "not_hallucinated"),
    "abstain_not_hallucinated": ("not_hallucinated", "hallucinated", "not_hallucinated"), "abstain_or_not": ("abstain", "not_abstain", "not_abstain"),
}


def panel_grid(items: DataFrame, judges: list[str], votes: DataFrame) -> DataFrame:
    """items' columns, judge, label, state: a row for each item and judge of the panel, whether there is a vote or not. Of several
    votes of a judge the greatest usable label counts; votes on other items or by other judges are left out."""
    given = votes.groupBy("item", "judge").agg(F.max("label").alias("label"))
    rows = items.withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))
    state = F.when(F.col("label").isNotNull(), USABLE).when(F.col("__there"), FAILED).otherwise(MISSING)
    return rows.join(given.withColumn("__there", F.lit(True)), ["item", "judge"], "left").withColumn("state", state).drop("__there")


def panel_records(grid: DataFrame, judges: list[str], scores: dict[str, float]) -> DataFrame:
    """item, n_usable, n_failed, n_missing, completeness, panel_label, decided_by, panel_score, mean_judge_score (of a complete panel).

    completeness: complete (all judges usable), partial (two or more), insufficient (one) or none. scores: of the labels, in their order."""
    of = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    count = lambda state: F.count_if(F.col("state") == state)
    per = grid.groupBy("item").agg(count(USABLE).alias("n_usable"), count(FAILED).alias("n_failed"), count(MISSING).alias("n_missing"), F.avg(of[F.col("label")]).alias("mean"))
    n = F.col("n_usable")
    level = F.when(n == len(judges), "complete").when(n >= 2, "partial").when(n == 1, "insufficient").otherwise("none")
    labels = majority_labels(grid.select("item", "label"), list(scores))
    return per.join(labels, "item").select("item", "n_usable", "n_failed", "n_missing", level.alias("completeness"), "panel_label", "decided_by", of[F.col("panel_label")].alias("panel_score"), F.when(n == len(judges), F.col("mean")).alias("mean_judge_score"))


def panel_summary(records: DataFrame, items: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """by (null: all of them), n_items, n_decided, n_incomplete, n_unresolved, by_majority, by_median, n_<label>, panel_mean, judge_mean and
    panels_<completeness>: one rollup from each group to the whole."""
    decided = ~F.col("panel_label").isin(INCOMPLETE, UNRESOLVED)
    rows = items.select("item", *by).join(records, "item").rollup(*by)
    states = [F.count_if(F.col("completeness") == s).alias(f"panels_{s}") for s in ("complete", "partial", "insufficient", "none")]
    return rows.agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_items"), F.count_if(decided).alias("n_decided"), F.count_if(F.col("panel_label") == INCOMPLETE).alias("n_incomplete"),
        F.count_if(F.col("panel_label") == UNRESOLVED).alias("n_unresolved"), F.count_if(F.col("decided_by") == "majority").alias("by_majority"), F.count_if(F.col("decided_by") == "median").alias("by_median"),
        *[F.count_if(F.col("panel_label") == x).alias(f"n_{x.lower()}") for x in labels], F.avg("panel_score").alias("panel_mean"), F.avg("mean_judge_score").alias("judge_mean"), *states,
    )


def judge_summary(grid: DataFrame, by: list[str], scores: dict[str, float]) -> DataFrame:
    """judge, by (null: all), level, n_usable, n_failed, n_missing, mean_score and n_<label> of each judge, for groups and the whole."""
    of = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    sets = [[F.col("judge"), *[F.col(c) for c in by[:k]]] for k in range(len(by), -1, -1)]
    count = lambda c, x: F.count_if(F.col(c) == x)
    out = grid.groupingSets(sets, F.col("judge"), *[F.col(c) for c in by]).agg(
        F.grouping_id().cast("int").alias("level"), *[count("state", s).alias(f"n_{s}") for s in (USABLE, FAILED, MISSING)], F.avg(of[F.col("label")]).alias("mean_score"), *[count("label", x).alias(f"n_{x.lower()}") for x in scores]
    )
    return out


def relevance_by_rater(items: DataFrame, grid: DataFrame, records: DataFrame, judges: list[str], scores: dict[str, float]) -> DataFrame:
    """run, rater (a judge, or panel), n_items, n_rated, pct_<label>, pct_questions (with an item of the first label), mean_score, complete.

    items: run, question_id, rank, item, an item standing for a text that several runs may hold. The panel's row is there only for runs in
    which every judge rated something; complete says whether that is so."""
    first = next(iter(scores))
    of = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    rated = grid.select("item", F.col("judge").alias("rater"), "label").where("label IS NOT NULL")
    whole = records.where(F.col("panel_label").isin(*scores)).select("item", F.lit("panel").alias("rater"), F.col("panel_label").alias("label"))
    sizes = items.groupBy("run").agg(F.count("*").alias("n_items"), F.count_distinct("question_id").alias("n_questions"))
    rows = items.join(rated.unionByName(whole), "item")
    met = F.count_distinct(F.when(F.col("label") == first, F.col("question_id")))
    shares = [(100 * ratio(F.count_if(F.col("label") == x), F.count("*"))).alias(f"pct_{x.lower()}") for x in scores]
    out = rows.groupBy("run", "rater").agg(F.count("*").alias("n_rated"), *shares, met.alias("met"), F.avg(of[F.col("label")]).alias("mean_score"))
    present = out.where("rater <> 'panel'").groupBy("run").agg((F.count("*") == len(judges)).alias("complete"))
    out = out.join(sizes, "run").join(present, "run", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return out.where("rater <> 'panel' OR complete").withColumn("pct_questions", 100 * ratio(F.col("met"), F.col("n_questions"))).drop("met", "n_questions")


def category(label: Column, reading: str) -> Column:
    abstain, error, right = READINGS[reading]
    return F.when(label == ABSTAIN, F.lit(abstain)).when(label.isin(*HALLUCINATED), F.lit(error)).when(label == FACTUAL, F.lit(right))


def agreement(ratings: DataFrame, by: str, overrides: DataFrame | None = None) -> DataFrame:
    """reading, rater_a, rater_b (a < b), by (null: all), level, n, n_left_out (by the reading), agreement, kappa (null where undefined).

    ratings: item, rater, label, by. Every pair of raters (judges, their panel, a human) is compared over the items that both rated, in
    all readings at once, for each value of `by` and as a whole. overrides: item, rater, label in place of what was given.
    Kappa follows from the cells of each contingency table; a pair of raters has nine cells at most."""
    if overrides is not None:
        changed = overrides.select("item", "rater", F.col("label").alias("__new"), F.lit(True).alias("__set"))
        ratings = ratings.join(changed, ["item", "rater"], "left").withColumn("label", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("label"))).drop("__new", "__set")
    seen = ratings.where(F.col("label").isin(ABSTAIN, FACTUAL, *HALLUCINATED)).select("item", "rater", "label", by)
    a, b = seen.select("item", F.col("rater").alias("rater_a"), F.col("label").alias("x"), by), seen.select("item", F.col("rater").alias("rater_b"), F.col("label").alias("y"))
    kinds = a.join(b, "item").where("rater_a < rater_b").groupBy("rater_a", "rater_b", by, "x", "y").agg(F.count("*").alias("c"))
    read = F.array(*[F.struct(F.lit(r).alias("reading"), category(F.col("x"), r).alias("x"), category(F.col("y"), r).alias("y")) for r in READINGS])
    rows = kinds.select("rater_a", "rater_b", by, "c", F.explode(read).alias("r")).select("rater_a", "rater_b", by, "c", "r.*")
    key = [F.col(c) for c in ("reading", "rater_a", "rater_b")]
    cells = rows.groupingSets([[*key, F.col(by), F.col("x"), F.col("y")], [*key, F.col("x"), F.col("y")]], *key, F.col(by), F.col("x"), F.col("y")).agg(F.grouping(by).cast("int").alias("level"), F.sum("c").alias("c"))
    fine = F.col("x").isNotNull() & F.col("y").isNotNull()
    per = cells.groupBy("reading", "rater_a", "rater_b", by, "level").agg(F.coalesce(F.sum(F.when(fine, F.col("c"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~fine, F.col("c"))), F.lit(0)).alias("n_left_out"), F.coalesce(F.sum(F.when(fine & (F.col("x") == F.col("y")), F.col("c"))), F.lit(0)).alias("same"), F.collect_list(F.when(fine, F.struct("x", "y", "c"))).alias("cells"))
    by_chance = F.aggregate(F.flatten(F.transform("cells", lambda i: F.transform("cells", lambda j: F.when(i["x"] == j["y"], i["c"].cast("double") * j["c"]).otherwise(0.0)))), F.lit(0.0), lambda s, x: s + x)
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, by_chance / (n * n)
    return per.select("reading", "rater_a", "rater_b", by, "level", "n", "n_left_out", F.when(n > 0, po).alias("agreement"), F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))
