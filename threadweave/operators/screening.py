"""Judges and conditions side by side: summaries of nested records, quotes by judge, panels with another judge in them, runs that are
checked before they are pooled.

votes: item, judge, label (null: no usable vote), and columns to group by. Rates without a denominator are null. What is grouped by
judges, runs and conditions gives few rows; items are grouped by one shuffle each, and no list of a group's items is made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.judging import ABSTAIN, FACTUAL, FULLY, HALLUCINATED, PARTLY, UNRESOLVED, UNSPECIFIED, majority_labels, panel_labels, ratio, three_numbers
from threadweave.operators.reports import even_panel_labels

CATEGORIES = ("abstain", "hallucinated", "not_hallucinated")
#: How a mean score moves with a run's order.
DECREASING, LOWER, NOT_LOWER = "decreasing", "lower at the last, not monotone", "not lower at the last"


def category(label: str) -> Column:
    """abstain, hallucinated or not_hallucinated; null for labels that tell nothing."""
    c = F.col(label)
    return F.when(c == ABSTAIN, "abstain").when(c.isin(*HALLUCINATED), "hallucinated").when(c == FACTUAL, "not_hallucinated")


def record_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_full, n_partial, n_none (completeness), factual_and_complete_rate, pct_with_reference_conflict, attempt_conflict_rate,
    unverifiable_rate (of claims) and the numbers of hallucinated, abstained and usable records, of validated nested records.

    Records that couldn't be read count in n, and in the first two rates' denominators; a field that is null counts in none of its own."""
    claims = lambda test: F.coalesce(F.size(F.filter("claims", test)), F.lit(0))
    c, label = F.col("completeness"), F.col("label")
    per = records.select(*by, "completeness", "label", "conflict", claims(lambda x: F.lit(True)).alias("__n"), claims(lambda x: x["verdict"] == "UNVERIFIABLE").alias("__u"), claims(lambda x: x["reference_conflict"]).alias("__r"))
    n, usable, h, a = F.count("*"), F.count("label"), F.count_if(label.isin(*HALLUCINATED)), F.count_if(label == ABSTAIN)
    return per.groupBy(*by).agg(
        n.alias("n"), usable.alias("n_usable"), *[F.count_if(c == x).alias(f"n_{x.lower()}") for x in ("FULL", "PARTIAL", "NONE")], h.alias("n_hallucinated"), a.alias("n_abstain"),
        ratio(F.count_if((label == FACTUAL) & (c == "FULL")), n).alias("factual_and_complete_rate"), (100 * ratio(F.count_if(F.col("__r") > 0), n)).alias("pct_with_reference_conflict"),
        ratio(F.count_if("conflict"), F.count("conflict")).alias("attempt_conflict_rate"), ratio(h, usable - a).alias("rate_excl_abstain"), ratio(h + a, usable).alias("rate_incl_abstain"), ratio(F.sum("__u"), F.sum("__n")).alias("unverifiable_rate"),
    )


def quotes_by_judge(records: DataFrame, quotes: str, reference: str, candidate: str) -> DataFrame:
    """judge, usable_records, n_quotes, violations (quotes found in the candidate only), affected_items, in_neither: one criterion for every judge.

    records: judge, item, quotes (an array of quotes said to be the reference's; null: no usable record), both texts. Compared in lower
    case with white space collapsed and punctuation around them off; empty quotes don't count. Quotes are weighed inside their record,
    so a text isn't copied for each."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "), F.lit(" .,;:!?'\"()"))
    rows = records.where(F.col(quotes).isNotNull()).select("judge", "item", F.filter(F.transform(quotes, plain), lambda q: q != "").alias("q"), plain(F.col(reference)).alias("r"), plain(F.col(candidate)).alias("c"))
    outside = F.filter("q", lambda q: ~F.contains(F.col("r"), q))
    rows = rows.select("judge", "item", F.size("q").alias("n"), F.size(outside).alias("o"), F.size(F.filter(outside, lambda q: F.contains(F.col("c"), q))).alias("v"))
    per = rows.groupBy("judge", "item").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum("v").alias("v"))
    return per.groupBy("judge").agg(F.sum("k").alias("usable_records"), F.sum("n").alias("n_quotes"), F.sum("v").alias("violations"), F.count_if(F.col("v") > 0).alias("affected_items"), F.sum(F.col("o") - F.col("v")).alias("in_neither"))


def fleiss_by(votes: DataFrame, by: list[str], judges: int, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """by, n, kappa over the items that have `judges` votes, all of these categories. votes: by, item, category.

    Categories being few, an item is a count of each, and all sums come out of one aggregation. A null kappa: no item, or no spread."""
    c = F.col("category")
    per = votes.groupBy(*by, "item").agg(F.count("*").alias("__m"), *[F.count_if(c == k).alias(k) for k in categories])
    whole = per.where((F.col("__m") == judges) & (sum((F.col(k) for k in categories), F.lit(0)) == judges))
    squares = sum((F.col(k) * F.col(k) for k in categories), F.lit(0)).cast("double")
    sums = whole.groupBy(*by).agg(F.count("*").alias("n"), F.avg((squares - judges) / (judges * (judges - 1))).alias("po"), *[F.sum(k).alias(k) for k in categories])
    t = F.col("n") * judges
    pe = sum(((F.col(k) / t) * (F.col(k) / t) for k in categories), F.lit(0.0))
    return sums.select(*by, "n", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def panel_with(votes: DataFrame, out: str, other: DataFrame) -> DataFrame:
    """votes in which the judge `other` (item, judge, label) sits in place of `out`: of the items that the panel has votes on. An item on
    which the new judge said nothing has a vote that isn't usable, so its panel is as large as before."""
    stay = votes.where(F.col("judge") != out)
    name = other.agg(F.max("judge").alias("judge"))
    given = other.groupBy("item").agg(F.max("label").alias("label"))
    seats = votes.select("item").distinct().join(F.broadcast(name), F.lit(True)).join(given, "item", "left")
    return stay.select("item", "judge", "label").unionByName(seats.select("item", "judge", "label"))


def panel_report(panels: dict[str, DataFrame]) -> DataFrame:
    """panel, n, unresolved, incomplete, unanimous, n_<category>, fleiss_n and fleiss_kappa (three categories), binary_n and binary_kappa (items on
    which nobody abstains), of panels of three judges. panels: their votes by name."""
    every = reduce(DataFrame.unionByName, [v.select(F.lit(p).alias("panel"), "item", "judge", "label") for p, v in panels.items()])
    rows = every.select("panel", F.struct("panel", "item").alias("item"), "label")
    settled = panel_labels(rows).select("item.panel", "panel_label", "incomplete", "unanimous")
    counts = settled.withColumn("category", category("panel_label")).groupBy("panel").agg(
        F.count("*").alias("n"), F.count_if(F.col("panel_label") == UNRESOLVED).alias("unresolved"), F.count_if("incomplete").alias("incomplete"), F.count_if("unanimous").alias("unanimous"), *[F.count_if(F.col("category") == k).alias(f"n_{k}") for k in CATEGORIES]
    )
    votes = rows.select("panel", "item", category("label").alias("category"))
    three = fleiss_by(votes, ["panel"], 3).withColumnsRenamed({"n": "fleiss_n", "kappa": "fleiss_kappa"})
    two = fleiss_by(votes, ["panel"], 3, CATEGORIES[1:]).withColumnsRenamed({"n": "binary_n", "kappa": "binary_kappa"})
    out = counts.join(three, "panel", "left").join(two, "panel", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fleiss_n", "binary_n")})


def condition_raters(votes: DataFrame, official: list[str], upper: bool = True) -> DataFrame:
    """condition, rater, item, label: the votes of every judge, of the panel of three (`official`) and of the panel of all
    (`sensitivity`, of two middle severities the upper one unless told otherwise)."""
    key = votes.select(F.struct("condition", "item").alias("item"), "judge", "label")
    three, every = panel_labels(key.where(F.col("judge").isin(*official))), even_panel_labels(key, upper)
    panels = [p.select("item.condition", F.lit(r).alias("rater"), "item.item", F.col("panel_label").alias("label")) for p, r in ((three, "official"), (every, "sensitivity"))]
    return votes.select("condition", F.col("judge").alias("rater"), "item", "label").unionByName(panels[0]).unionByName(panels[1])


def numbers_by_condition(raters: DataFrame) -> DataFrame:
    """The three numbers of each rater in each condition; unresolved panels are missing."""
    known = F.when(category("label").isNotNull(), F.col("label"))
    return three_numbers(raters.withColumn("label", known), ["condition", "rater"], "label")


def condition_summary(votes: DataFrame, official: list[str], extra: str, upper: bool = True) -> DataFrame:
    """condition, n, n_extra_usable, unresolved_official, unresolved_sensitivity, ties, n_compared, changed, n_extra_compared, extra_agreement, and Fleiss' kappa with
    its items for all judges and the official three.

    changed: items whose category another judge changes, of those that both panels settle. ties: items of which the two middle
    severities differ, so that the rule for ties decides."""
    key = votes.select(F.struct("condition", "item").alias("item"), "judge", "label")
    three = panel_labels(key.where(F.col("judge").isin(*official))).select("item", F.col("panel_label").alias("o"))
    low, high = (even_panel_labels(key, u).select("item", F.col("panel_label").alias("high" if u else "low")) for u in (False, True))
    own = key.where(F.col("judge") == extra).groupBy("item").agg(F.max("label").alias("x"))
    rows = three.join(low, "item").join(high, "item").join(own, "item", "left").withColumn("s", F.col("high" if upper else "low"))
    rows = rows.select("item.condition", "*", category("o").alias("co"), category("s").alias("cs"), category("x").alias("cx"))
    both, seen = F.col("co").isNotNull() & F.col("cs").isNotNull(), F.col("co").isNotNull() & F.col("cx").isNotNull()
    out = rows.groupBy("condition").agg(
        F.count("*").alias("n"), F.count("cx").alias("n_extra_usable"), F.count_if(F.col("o") == UNRESOLVED).alias("unresolved_official"), F.count_if(F.col("s") == UNRESOLVED).alias("unresolved_sensitivity"),
        F.count_if(F.col("low") != F.col("high")).alias("ties"), F.count_if(both).alias("n_compared"), F.count_if(both & (F.col("co") != F.col("cs"))).alias("changed"), F.count_if(seen).alias("n_extra_compared"),
        ratio(F.count_if(seen & (F.col("co") == F.col("cx"))), F.count_if(seen)).alias("extra_agreement"),
    )
    cats = votes.select("condition", "item", "judge", category("label").alias("category"))
    all_ = fleiss_by(cats, ["condition"], len(official) + 1).withColumnsRenamed({"n": "n_complete_all", "kappa": "fleiss_all"})
    few = fleiss_by(cats.where(F.col("judge").isin(*official)), ["condition"], len(official)).withColumnsRenamed({"n": "n_complete_official", "kappa": "fleiss_official"})
    out = out.join(all_, "condition", "left").join(few, "condition", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_complete_all", "n_complete_official")})


def judge_detail(items: DataFrame, votes: DataFrame, scores: dict[str, float]) -> DataFrame:
    """rater (a judge, or panel), run, n_items, n_left_out, n_<label>, n_questions, questions_met, primary, secondary, place_primary, place_secondary, direction,
    as_panel.

    items: run (in order), question_id, item, an item standing for a text that several runs may hold. votes: item, judge, label, each judge's
    once. primary: the share of a run's questions with an item of the first label; secondary: the mean score of rated items (0 if
    none); places count from 1, ties by run; direction: how secondary moves from the first run to the last."""
    first = next(iter(scores))
    of = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    whole = majority_labels(votes, list(scores)).where(F.col("panel_label").isin(*scores)).select("item", F.lit("panel").alias("rater"), F.col("panel_label").alias("label"))
    rated = votes.where(F.col("label").isin(*scores)).select("item", F.col("judge").alias("rater"), "label").unionByName(whole)
    sizes = items.groupBy("run", "question_id").agg(F.count("*").alias("k")).groupBy("run").agg(F.sum("k").alias("n_items"), F.count("*").alias("n_questions"))
    names = votes.select(F.col("judge").alias("rater")).union(votes.sparkSession.createDataFrame([("panel",)], "rater string")).distinct()
    label = F.col("label")
    per = items.join(rated, "item").groupBy("run", "rater", "question_id").agg(F.count("*").alias("k"), F.sum(of[label]).alias("s"), *[F.count_if(label == x).alias(f"n_{x.lower()}") for x in scores])
    met = F.count_if(F.col(f"n_{first.lower()}") > 0)
    per = per.groupBy("run", "rater").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), met.alias("met"), *[F.sum(f"n_{x.lower()}").alias(f"n_{x.lower()}") for x in scores])
    # raters and runs are few; each has a row even where a judge said nothing
    rows = sizes.join(F.broadcast(names), F.lit(True)).join(per, ["run", "rater"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select(
        "rater", "run", "n_items", (F.col("n_items") - none("k")).alias("n_left_out"), *[none(f"n_{x.lower()}").alias(f"n_{x.lower()}") for x in scores], "n_questions", none("met").alias("questions_met"),
        (none("met") / F.col("n_questions")).alias("primary"), F.coalesce(ratio(F.col("s"), F.col("k")), F.lit(0.0)).alias("secondary"),
    )
    w = Window.partitionBy("rater")
    place = lambda c: F.row_number().over(w.orderBy(F.desc(c), "run")).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("run", "secondary")).over(w))
    falls = F.forall(F.sequence(F.lit(1), F.size("__o")), lambda i: (i == 1) | (F.element_at("__o", i)["secondary"] < F.element_at("__o", F.greatest(i - 1, F.lit(1)))["secondary"]))
    lower = F.element_at("__o", -1)["secondary"] < F.element_at("__o", 1)["secondary"]
    rows = rows.withColumns({"place_primary": place("primary"), "place_secondary": place("secondary"), "__o": ordered})
    rows = rows.withColumn("direction", F.when(falls, DECREASING).when(lower, LOWER).otherwise(NOT_LOWER)).drop("__o")
    panel = F.max(F.when(F.col("rater") == "panel", F.col("direction"))).over(Window.partitionBy("run"))
    return rows.withColumn("as_panel", F.col("direction") == panel)


def unanimity(votes: DataFrame, judges: int) -> DataFrame:
    """One row: n items, n_full (a usable vote of every judge), pct_unanimous of those. votes: each judge's once an item."""
    per = votes.groupBy("item").agg(F.count("label").alias("k"), (F.min("label") == F.max("label")).alias("same"))
    full = F.col("k") == judges
    return per.agg(F.count("*").alias("n"), F.count_if(full).alias("n_full"), (100 * ratio(F.count_if(full & F.col("same")), F.count_if(full))).alias("pct_unanimous"))


def noted(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """keys, problem, n: a row for each count above 0."""
    listed = F.array(*[F.struct(F.lit(k).alias("problem"), c.cast("bigint").alias("n")) for k, c in counts.items()])
    return rows.select(*keys, F.explode(listed).alias("__p")).select(*keys, "__p.*").where("n > 0")


def run_problems(records: DataFrame, expected: DataFrame, key: list[str], keys: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """run, problem, n: why runs may not be pooled; no rows if they may.

    records: run, question_id, config and the columns of `key` and `wanted`, the values that must be in every row. expected: question_id of the
    frozen sample. keys: the settings (`key`) of which there must be one run each; a setting without a run has its values as
    the run's name. Problems: several configurations, wrong values, repeated, foreign and missing questions, one setting in several runs."""
    ids = expected.select("question_id").distinct()
    total = ids.agg(F.count("*").alias("__total"))
    wrong = {c: F.count_if(~F.col(c).eqNullSafe(F.lit(v))) for c, v in wanted.items()}
    seen = records.groupBy("run", "question_id").agg(F.count("*").alias("k"), *[c.alias(f"w_{n}") for n, c in wrong.items()])
    seen = seen.join(ids.withColumn("__in", F.lit(True)), "question_id", "left")
    per = seen.groupBy("run").agg(F.sum(F.col("k") - 1).alias("repeated"), F.count_if(F.col("__in").isNull()).alias("foreign"), F.count("__in").alias("hits"), *[F.sum(f"w_{n}").alias(f"w_{n}") for n in wanted])
    configs = records.select("run", "config").distinct().groupBy("run").agg(F.count("*").alias("configs"))
    rows = per.join(configs, "run").join(F.broadcast(total), F.lit(True))
    several = F.when(F.col("configs") > 1, F.col("configs")).otherwise(0)
    found = noted(rows, ["run"], {"several configurations": several, **{f"wrong {n}": F.col(f"w_{n}") for n in wanted}, "repeated questions": F.col("repeated"), "foreign questions": F.col("foreign"), "missing questions": F.col("__total") - F.col("hits")})
    settings = records.select("run", *key).distinct()
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in key])
    held = settings.groupBy(*key).agg(F.count("*").alias("runs")).select(name.alias("run"), "runs")
    shared = held.where("runs > 1").select("run", F.lit("setting of several runs").alias("problem"), F.col("runs").alias("n"))
    absent = keys.select(name.alias("run")).distinct().join(held, "run", "left_anti").select("run", F.lit("no run").alias("problem"), F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(shared).unionByName(absent)


def judgment_problems(records: DataFrame, judgments: DataFrame, version: str) -> DataFrame:
    """run, problem, n: questions of a run that a judge hasn't judged, judged twice or without a usable label, judgments by another version and of
    foreign questions. judgments: run, question_id, judge, label (null: unusable), version."""
    asked = records.select("run", "question_id").distinct().withColumn("__asked", F.lit(True))
    given = judgments.groupBy("run", "question_id", "judge").agg(F.count("*").alias("k"), F.count_if(F.col("label").isNull()).alias("bad"), F.count_if(~F.col("version").eqNullSafe(F.lit(version))).alias("old"))
    # judges are few: the grid has a row for each that a question should have
    grid = asked.join(F.broadcast(judgments.select("judge").distinct()), F.lit(True))
    both = grid.join(given, ["run", "question_id", "judge"], "full")
    k = F.coalesce("k", F.lit(0))
    per = both.groupBy("run", "judge").agg(
        F.count_if(F.col("__asked").isNotNull() & (k == 0)).alias("unjudged"), F.count_if(k > 1).alias("twice"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("old"), F.lit(0)).alias("old"), F.count_if(F.col("__asked").isNull()).alias("foreign")
    )
    return noted(per, ["run", "judge"], {"unjudged questions": F.col("unjudged"), "questions judged twice": F.col("twice"), "unusable judgments": F.col("bad"), "judgments of another version": F.col("old"), "foreign questions": F.col("foreign")})


def pooled_counts(judged: DataFrame, pool: str, part: str) -> DataFrame:
    """pool, part (null: both together), level, the counts and rates of three numbers and severities: each run and each pool of runs in one
    pass. judged: pool, part, label."""
    label = F.col("label")
    h, a, n = F.count_if(label.isin(*HALLUCINATED)), F.count_if(label == ABSTAIN), F.count("label")
    sets = [[F.col(pool), F.col(part)], [F.col(pool)]]
    return judged.groupingSets(sets, F.col(pool), F.col(part)).agg(
        F.grouping(part).cast("int").alias("level"), F.count("*").alias("n"), a.alias("n_abstain"), F.count_if(label == FACTUAL).alias("n_not_hallucinated"), h.alias("n_hallucinated"), ratio(h, n - a).alias("rate_excl_abstain"),
        ratio(h + a, n).alias("rate_incl_abstain"), ratio(a, F.count("*")).alias("abstain_rate"), *[F.count_if(label == x).alias(f"n_{s}") for x, s in ((FULLY, "full"), (PARTLY, "partial"), (UNSPECIFIED, "unspecified"))],
    )
