"""Judged runs: context items of run records, their labels, panels of judges, and the summaries that follow from them.

records: run, question_id, context (array of structs, best first). labels: question_id, answer_id, text_hash, label. votes: item,
judge, label (null: no usable vote). Rates without a denominator are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of relevance with their scores, and labels of judges.
RELEVANCE = {"RELEVANT": 1.0, "PARTIAL": 0.5, "IRRELEVANT": 0.0}
ABSTAIN, FACTUAL, PARTLY, FULLY, UNSPECIFIED = "ABSTAIN", "FAKTUAL", "HALUSINASI_SEBAGIAN", "HALUSINASI_PENUH", "HALUSINASI_SEVERITY_UNSPECIFIED"
UNRESOLVED, INCOMPLETE = "UNRESOLVED", "INCOMPLETE"
HALLUCINATED = (PARTLY, FULLY, UNSPECIFIED)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def context_items(records: DataFrame, context: str = "context") -> DataFrame:
    """A row an item: run, question_id, rank (from 1), text_hash and the item's own fields. Records without items have none."""
    items = records.select("run", "question_id", F.posexplode(context).alias("__at", "__item"))
    return items.select("run", "question_id", (F.col("__at") + 1).alias("rank"), "__item.*").withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def items_to_judge(items: DataFrame, done: DataFrame) -> DataFrame:
    """question_id, answer_id, text_hash of all runs' items, each once, that `done` lacks."""
    keys = ["question_id", "answer_id", "text_hash"]
    return items.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def with_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items with label and score; both null where the item isn't judged, or by a label that isn't one of relevance."""
    keys = ["question_id", "answer_id", "text_hash"]
    known = labels.where(F.col("label").isin(*RELEVANCE)).groupBy(*keys).agg(F.max("label").alias("label"))
    score = F.create_map(*[F.lit(x) for pair in RELEVANCE.items() for x in pair])
    return items.join(known, keys, "left").withColumn("score", score[F.col("label")])


def relevance_by_run(judged: DataFrame) -> DataFrame:
    """Shares of labels among judged items, of questions with a relevant one, and mean scores of first and later ranks, by run."""
    label, score = F.col("label"), F.col("score")
    n, asked, met = F.count("label"), F.count_distinct("question_id"), F.count_distinct(F.when(label == "RELEVANT", F.col("question_id")))
    share = [(100 * ratio(F.count_if(label == k), n)).alias(f"pct_{k.lower()}") for k in RELEVANCE]
    means = [F.avg(score).alias("mean_score"), F.avg(F.when(F.col("rank") == 1, score)).alias("mean_score_rank1"), F.avg(F.when(F.col("rank") > 1, score)).alias("mean_score_later")]
    return judged.groupBy("run").agg(F.count("*").alias("n_items"), (F.count("*") - n).alias("n_unjudged"), *share, asked.alias("n_questions"), (100 * ratio(met, asked)).alias("pct_questions_relevant"), *means)


def relevance_rate_by(judged: DataFrame, col: str) -> DataFrame:
    """value (None for null), n and the rate of relevant items among judged ones."""
    seen = judged.where("label IS NOT NULL")
    return seen.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"), F.avg((F.col("label") == "RELEVANT").cast("double")).alias("rate"))


def question_differences(judged: DataFrame, value: str) -> DataFrame:
    """run, question_id, difference: mean of relevant items less the mean of the others, where a question has both."""
    relevant = F.col("label") == "RELEVANT"
    seen = judged.where(F.col("label").isNotNull() & F.col(value).isNotNull())
    means = seen.groupBy("run", "question_id").agg((F.avg(F.when(relevant, F.col(value))) - F.avg(F.when(~relevant, F.col(value)))).alias("difference"))
    return means.where("difference IS NOT NULL")


def provenance_summary(judged: DataFrame) -> DataFrame:
    """Items of each hop, answers' authors that served as anchors, and those of a relevant item, by run and question."""
    hop = [F.count_if(F.col("hop") == h).alias(f"n_{n}") for h, n in (("1", "hop1"), ("2", "hop2"), ("semantic", "semantic"))]
    return judged.groupBy("run", "question_id").agg(F.count("*").alias("n_items"), *hop, F.count_distinct("anchor").alias("n_anchors"), F.count_distinct(F.when(F.col("label") == "RELEVANT", F.col("anchor"))).alias("n_anchors_relevant"))


def label_transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """before, after, n: how often a label became which, over the keys of both tables."""
    both = before.select(*keys, F.col("label").alias("before")).join(after.select(*keys, F.col("label").alias("after")), keys)
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def known_label(col: str) -> Column:
    """The label; the query fails on one that no judge may give."""
    c = F.col(col)
    return F.when(c.isNull() | c.isin(ABSTAIN, FACTUAL, *HALLUCINATED), c).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("string"))


def panel_labels(votes: DataFrame) -> DataFrame:
    """item, panel_label, incomplete, unanimous, n_valid, n_abstain, n_hallucinated of panels of three judges.

    Three valid votes: ABSTAIN if two abstain, else the median severity. Two: both must abstain or both must not, and agree on
    whether there is an error; the lower severity counts. Fewer: unresolved. A vote without severity stands for 1 or 2; if
    that matters to the result, the panel's severity is unspecified, too. As medians and minima rise with each vote, the
    least and the greatest severities tell all that could come out. A label that isn't one of the five fails."""
    votes = votes.withColumn("label", known_label("label"))
    label = F.col("label")
    low = F.when(label.isin(PARTLY, UNSPECIFIED), 1).when(label == FULLY, 2).when(label.isNotNull(), 0)
    high = F.when(label == PARTLY, 1).when(label.isin(FULLY, UNSPECIFIED), 2).when(label.isNotNull(), 0)
    sorted_ = lambda c: F.sort_array(F.collect_list(c))
    v = votes.groupBy("item").agg(
        F.count("*").alias("n_judges"), F.count("label").alias("n_valid"), F.count_if(label == ABSTAIN).alias("n_abstain"), F.count_if(label.isin(*HALLUCINATED)).alias("n_hallucinated"),
        F.count_distinct("label").alias("n_labels"), sorted_(low).alias("low"), sorted_(high).alias("high"),
    )
    name = lambda s: F.when(s == 0, FACTUAL).when(s == 1, PARTLY).otherwise(FULLY)
    settled = lambda at: F.when(F.get("low", F.lit(at)) == F.get("high", F.lit(at)), name(F.get("low", F.lit(at)))).otherwise(UNSPECIFIED)
    three = F.when(F.col("n_abstain") >= 2, ABSTAIN).otherwise(settled(1))
    two = F.when(F.col("n_abstain") == 2, ABSTAIN).when((F.col("n_abstain") == 1) | (F.col("n_hallucinated") == 1), UNRESOLVED).when(F.col("n_hallucinated") == 0, FACTUAL).otherwise(settled(0))
    whole = (F.col("n_judges") == 3) & (F.col("n_valid") == 3)
    v = v.withColumn("panel_label", F.when(whole, three).when(F.col("n_valid") == 2, two).otherwise(UNRESOLVED))
    incomplete = ~whole & (F.col("n_valid") == 2) & (F.col("panel_label") != UNRESOLVED)
    return v.select("item", "panel_label", incomplete.alias("incomplete"), (whole & (F.col("n_labels") == 1)).alias("unanimous"), "n_valid", "n_abstain", "n_hallucinated")


def majority_labels(votes: DataFrame, order: list[str]) -> DataFrame:
    """item, panel_label, decided_by: a label of two votes or more, of three different ones the middle one of `order`."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("label"))
    counts = votes.where("label IS NOT NULL").groupBy("item", "label").agg(F.count("*").alias("c"), F.min(place).alias("p"))
    v = counts.groupBy("item").agg(F.sum("c").alias("n"), F.max(F.struct("c", -F.col("p"), "label")).alias("top"), F.sort_array(F.collect_list(F.struct("p", "label"))).alias("all"))
    v = votes.select("item").distinct().join(v, "item", "left")
    n = F.coalesce("n", F.lit(0))
    label = F.when(n < 2, INCOMPLETE).when(F.col("top.c") >= 2, F.col("top.label")).when(n == 3, F.get("all", F.lit(1))["label"]).otherwise(UNRESOLVED)
    by = F.when(n < 2, F.lit(None)).when(F.col("top.c") >= 2, "majority").when(n == 3, "median")
    return v.select("item", label.alias("panel_label"), by.alias("decided_by"))


def judge_pairs(votes: DataFrame) -> DataFrame:
    """item, judge_a, judge_b (a < b) with their labels, where both are usable."""
    v = votes.where("label IS NOT NULL")
    a, b = v.select("item", F.col("judge").alias("judge_a"), F.col("label").alias("label_a")), v.select("item", F.col("judge").alias("judge_b"), F.col("label").alias("label_b"))
    return a.join(b, "item").where("judge_a < judge_b")


def pairwise_agreement(votes: DataFrame) -> DataFrame:
    """judge_a, judge_b, n, pct_agree."""
    same = F.avg((F.col("label_a") == F.col("label_b")).cast("double"))
    return judge_pairs(votes).groupBy("judge_a", "judge_b").agg(F.count("*").alias("n"), (100 * same).alias("pct_agree"))


def three_numbers(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Counts of abstentions, errors and right answers; the error rate without abstentions and with them as failures; and
    severities, by group. A null label is missing."""
    c = F.col(label)
    h, a = F.count_if(c.isin(*HALLUCINATED)), F.count_if(c == ABSTAIN)
    usable = F.count(c)
    counts = [F.count("*").alias("n"), usable.alias("n_usable"), h.alias("hallucinated"), a.alias("abstain")]
    rates = [ratio(h, usable - a).alias("rate_excl_abstain"), ratio(h + a, usable).alias("rate_abstain_as_failed"), ratio(a, usable).alias("abstain_rate")]
    severity = [F.count_if(c == k).alias(n) for k, n in ((FULLY, "full"), (PARTLY, "partial"), (UNSPECIFIED, "unspecified"))]
    return df.groupBy(*by).agg(*counts, *rates, *severity)


def claim_statistics(records: DataFrame, by: list[str], claims: str = "claims") -> DataFrame:
    """Shares over claims (micro) and over answers (macro) of those that the context supports; null values leave the denominator.
    claims: an array of structs with verdict and supported."""
    rated = lambda x: x["supported"].isNotNull()
    sizes = records.select(*by, F.size(claims).alias("n"), F.size(F.filter(claims, lambda x: x["verdict"] == "UNVERIFIABLE")).alias("unv"), F.size(F.filter(claims, rated)).alias("r"), F.size(F.filter(claims, lambda x: rated(x) & x["supported"])).alias("y"))
    micro, macro = ratio(F.sum("y"), F.sum("r")), F.avg(ratio(F.col("y"), F.col("r")))
    return sizes.groupBy(*by).agg(F.sum("n").alias("n_claims"), ratio(F.sum("unv"), F.sum("n")).alias("unverifiable_share"), micro.alias("micro"), macro.alias("macro"), F.count_if(F.col("r") > 0).alias("n_answers"))


def flip_statistics(pairs: DataFrame, base: str, variant: str) -> DataFrame:
    """How often the category (abstain, error, right) differs between two judgments of an item, and which way errors went."""
    category = lambda c: F.when(F.col(c) == ABSTAIN, "a").when(F.col(c).isin(*HALLUCINATED), "h").when(F.col(c).isNotNull(), "n")
    p = pairs.select(category(base).alias("x"), category(variant).alias("y"))
    usable = F.col("x").isNotNull() & F.col("y").isNotNull()
    both = usable & (F.col("x") != "a") & (F.col("y") != "a")
    moved = F.col("x") != F.col("y")
    out = p.agg(F.count("*").alias("n_pairs"), F.count_if(usable).alias("n_usable"), F.count_if(usable & moved).alias("flips"), F.count_if(both).alias("n_both"), F.count_if(both & moved).alias("flips_error"), F.count_if(both & moved & (F.col("y") == "h")).alias("to_error"), F.count_if(both & moved & (F.col("y") == "n")).alias("from_error"))
    return out.withColumn("flip_rate", ratio(F.col("flips"), F.col("n_usable"))).withColumn("flip_rate_error", ratio(F.col("flips_error"), F.col("n_both")))


def detection(pairs: DataFrame, rater: Column, truth: Column, by: list[str]) -> DataFrame:
    """Recall, unsafe passes and false alarms of a rater against the truth, both yes/no columns."""
    p = pairs.select(*by, rater.alias("r"), truth.alias("t")).where("r IS NOT NULL AND t IS NOT NULL")
    r, t = F.col("r"), F.col("t")
    return p.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count_if(r & t), F.count_if(t)).alias("recall"), ratio(F.count_if(~r & t), F.count_if(t)).alias("unsafe_pass"), ratio(F.count_if(r & ~t), F.count_if(~t)).alias("false_alarm"))


def compare_lists(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Two ranked lists of ids a key: set, first place and order changed, Jaccard (1 for two empty ones), ids that came in."""
    a, b = F.coalesce("a", F.array().cast("array<bigint>")), F.coalesce("b", F.array().cast("array<bigint>"))
    both = base.select(*keys, F.col("ids").alias("a")).join(other.select(*keys, F.col("ids").alias("b")), keys, "full").withColumn("a", a).withColumn("b", b)
    union, entered = F.size(F.array_union("a", "b")), F.size(F.array_except("b", "a"))
    left = F.size(F.array_except("a", "b"))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return both.select(*keys, ((entered > 0) | (left > 0)).alias("set_changed"), (~F.get("a", F.lit(0)).eqNullSafe(F.get("b", F.lit(0)))).alias("first_changed"), (F.col("a") != F.col("b")).alias("order_changed"), jaccard.alias("jaccard"), entered.alias("n_entered"))


def quote_check(quotes: DataFrame, quote: str, reference: str, candidate: str, by: list[str]) -> DataFrame:
    """Of quotes said to come from the reference: n, those in the candidate only (violations), those in neither; all compared in
    lower case with white space collapsed and punctuation around them off. Empty quotes don't count."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "), F.lit(" .,;:!?'\"()"))
    q = quotes.select(*by, plain(quote).alias("q"), plain(reference).alias("r"), plain(candidate).alias("c")).where("q <> ''")
    outside = ~F.contains("r", "q")
    return q.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(outside & F.contains("c", "q")).alias("violations"), F.count_if(outside & ~F.contains("c", "q")).alias("in_neither"))


def citation_report(answers: DataFrame, by: list[str], text: str, context_ids: str) -> DataFrame:
    """Answers with a valid citation, with invalid ones only, with none; those with any invalid token; valid tokens among all."""
    from threadweave.functions.scalars import citation_tokens, valid_citations

    tokens = answers.select(*by, F.size(citation_tokens(F.col(text))).alias("t"), F.size(valid_citations(F.col(text), F.col(context_ids))).alias("v"))
    pct = lambda c: 100 * F.avg(c.cast("double"))
    valid, none = F.col("v") > 0, F.col("t") == 0
    return tokens.groupBy(*by).agg(F.count("*").alias("n_answers"), pct(valid).alias("pct_valid"), pct(none).alias("pct_no_citation"), pct(~valid & ~none).alias("pct_invalid_only"), pct(F.col("v") < F.col("t")).alias("fabricated_rate"), ratio(F.sum("v"), F.sum("t")).alias("precision"))
