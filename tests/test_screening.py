from itertools import combinations

import numpy as np
import pytest

from threadweave.operators import judging as J
from threadweave.operators import screening as X

A, R, P, H = J.ABSTAIN, J.FACTUAL, J.PARTLY, J.FULLY


def votes(spark, rows, condition=None):
    out = spark.createDataFrame([(i, f"j{k}", label, condition) for i, labels in enumerate(rows) for k, label in enumerate(labels)], "item int, judge string, label string, condition string")
    return out if condition else out.drop("condition")


def test_fleiss_is_the_mean_over_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [[X.CATEGORIES[int(k)] for k in rng.integers(0, 3, 4)] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, r in enumerate(rows) for c in r] + [(99, "abstain"), (98, None)], "item int, category string")
    got = X.fleiss_by(df, [], 4).first()
    po = np.mean([np.mean([a == b for a, b in combinations(r, 2)]) for r in rows])
    pe = sum((sum(c == k for r in rows for c in r) / 240) ** 2 for k in X.CATEGORIES)
    assert got.n == 60 and got.kappa == pytest.approx((po - pe) / (1 - pe))
    same = spark.createDataFrame([(1, "abstain"), (1, "abstain")], "item int, category string")
    assert X.fleiss_by(same, [], 2).first().kappa is None
    assert X.fleiss_by(same.where("item = 2").withColumn("by", same.item), ["by"], 2).count() == 0


def test_a_judge_is_swapped(spark):
    first = votes(spark, [[R, R, H], [A, A, R], [R, P, H], [R, None, R]])
    other = spark.createDataFrame([(0, "x", R), (1, "x", A), (2, "x", None), (9, "x", H)], "item int, judge string, label string")
    swapped = X.panel_with(first, "j2", other)
    assert sorted((r.item, r.label) for r in swapped.where("judge = 'x'").collect() if r.label) == [(0, R), (1, A)]
    assert swapped.groupBy("item").count().where("count <> 3").count() == 0 and swapped.where("item = 9").count() == 0
    out = {r.panel: r for r in X.panel_report({"first": first, "swapped": swapped}).collect()}
    assert (out["first"].n, out["first"].unresolved, out["first"].incomplete, out["first"].unanimous) == (4, 0, 1, 0)
    # item 2: one error and none of two votes; item 3: one vote is left
    assert (out["swapped"].n, out["swapped"].unresolved, out["swapped"].incomplete, out["swapped"].unanimous) == (4, 2, 0, 2)
    assert (out["swapped"].fleiss_n, out["swapped"].binary_n, out["first"].fleiss_n) == (2, 1, 3)


def test_a_fourth_judge(spark):
    rows = [[R, R, R, R], [R, R, H, H], [A, A, R, R], [R, None, None, R], [H, H, R, None]]
    v = votes(spark, rows, "c").unionByName(votes(spark, [[R, R, R]], "d"))
    got = {r.condition: r for r in X.condition_summary(v, ["j0", "j1", "j2"], "j3").collect()}
    c, d = got["c"], got["d"]
    assert (c.n, c.n_extra_usable, c.unresolved_official, c.unresolved_sensitivity) == (5, 4, 1, 1)
    # item 1: severities 0 0 2 2, the upper one counts; item 2: two abstentions of four are no majority
    assert (c.ties, c.n_compared, c.changed, c.n_extra_compared) == (1, 4, 2, 3) and c.extra_agreement == pytest.approx(1 / 3)
    assert (c.n_complete_all, c.n_complete_official, d.n_complete_all, d.n_extra_usable, d.extra_agreement) == (3, 4, 0, 0, None)
    numbers = {(r.condition, r.rater): r for r in X.numbers_by_condition(X.condition_raters(v, ["j0", "j1", "j2"])).collect()}
    assert numbers["c", "official"].n_usable == 4 and numbers["c", "sensitivity"].hallucinated == 2 and numbers["d", "j1"].n == 1


def test_places_and_directions_of_judges(spark):
    items = spark.createDataFrame([(r, q, 10 * r + q) for r in (1, 2, 3) for q in (1, 2)], "run int, question_id int, item int")
    labels = {"a": ["RELEVANT", "RELEVANT", "RELEVANT", "PARTIAL", "PARTIAL", "IRRELEVANT"], "b": ["RELEVANT", "IRRELEVANT", "PARTIAL", "IRRELEVANT", "PARTIAL", None], "c": [None] * 6}
    order = [11, 12, 21, 22, 31, 32]
    v = spark.createDataFrame([(i, j, x) for j, xs in labels.items() for i, x in zip(order, xs)], "item int, judge string, label string")
    got = {(r.rater, r.run): r for r in X.judge_detail(items, v, J.RELEVANCE).collect()}
    assert len(got) == 12 and [got["a", r].secondary for r in (1, 2, 3)] == [1.0, 0.75, 0.25] and got["a", 1].direction == X.DECREASING
    assert [got["b", r].secondary for r in (1, 2, 3)] == [0.5, 0.25, 0.5] and got["b", 3].direction == X.NOT_LOWER
    assert got["b", 3].n_left_out == 1 and got["b", 3].place_secondary == 2 and got["c", 2].secondary == 0 and got["c", 2].n_left_out == 2
    assert (got["a", 2].primary, got["a", 2].questions_met, got["a", 3].place_primary) == (0.5, 1, 3)
    panel = [got["panel", r].direction for r in (1, 2, 3)]
    assert len(set(panel)) == 1 and got["a", 1].as_panel == (panel[0] == X.DECREASING)
    assert X.judge_detail(items.where("run = 9"), v, J.RELEVANCE).count() == 0
    whole = X.unanimity(v.where("judge <> 'c'"), 2).first()
    assert (whole.n, whole.n_full, whole.pct_unanimous) == (6, 5, 40.0)


def test_runs_are_checked(spark):
    rows = [("r1", 1, "x", 0, "on", "C"), ("r1", 2, "x", 0, "on", "C"), ("r2", 1, "x", 0, "off", "C"), ("r2", 1, "y", 0, "off", None), ("r2", 3, None, 0, "off", "C"), ("r3", 1, "x", 0, "on", "C"), ("r3", 2, "x", 0, "on", "C")]
    records = spark.createDataFrame(rows, "run string, question_id int, config string, alpha int, grounding string, condition string")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "question_id int")
    keys = spark.createDataFrame([(0, "on"), (0, "off"), (1, "on")], "alpha int, grounding string")
    got = {(r.run, r.problem): r.n for r in X.run_problems(records, ids, ["alpha", "grounding"], keys, {"condition": "C"}).collect()}
    assert got == {
        ("r2", "several configurations"): 3, ("r2", "wrong condition"): 1, ("r2", "repeated questions"): 1, ("r2", "foreign questions"): 1, ("r2", "missing questions"): 1,
        ("alpha=0, grounding=on", "setting of several runs"): 2, ("alpha=1, grounding=on", "no run"): 1,
    }
    assert X.run_problems(records.where("run = 'r1'"), ids, ["alpha", "grounding"], keys.where("alpha = 0 AND grounding = 'on'"), {"condition": "C"}).count() == 0
    given = spark.createDataFrame([("r1", 1, "j", R, "v"), ("r1", 1, "j", None, "v"), ("r1", 7, "j", R, "w"), ("r3", 1, "k", R, None)], "run string, question_id int, judge string, label string, version string")
    found = {(r.run, r.judge, r.problem): r.n for r in X.judgment_problems(records.where("run <> 'r2'"), given, "v").collect()}
    assert found == {
        ("r1", "j", "unjudged questions"): 1, ("r1", "j", "questions judged twice"): 1, ("r1", "j", "unusable judgments"): 1, ("r1", "j", "judgments of another version"): 1, ("r1", "j", "foreign questions"): 1,
        ("r1", "k", "unjudged questions"): 2, ("r3", "j", "unjudged questions"): 2, ("r3", "k", "unjudged questions"): 1, ("r3", "k", "judgments of another version"): 1,
    }


def test_quotes_and_records(spark):
    rows = [(1, "a", ["The  CAT.", "", "a dog"], "the cat sat", "a dog"), (1, "a", None, "x", "y"), (2, "a", ["nowhere"], None, None), (2, "b", [], "x", "y")]
    df = spark.createDataFrame(rows, "item int, judge string, quotes array<string>, r string, c string")
    got = {r.judge: tuple(r)[1:] for r in X.quotes_by_judge(df, "quotes", "r", "c").collect()}
    assert got == {"a": (2, 3, 1, 1, 1), "b": (1, 0, 0, 0, 0)}
    claim = "array<struct<verdict: string, severity: string, reference_conflict: boolean>>"
    rows = [("r", "FULL", R, False, []), ("r", None, None, None, None), ("r", "NONE", A, True, [("UNVERIFIABLE", None, True), ("SUPPORTED", None, False)]), ("s", None, None, None, None)]
    records = spark.createDataFrame(rows, f"run string, completeness string, label string, conflict boolean, claims {claim}")
    out = {r.run: r for r in X.record_summary(records, ["run"]).collect()}
    r, s = out["r"], out["s"]
    assert (r.n, r.n_usable, r.n_full, r.n_none, r.attempt_conflict_rate, r.unverifiable_rate, r.rate_excl_abstain, r.rate_incl_abstain) == (3, 2, 1, 1, 0.5, 0.5, 0.0, 0.5)
    assert r.factual_and_complete_rate == pytest.approx(1 / 3) and r.pct_with_reference_conflict == pytest.approx(100 / 3)
    assert (s.n, s.n_usable, s.factual_and_complete_rate, s.attempt_conflict_rate, s.unverifiable_rate) == (1, 0, 0.0, None, None)
