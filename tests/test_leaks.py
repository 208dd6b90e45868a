"""Anchors that near-duplicates and answers are kept out of."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from threadweave.operators import dual_level as D
from threadweave.operators import leakage
from threadweave.operators import retrieval as R
from threadweave.plans import catalogue, judged, panels, reports  # noqa: F401


def test_answers_are_not_excluded_by_ids_of_questions(spark):
    similar = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (1, 4, 0.3)], "query long, id long, sim double")
    answers = spark.createDataFrame([(2, 9), (4, 10)], "qid long, aid long")
    out = spark.createDataFrame([(1, 9)], "query long, id long")
    ids = lambda *more: [r.id for r in R.answerable_anchors(similar, out, answers, 2, 5, *more).orderBy("id").collect()]
    assert ids() == [2, 4] and ids(out) == [4]


def test_near_duplicates_are_passed_over(spark):
    """In one block and in several, with the query's own vector and with another one as the bar."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[40:] = v[:20] * 3
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")

    def best(at, by):
        return set(sorted([j for j in range(60) if j != at and sims[at, j] < 0.6], key=lambda j: (-sims[by, j], j))[:3])

    for block in (None, 17):
        got = R.nearest(df, df, 3, block=block, below=0.6).groupBy("query").agg(F.collect_set("id").alias("ids")).collect()
        assert {r.query: set(r.ids) for r in got} == {i: best(i, i) for i in range(60)}
        asked = spark.createDataFrame([(i, v[(i + 1) % 60].tolist(), v[i].tolist(), 3) for i in range(60)], "id long, v array<double>, bar array<double>, k long")
        got = R.best_of_blocks(asked, df, -1.0, block, 0.6).groupBy("query").agg(F.collect_set("id").alias("ids")).collect()
        assert {r.query: set(r.ids) for r in got} == {i: best(i, (i + 1) % 60) for i in range(60)}


def test_expansion_has_room_for_what_is_near_the_query(spark):
    """All of the seed's first neighbours are near-duplicates of the query, of which the seed itself has fewer."""
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    at = {1: 0.0, 2: 73.0, 9: 160.0, 10: 150.0} | {20 + k: 55.0 + k / 10 for k in range(40)}
    v = spark.createDataFrame([(i, turn(d)) for i, d in at.items()], "id long, v array<double>")
    answers = v.select(F.col("id").alias("qid"), F.col("id").alias("aid"))
    seeds = spark.createDataFrame([(1, 2, 1)], "query long, id long, rank int")
    assert [(r.seed, r.id) for r in D.expanded(seeds, v, answers, 0.3, 2).orderBy("id").collect()] == [(2, 9), (2, 10)]


#: Queries that need near-duplicates of candidates only.
NO_PAIRS = ["leakage_safe_anchors", "anchors_without_leakage", "corpus_hits_with_text", "fused_answers", "fused_by_similarity", "fused_uniform", "fused_and_refilled", "reranked_by_alpha", "retrieval_path_graph", "dual_level_answers", "semantic_expansion", "alternative_paths", "high_level_by_weight", "high_level_filled", "selection_trace", "linked_sensitivity", "leakage_audit"]


@pytest.mark.parametrize("name", NO_PAIRS)
def test_near_duplicates_are_not_listed(spark, monkeypatch, name):
    """All pairs of near-duplicates grow with the square of the vectors."""
    def listed(*args, **columns):
        raise AssertionError("all near-duplicates are listed")

    monkeypatch.setattr(R, "similar_pairs", listed)
    assert catalogue.QUERIES[name](spark, SF_SMALL).columns


@pytest.mark.parametrize("n", [1, 20, 24, 25, 50])
def test_pairs_that_share_a_run(spark, n):
    """Least hashes lose no pair, wherever the run lies and however long the texts are."""
    import random

    r = random.Random(n)
    texts = {k: "".join(r.choice("abé ") for _ in range(r.choice([0, n - 1, n, n + 1, 3 * n, 400]))) for k in range(40)} | {90: None}
    for k in range(40, 60):
        run, x = "".join(r.choice("abcdef") for _ in range(n - k % 2)), texts[k - 40]
        at = r.randrange(len(x) + 1)
        texts[k], texts[k - 40] = run + texts[k - 20], x[:at] + run + x[at:]
    pairs = [(i, j) for i in texts for j in texts if i != j]
    got = leakage.sharing_pairs(spark.createDataFrame(pairs, "query long, id long"), spark.createDataFrame(list(texts.items()), "k long, text string"), "k", n=n).collect()
    runs = {k: {t[a : a + n] for a in range(len(t or "") - n + 1)} if (t := texts[k]) else set() for k in texts}
    assert {(x.query, x.id) for x in got} == {(i, j) for i, j in pairs if runs[i] & runs[j]}


def test_nothing_is_similar_to_itself(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "id long, v array<double>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "query long, id long")
    assert [tuple(r) for r in R.similar_among(pairs, v, 0.3).collect()] == [(1, 2)]
