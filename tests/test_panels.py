"""Panels with votes that are missing, the audit's edges, tables by mode, and batches that are broken off."""

import pytest
from pyspark.sql import functions as F

from threadweave.operators import leakage, panels
from threadweave.sources.files import overwrite_parts, read_part
from threadweave.streaming import settled

SCORES = {"RELEVANT": 1.0, "PARTIAL": 0.5, "IRRELEVANT": 0.0}


def test_panel_states(spark):
    items = spark.createDataFrame([(i, "r") for i in range(6)], "item long, run string")
    votes = spark.createDataFrame(
        [(0, "a", "RELEVANT"), (0, "b", "PARTIAL"), (0, "c", "IRRELEVANT"), (1, "a", "RELEVANT"), (1, "b", "RELEVANT"), (1, "c", None), (2, "a", "PARTIAL"), (2, "b", "IRRELEVANT"), (3, "a", "PARTIAL"), (3, "a", None), (4, "b", None), (9, "a", "RELEVANT"), (5, "x", "PARTIAL")],
        "item long, judge string, label string",
    )
    grid = panels.panel_grid(items, ["a", "b", "c"], votes)
    assert grid.count() == 18
    got = {r["item"]: tuple(r)[1:] for r in panels.panel_records(grid, ["a", "b", "c"], SCORES).collect()}
    assert got == {
        0: (3, 0, 0, "complete", "PARTIAL", "median", 0.5, 0.5), 1: (2, 1, 0, "partial", "RELEVANT", "majority", 1.0, None), 2: (2, 0, 1, "partial", "UNRESOLVED", None, None, None),
        3: (1, 0, 2, "insufficient", "INCOMPLETE", None, None, None), 4: (0, 1, 2, "none", "INCOMPLETE", None, None, None), 5: (0, 0, 3, "none", "INCOMPLETE", None, None, None),
    }
    records = panels.panel_records(grid, ["a", "b", "c"], SCORES)
    whole = panels.panel_summary(records, items, ["run"], list(SCORES)).where("level = 1").first()
    assert (whole.n_items, whole.n_decided, whole.n_incomplete, whole.n_unresolved, whole.panels_partial) == (6, 2, 3, 1, 2)
    shown = items.select("run", F.lit(1).alias("question_id"), F.col("item").alias("rank"), "item")
    two = {r.rater: r for r in panels.relevance_by_rater(shown, grid.where("judge <> 'c'"), records, ["a", "b", "c"], SCORES).collect()}
    assert set(two) == {"a", "b"} and not two["a"].complete and two["a"].n_rated == 4


def test_agreement_without_overlap_or_spread(spark):
    rows = [(1, "a", "FAKTUAL", "r"), (1, "b", "FAKTUAL", "r"), (2, "a", "ABSTAIN", "r"), (2, "b", "ABSTAIN", "r"), (3, "a", "odd", "r"), (3, "b", "FAKTUAL", "r"), (4, "c", "FAKTUAL", "s")]
    ratings = spark.createDataFrame(rows, "item long, rater string, label string, run string")
    got = {(r.reading, r.level): (r.n, r.n_left_out, r.agreement, r.kappa) for r in panels.agreement(ratings, "run").collect()}
    assert got[("three_categories", 0)] == got[("three_categories", 1)] == (2, 0, 1.0, 1.0)
    assert got[("abstain_excluded", 1)] == (1, 1, 1.0, None) and got[("abstain_not_hallucinated", 1)] == (2, 0, 1.0, None)
    changed = spark.createDataFrame([(2, "b", "HALUSINASI_PENUH"), (1, "b", None)], "item long, rater string, label string")
    got = {(r.reading, r.level): (r.n, r.agreement) for r in panels.agreement(ratings, "run", changed).collect()}
    assert got[("three_categories", 1)] == (1, 0.0)


def test_pairs_share(spark):
    long = "The quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(1, long, "x" + long[3:60] + "y"), (2, long, long[:49] + "#"), (3, None, long), (4, "", ""), (5, "é" * 50, "é" * 60), (6, long[:50], long)]
    got = {r.k: r.shares for r in leakage.pairs_share(spark.createDataFrame(rows, "k long, a string, b string"), "a", "b").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_audit_of_runs_without_items(spark):
    runs = spark.createDataFrame([("B", 1, 2.0), ("B", 2, None), ("C", 1, 1.0)], "condition string, query long, latency double")
    items = spark.createDataFrame([("B", 1, 7, "text", 0.99), ("B", 1, 8, None, None)], "condition string, query long, id long, text string, sim double")
    out = spark.createDataFrame([("m", 1, 8), ("m", 1, 8)], "mode string, query long, id long")
    none = spark.createDataFrame([], "condition string, query long, slot int, n_answers int, n_left int")
    got = {r.condition: r for r in leakage.audit(runs, items, out, spark.createDataFrame([(1, "t")], "query long, text string"), none, ["m", "other"], 2).collect()}
    b, c = got["B"], got["C"]
    assert (b.n, b.self_m, b.self_m_pct, b.self_other, b.cosine, b.substring, b.any_leak, b.n_short, b.n_empty, b.n_slots) == (2, 1, 50.0, 0, 1, 0, 1, 1, 1, 0)
    assert (b.mean_best_sim, b.latency_mean) == (0.495, 1.0) and b.latency_p95 == pytest.approx(1.9)
    assert (c.n, c.self_m, c.any_leak, c.n_empty, c.mean_best_sim) == (1, 0, 0, 1, 0.0)


def test_one_mode_is_read_and_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "sets")
    sets = spark.createDataFrame([(1, [1, 2], "thread"), (2, [2], "thread"), (1, [1, 9], "dup"), (3, [3], None)], "query long, ids array<long>, mode string")
    overwrite_parts(sets, path, "mode")
    overwrite_parts(spark.createDataFrame([(5, [5], "dup")], sets.schema), path, "mode")
    one = read_part(sets, path, "mode", "thread")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(mode" in plan
    assert sorted((r.query, r.ids) for r in one.collect()) == [(1, [1, 2]), (2, [2])]
    assert [(r.query, r.ids) for r in read_part(sets, path, "mode", "dup").collect()] == [(5, [5])]
    assert spark.read.schema(sets.schema).parquet(path).where("mode IS NULL").count() == 1


@pytest.mark.parametrize("kind", [settled.RESULTS, settled.FAILURES, settled.RESOLVED])
def test_batches_broken_off_between_writes(spark, tmp_path, monkeypatch, kind):
    """The driver stops before one of a batch's writes; a restart gives the same tables as a run that never stopped."""
    judge = lambda rows: rows.select("k", "part", F.when(F.col("ok"), F.concat(F.lit("a"), F.col("k").cast("string"))).alias("answer"))
    like = spark.createDataFrame([], "k long, part int, ok boolean")
    files = [[(1, True), (2, False), (2, False), (3, False)], [(1, False), (2, True), (4, True)], [(3, False), (4, True), (5, False), (5, True)]]

    def run(name, stop):
        folder, wrote, write = str(tmp_path / name), [], settled.write_batch
        for n, rows in enumerate(files):
            spark.createDataFrame([(k, n, ok) for k, ok in rows], like.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

        def broken(rows, path):
            if stop and f"/{kind}/batch=1" in path and not wrote:
                wrote.append(path)
                raise OSError("stopped here")
            write(rows, path)

        monkeypatch.setattr(settled, "write_batch", broken)
        go = lambda: settled.judge_stream(settled.file_stream(spark, f"{folder}/in", like), judge, f"{folder}/out", f"{folder}/state", ["k"], "answer")
        if stop:
            with pytest.raises(Exception, match="stopped here"):
                go()
        go()
        monkeypatch.setattr(settled, "write_batch", write)
        tables = {x: sorted((r.k, r.answer, r.batch) for r in settled.stored(judge(like), f"{folder}/out", x).collect()) for x in (settled.RESULTS, settled.FAILURES, settled.RESOLVED)}
        rest = sorted(r.k for r in settled.open_failures(judge(like), f"{folder}/out", ["k"]).collect())
        todo = sorted(r.k for r in settled.pending(spark.range(1, 8).withColumnRenamed("id", "k"), judge(like), f"{folder}/out", ["k"]).collect())
        return tables, rest, todo, bool(wrote)

    tables, rest, todo, stopped = run("stopped", True)
    assert stopped and sorted(k for k, _, _ in tables[settled.RESULTS]) == [1, 2, 4, 5]
    assert {k for k, _, _ in tables[settled.FAILURES]} >= {3} and rest == [3] and todo == [3, 6, 7]
    # every batch wrote its folders once
    assert len(tables[settled.RESULTS]) == len({k for k, _, _ in tables[settled.RESULTS]})
    for x in (settled.FAILURES, settled.RESOLVED):
        assert len({(k, b) for k, _, b in tables[x]}) == len(tables[x])


def test_batches_one_after_the_other(spark, tmp_path):
    """What each batch adds, written by hand in order, and again."""
    path = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "k long, answer string")
    batches = [[(1, "a"), (2, None), (2, None), (3, None)], [(1, None), (2, "b"), (4, "d")], [(3, None), (4, "e"), (5, None), (5, "f")]]
    for n in (0, 1, 1, 2, 0, 2):
        settled.settle(frame(batches[n]), n, path, ["k"], "answer")
    read = lambda kind: sorted((r.batch, r.k) for r in settled.stored(frame([]), path, kind).collect())
    assert read(settled.RESULTS) == [(0, 1), (1, 2), (1, 4), (2, 5)]
    assert read(settled.FAILURES) == [(0, 2), (0, 3), (2, 3), (2, 5)]
    assert read(settled.RESOLVED) == [(1, 2), (2, 5)]


def test_reputations_and_columns(spark, tmp_path):
    from threadweave.sources.files import missing_columns, reputations

    wanted = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")
    parquet, csv = str(tmp_path / "users.parquet"), str(tmp_path / "users.csv")
    get = lambda: sorted(((r.id, r.reputation) for r in reputations(spark, parquet, csv, wanted).collect()), key=str)
    assert get() == []
    (tmp_path / "users.csv").write_text("Id,Reputation,Name\n1,10,a\n2,x,b\nbad,3,c\n5,50,d\n")
    assert get() == [(1, 10), (2, None)]
    spark.createDataFrame([(1, 100, "a"), (9, 900, "b"), (7, 7, "c")], "id long, reputation long, name string").write.parquet(parquet)
    assert get() == [(1, 100), (9, 900)]
    assert missing_columns(wanted, ["b", "id", "a"]) == ["b", "a"]
