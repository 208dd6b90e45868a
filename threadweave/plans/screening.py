"""Registered queries of judges and conditions side by side, and of runs checked before they are pooled, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.operators import judging as J
from threadweave.operators import screening as X
from threadweave.operators import verdicts as V
from threadweave.plans.catalogue import A, QUERIES, answers, query, t  # noqa: F401
from threadweave.plans.judged import HL, LABELS, LB
from threadweave.plans.panels import JUDGES, RV, VJ, raw_records, relevance_panel
from threadweave.plans.reports import rounded
from threadweave.sources.files import kept

VOTES = f"{A}, v4 AS (SELECT aid AS item, aid % 3 AS condition, qid, 'j' || j AS judge, CASE WHEN (aid + j) % 11 <> 0 THEN {LB}[1 + (author * (j + 3) + qid + quantity::BIGINT * j) % 5] END AS label FROM a, range(4) r(j))"
LEVELS = f"['{J.FACTUAL}', '{J.PARTLY}', '{J.FULLY}']"


def kind(label: str) -> str:
    return f"CASE WHEN {label} = '{J.ABSTAIN}' THEN 'abstain' WHEN {label} IN {HL} THEN 'hallucinated' WHEN {label} = '{J.FACTUAL}' THEN 'not_hallucinated' END"


def sorted_votes(src: str, by: str) -> str:
    """Of each item: usable votes, abstentions, errors, labels, least and greatest severities in order."""
    low = f"CASE WHEN label IN ('{J.PARTLY}', '{J.UNSPECIFIED}') THEN 1 WHEN label = '{J.FULLY}' THEN 2 ELSE 0 END"
    high = f"CASE WHEN label = '{J.PARTLY}' THEN 1 WHEN label IN ('{J.FULLY}', '{J.UNSPECIFIED}') THEN 2 ELSE 0 END"
    return f"SELECT {by}, count(label) AS n, count(*) FILTER (label = '{J.ABSTAIN}') AS ab, count(*) FILTER (label IN {HL}) AS ha, count(DISTINCT label) AS nl, list_sort(list({low}) FILTER (label IS NOT NULL)) AS lo, list_sort(list({high}) FILTER (label IS NOT NULL)) AS hi FROM {src} GROUP BY {by}"


THREE = f"""CASE WHEN n = 3 THEN CASE WHEN ab >= 2 THEN '{J.ABSTAIN}' WHEN lo[2] = hi[2] THEN {LEVELS}[lo[2] + 1] ELSE '{J.UNSPECIFIED}' END
  WHEN n = 2 THEN CASE WHEN ab = 2 THEN '{J.ABSTAIN}' WHEN ab = 1 OR ha = 1 THEN '{J.UNRESOLVED}' WHEN ha = 0 THEN '{J.FACTUAL}' WHEN lo[1] = hi[1] THEN {LEVELS}[lo[1] + 1] ELSE '{J.UNSPECIFIED}' END ELSE '{J.UNRESOLVED}' END"""


def every(at: str) -> str:
    return f"CASE WHEN n < 3 THEN '{J.UNRESOLVED}' WHEN 2 * ab > n THEN '{J.ABSTAIN}' WHEN lo[{at}] <> hi[{at}] THEN '{J.UNSPECIFIED}' ELSE {LEVELS}[lo[{at}] + 1] END"


def fleiss(src: str, by: str, m: int, kinds: tuple[str, ...] = X.CATEGORIES) -> str:
    total = " + ".join(kinds)
    return f"""SELECT {by}, n, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT {by}, count(*) AS n, avg(({' + '.join(f'{k} * {k}' for k in kinds)} - {m}) / {m * (m - 1)}::DOUBLE) AS po, {' + '.join(f'power(sum({k}) / (count(*) * {m})::DOUBLE, 2)' for k in kinds)} AS pe
  FROM (SELECT {by}, item, count(*) AS m, {', '.join(f"count(*) FILTER (({kind('label')}) = '{k}') AS {k}" for k in kinds)} FROM {src} GROUP BY {by}, item) WHERE m = {m} AND {total} = {m} GROUP BY {by})"""


def votes(spark, sf) -> DataFrame:
    """Votes of four judges j0 to j3 on every answer, in three conditions."""
    v = answers(spark, sf).select(F.col("aid").alias("item"), (F.col("aid") % 3).alias("condition"), "qid", "author", F.col("quantity").cast("bigint").alias("quantity"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    at = ((F.col("author") * (F.col("j") + 3) + F.col("qid") + F.col("quantity") * F.col("j")) % 5 + 1).cast("int")
    label = F.when((F.col("item") + F.col("j")) % 11 != 0, F.element_at(F.array(*[F.lit(x) for x in LABELS]), at))
    return v.select("item", "condition", "qid", F.concat(F.lit("j"), F.col("j").cast("string")).alias("judge"), label.alias("label"))


@query(f"""WITH {VJ}, cc AS (SELECT event_id, count(*) AS n, count(*) FILTER (verdict = 'UNVERIFIABLE') AS u, count(*) FILTER (rc = 'true') AS r FROM cn GROUP BY event_id),
x AS (SELECT js.user_id % 5 AS run, CASE WHEN good THEN label END AS label, CASE WHEN good THEN CASE json_type(v->'completeness') WHEN 'NULL' THEN 'NONE' ELSE upper(trim(v->>'completeness')) END END AS c, CASE WHEN good THEN conflict END AS conflict, CASE WHEN good THEN cc.n END AS n, CASE WHEN good THEN u END AS u, CASE WHEN good THEN r END AS r FROM js JOIN rr USING (event_id) LEFT JOIN cc USING (event_id)),
s AS (SELECT run, count(*) AS n, count(label) AS n_usable, count(*) FILTER (c = 'FULL') AS n_full, count(*) FILTER (c = 'PARTIAL') AS n_partial, count(*) FILTER (c = 'NONE') AS n_none, count(*) FILTER (label IN {HL}) AS n_hallucinated, count(*) FILTER (label = '{J.ABSTAIN}') AS n_abstain,
 count(*) FILTER (label = '{J.FACTUAL}' AND c = 'FULL') AS fc, count(*) FILTER (r > 0) AS rcf, count(*) FILTER (conflict) AS ac, count(conflict) AS acn, sum(coalesce(u, 0)) AS u, sum(coalesce(x.n, 0)) AS m FROM x GROUP BY run)
SELECT run, n, n_usable, n_full, n_partial, n_none, n_hallucinated, n_abstain, round(fc / n, 6) AS factual_and_complete_rate, round(100.0 * rcf / n, 6) AS pct_with_reference_conflict, round(ac / nullif(acn, 0), 6) AS attempt_conflict_rate, round(n_hallucinated / nullif(n_usable - n_abstain, 0), 6) AS rate_excl_abstain, round((n_hallucinated + n_abstain) / nullif(n_usable, 0), 6) AS rate_incl_abstain, round(u / nullif(m, 0), 6) AS unverifiable_rate FROM s""")
def record_summary(spark, sf):
    rows = V.validated(raw_records(spark, sf), "raw", strict=True).withColumn("run", F.col("user_id") % 5)
    return rounded(X.record_summary(rows, ["run"]))


def plain_sql(c: str) -> str:
    return f"""trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'), ' .,;:!?''"()')"""


@query(f"""WITH d AS (SELECT d.doc_id, d.text AS r, c.text AS c FROM documents d JOIN documents c ON c.doc_id = d.doc_id + 1),
q AS (SELECT 'j0' AS judge, doc_id, r, c, [substr(r, 1, 40)] AS q FROM d UNION ALL SELECT 'j1', doc_id, r, c, [substr(c, 1, 30), substr(r, 20, 30)] FROM d UNION ALL SELECT 'j2', doc_id, r, c, ['', 'never said', substr(c, 5, 25)] FROM d WHERE doc_id % 4 <> 0),
p AS (SELECT judge, doc_id, {plain_sql('r')} AS r, {plain_sql('c')} AS c, list_filter(list_transform(q, lambda x: {plain_sql('x')}), lambda x: x <> '') AS q FROM q),
o AS (SELECT judge, doc_id, len(q) AS n, len(list_filter(q, lambda x: NOT contains(r, x))) AS o, len(list_filter(q, lambda x: NOT contains(r, x) AND contains(c, x))) AS v FROM p)
SELECT judge, count(*) AS usable_records, sum(n)::BIGINT AS n_quotes, sum(v)::BIGINT AS violations, count(*) FILTER (v > 0) AS affected_items, sum(o - v)::BIGINT AS in_neither FROM o GROUP BY judge""")
def quotes_by_judge(spark, sf):
    d = t(spark, sf, "documents")
    rows = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("c")), "doc_id").select(F.col("doc_id").alias("item"), F.col("text").alias("r"), "c")
    part = lambda c, a, n: F.substring(c, a, n)
    said = {"j0": F.array(part("r", 1, 40)), "j1": F.array(part("c", 1, 30), part("r", 20, 30)), "j2": F.when(F.col("item") % 4 != 0, F.array(F.lit(""), F.lit("never said"), part("c", 5, 25)))}
    records = rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), q.alias("quotes")) for j, q in said.items()]))).select("s.*", "item", "r", "c")
    return X.quotes_by_judge(records, "quotes", "r", "c")


PANELS = f"""{VOTES}, pv AS (SELECT 'first' AS panel, item, judge, label FROM v4 WHERE judge <> 'j3' UNION ALL SELECT 'swapped', item, judge, CASE WHEN judge <> 'j3' OR item % 10 <> 3 THEN label END FROM v4 WHERE judge <> 'j2'),
ps AS (SELECT *, {THREE} AS panel_label FROM ({sorted_votes('pv', 'panel, item')})),
pc AS (SELECT panel, count(*) AS n, count(*) FILTER (panel_label = '{J.UNRESOLVED}') AS unresolved, count(*) FILTER (n = 2 AND panel_label <> '{J.UNRESOLVED}') AS incomplete, count(*) FILTER (n = 3 AND nl = 1) AS unanimous, {', '.join(f"count(*) FILTER (({kind('panel_label')}) = '{k}') AS n_{k}" for k in X.CATEGORIES)} FROM ps GROUP BY panel)"""


@query(f"WITH {PANELS}, f3 AS ({fleiss('pv', 'panel', 3)}), f2 AS ({fleiss('pv', 'panel', 3, X.CATEGORIES[1:])}) SELECT pc.*, coalesce(f3.n, 0) AS fleiss_n, round(f3.kappa, 6) AS fleiss_kappa, coalesce(f2.n, 0) AS binary_n, round(f2.kappa, 6) AS binary_kappa FROM pc LEFT JOIN f3 USING (panel) LEFT JOIN f2 USING (panel)")
def swapped_panel(spark, sf):
    """The panel of three, and the one in which another judge, who hasn't seen all items, takes the last one's place."""
    v = kept(votes(spark, sf), "votes")
    first = v.where("judge <> 'j3'").select("item", "judge", "label")
    other = v.where("judge = 'j3' AND item % 10 <> 3").select("item", "judge", "label")
    return rounded(X.panel_report({"first": first, "swapped": X.panel_with(first, "j2", other)}))


CONDITIONS = f"""{VOTES}, o3 AS (SELECT condition, item, {THREE} AS label FROM ({sorted_votes("(SELECT * FROM v4 WHERE judge <> 'j3')", 'condition, item')})), s4 AS (SELECT condition, item, {every('(n + 1) // 2')} AS low, {every('n // 2 + 1')} AS high FROM ({sorted_votes('v4', 'condition, item')})),
cr AS (SELECT o3.condition, o3.item, o3.label AS o, low, high, x.label AS x, {kind('o3.label')} AS co, {kind('high')} AS cs, {kind('x.label')} AS cx FROM o3 JOIN s4 USING (item) JOIN v4 x ON x.item = o3.item AND x.judge = 'j3')"""


@query(f"""WITH {CONDITIONS}, f4 AS ({fleiss('v4', 'condition', 4)}), f3 AS ({fleiss("(SELECT * FROM v4 WHERE judge <> 'j3')", 'condition', 3)}), s AS (SELECT condition, count(*) AS n, count(cx) AS n_extra_usable, count(*) FILTER (o = '{J.UNRESOLVED}') AS unresolved_official, count(*) FILTER (high = '{J.UNRESOLVED}') AS unresolved_sensitivity, count(*) FILTER (low <> high) AS ties, count(*) FILTER (co IS NOT NULL AND cs IS NOT NULL) AS n_compared, count(*) FILTER (co <> cs) AS changed,
 count(*) FILTER (co IS NOT NULL AND cx IS NOT NULL) AS n_extra_compared, round(count(*) FILTER (co = cx) / nullif(count(*) FILTER (co IS NOT NULL AND cx IS NOT NULL), 0), 6) AS extra_agreement FROM cr GROUP BY condition) SELECT s.*, coalesce(f4.n, 0) AS n_complete_all, round(f4.kappa, 6) AS fleiss_all, coalesce(f3.n, 0) AS n_complete_official, round(f3.kappa, 6) AS fleiss_official FROM s LEFT JOIN f4 USING (condition) LEFT JOIN f3 USING (condition)""")
def condition_summary(spark, sf):
    return rounded(X.condition_summary(kept(votes(spark, sf), "votes"), JUDGES, "j3"))


@query(f"""WITH {CONDITIONS}, r AS (SELECT condition, judge AS rater, label FROM v4 UNION ALL SELECT condition, 'official', nullif(o, '{J.UNRESOLVED}') FROM cr UNION ALL SELECT condition, 'sensitivity', nullif(high, '{J.UNRESOLVED}') FROM cr), s AS (SELECT condition, rater, count(*) AS n, count(label) AS n_usable, count(*) FILTER (label IN {HL}) AS hallucinated, count(*) FILTER (label = '{J.ABSTAIN}') AS abstain,
 count(*) FILTER (label = '{J.FULLY}') AS "full", count(*) FILTER (label = '{J.PARTLY}') AS partial, count(*) FILTER (label = '{J.UNSPECIFIED}') AS unspecified FROM r GROUP BY ALL) SELECT *, round(hallucinated / nullif(n_usable - abstain, 0), 6) AS rate_excl_abstain, round((hallucinated + abstain) / nullif(n_usable, 0), 6) AS rate_abstain_as_failed, round(abstain / nullif(n_usable, 0), 6) AS abstain_rate FROM s""")
def numbers_by_condition(spark, sf):
    return rounded(X.numbers_by_condition(X.condition_raters(kept(votes(spark, sf), "votes"), JUDGES)))


NL = ", ".join(f"count(*) FILTER (label = '{x}') AS n_{x.lower()}" for x in J.RELEVANCE)


@query(f"""WITH {RV}, rt AS (SELECT item, judge AS rater, label FROM gr WHERE label IS NOT NULL UNION ALL SELECT item, 'panel', panel_label FROM pr WHERE panel_label IN ('RELEVANT', 'PARTIAL', 'IRRELEVANT')), z AS (SELECT run, count(*) AS n_items, count(DISTINCT question_id) AS n_questions FROM it GROUP BY run), k AS (SELECT DISTINCT rater, run, z.n_items, z.n_questions FROM rt, z),
s AS (SELECT run, rater, count(*) AS n, {NL}, count(DISTINCT question_id) FILTER (label = 'RELEVANT') AS met, avg(CASE label WHEN 'RELEVANT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END) AS mean FROM rt JOIN it USING (item) GROUP BY run, rater),
g AS (SELECT rater, run, n_items, n_items - coalesce(n, 0) AS n_left_out, {', '.join(f'coalesce(n_{x.lower()}, 0) AS n_{x.lower()}' for x in J.RELEVANCE)}, n_questions, coalesce(met, 0) AS questions_met, coalesce(met, 0) / n_questions AS "primary", coalesce(mean, 0.0) AS secondary FROM k LEFT JOIN s USING (run, rater)),
d AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY "primary" DESC, run) AS place_primary, row_number() OVER (PARTITION BY rater ORDER BY secondary DESC, run) AS place_secondary, list(secondary) OVER (PARTITION BY rater ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM g),
e AS (SELECT *, CASE WHEN len(list_filter(range(2, len(l) + 1), lambda i: l[i] >= l[i - 1])) = 0 THEN '{X.DECREASING}' WHEN l[-1] < l[1] THEN '{X.LOWER}' ELSE '{X.NOT_LOWER}' END AS direction FROM d)
SELECT * EXCLUDE (l, "primary", secondary), round("primary", 6) AS "primary", round(secondary, 6) AS secondary, direction = max(direction) FILTER (rater = 'panel') OVER (PARTITION BY run) AS as_panel FROM e""")
def judge_detail(spark, sf):
    items, grid, _ = relevance_panel(spark, sf)
    return rounded(X.judge_detail(items.select("run", "question_id", "item"), grid.select("item", "judge", "label"), J.RELEVANCE))


@query(f"WITH {RV}, p AS (SELECT item, count(label) = 3 AS f, min(label) = max(label) AS same FROM gr GROUP BY item) SELECT count(*) AS n, count(*) FILTER (f) AS n_full, round(100.0 * count(*) FILTER (f AND same) / nullif(count(*) FILTER (f), 0), 6) AS pct_unanimous FROM p")
def unanimity(spark, sf):
    return rounded(X.unanimity(relevance_panel(spark, sf)[1].select("item", "judge", "label"), 3))


# runs of answers: seven files for the six settings, and two settings more that have none; a question has several answers
RUNS = f"""{A}, rc AS (SELECT 'r' || (aid % 7) AS run, qid AS question_id, aid % 7 % 6 % 3 AS alpha, CASE WHEN aid % 7 % 6 < 3 THEN 'on' ELSE 'off' END AS grounding, 'c' || (aid % 7) || CASE WHEN aid % 7 = 2 AND qid % 50 = 7 THEN 'x' ELSE '' END AS config, CASE WHEN aid % 97 = 0 THEN NULL ELSE 'C' END AS condition, CASE WHEN aid % 7 = 4 THEN 'linked' ELSE 'thread' END AS mode, aid FROM a),
ex AS (SELECT DISTINCT o_orderkey AS question_id FROM orders WHERE o_orderpriority <> '5-LOW'), jm AS (SELECT run, question_id, j AS judge, CASE WHEN aid % 31 <> 0 THEN {LB}[1 + (aid + j) % 5] END AS label, CASE WHEN aid % 43 = 0 THEN 'v2' ELSE 'v3' END AS version FROM rc, range(2) r(j) WHERE (aid + j) % 13 <> 0
  UNION ALL SELECT run, question_id + 1000000000, 0, '{J.FACTUAL}', 'v3' FROM rc WHERE aid % 701 = 0)"""


def runs(spark, sf) -> DataFrame:
    a = F.col("aid")
    run = a % 7
    config = F.concat(F.lit("c"), run.cast("string"), F.when((run == 2) & (F.col("qid") % 50 == 7), "x").otherwise(""))
    return answers(spark, sf).select(F.concat(F.lit("r"), run.cast("string")).alias("run"), F.col("qid").alias("question_id"), (run % 6 % 3).alias("alpha"), F.when(run % 6 < 3, "on").otherwise("off").alias("grounding"), config.alias("config"), F.when(a % 97 != 0, "C").alias("condition"), F.when(run == 4, "linked").otherwise("thread").alias("mode"), "aid")


@query(f"""WITH {RUNS}, ag AS (SELECT run, count(*) AS n, count(DISTINCT question_id) AS nq, count(DISTINCT config) AS nc, count(*) FILTER (condition IS DISTINCT FROM 'C') AS wc, count(*) FILTER (mode <> 'thread') AS wm, count(DISTINCT question_id) FILTER (question_id IN (SELECT question_id FROM ex)) AS hits FROM rc GROUP BY run),
st AS (SELECT alpha, grounding, count(DISTINCT run) AS r FROM rc GROUP BY ALL), pb AS (SELECT run, 'several configurations' AS problem, CASE WHEN nc > 1 THEN nc ELSE 0 END AS n FROM ag UNION ALL SELECT run, 'wrong condition', wc FROM ag UNION ALL SELECT run, 'wrong mode', wm FROM ag UNION ALL SELECT run, 'repeated questions', n - nq FROM ag UNION ALL SELECT run, 'foreign questions', nq - hits FROM ag UNION ALL SELECT run, 'missing questions', (SELECT count(*) FROM ex) - hits FROM ag
  UNION ALL SELECT 'alpha=' || alpha || ', grounding=' || grounding, 'setting of several runs', r FROM st WHERE r > 1 UNION ALL SELECT 'alpha=' || k.alpha || ', grounding=' || k.grounding, 'no run', 1 FROM (SELECT * FROM range(4) a(alpha), (VALUES ('on'), ('off')) g(grounding)) k ANTI JOIN st ON st.alpha = k.alpha AND st.grounding = k.grounding) SELECT run, problem, n::BIGINT AS n FROM pb WHERE n > 0""")
def run_problems(spark, sf):
    expected = t(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("question_id"))
    keys = spark.range(4).select(F.col("id").alias("alpha"), F.explode(F.array(F.lit("on"), F.lit("off"))).alias("grounding"))
    return X.run_problems(kept(runs(spark, sf), "runs"), expected, ["alpha", "grounding"], keys, {"condition": "C", "mode": "thread"})


def judgments(records: DataFrame) -> DataFrame:
    """Two judges' judgments of the runs' answers, and some of questions that the runs lack."""
    a, j = F.col("aid"), F.col("judge")
    given = records.withColumn("judge", F.explode(F.array(F.lit(0), F.lit(1)))).where((a + j) % 13 != 0)
    label = F.when(a % 31 != 0, F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((a + j) % 5 + 1).cast("int")))
    rows = given.select("run", "question_id", "judge", label.alias("label"), F.when(a % 43 == 0, "v2").otherwise("v3").alias("version"))
    return rows.union(records.where(a % 701 == 0).select("run", F.col("question_id") + 1_000_000_000, F.lit(0), F.lit(J.FACTUAL), F.lit("v3")))


@query(f"""WITH {RUNS}, gv AS (SELECT run, question_id, judge, count(*) AS k, count(*) FILTER (label IS NULL) AS bad, count(*) FILTER (version <> 'v3') AS old FROM jm GROUP BY ALL), gd AS (SELECT DISTINCT run, question_id, j AS judge, true AS asked FROM rc, range(2) r(j)),
bt AS (SELECT run, judge, count(*) FILTER (asked AND k IS NULL) AS unjudged, count(*) FILTER (k > 1) AS twice, coalesce(sum(bad), 0) AS bad, coalesce(sum(old), 0) AS old, count(*) FILTER (asked IS NULL) AS alien FROM gd FULL JOIN gv USING (run, question_id, judge) GROUP BY ALL)
SELECT run, judge, problem, n::BIGINT AS n FROM (SELECT run, judge, 'unjudged questions' AS problem, unjudged AS n FROM bt UNION ALL SELECT run, judge, 'questions judged twice', twice FROM bt UNION ALL SELECT run, judge, 'unusable judgments', bad FROM bt UNION ALL SELECT run, judge, 'judgments of another version', old FROM bt UNION ALL SELECT run, judge, 'foreign questions', alien FROM bt) WHERE n > 0""")
def judgment_problems(spark, sf):
    records = kept(runs(spark, sf), "runs")
    return X.judgment_problems(records, judgments(records), "v3")


@query(f"""WITH {RUNS}, jd AS (SELECT alpha, grounding, CASE WHEN aid % 31 <> 0 THEN {LB}[1 + aid % 5] END AS label FROM rc),
s AS (SELECT alpha, grounding, grouping(grounding)::INT AS level, count(*) AS n, count(label) AS u, count(*) FILTER (label = '{J.ABSTAIN}') AS n_abstain, count(*) FILTER (label = '{J.FACTUAL}') AS n_not_hallucinated, count(*) FILTER (label IN {HL}) AS n_hallucinated, count(*) FILTER (label = '{J.FULLY}') AS n_full, count(*) FILTER (label = '{J.PARTLY}') AS n_partial, count(*) FILTER (label = '{J.UNSPECIFIED}') AS n_unspecified FROM jd GROUP BY GROUPING SETS ((alpha, grounding), (alpha)))
SELECT * EXCLUDE (u), round(n_hallucinated / nullif(u - n_abstain, 0), 6) AS rate_excl_abstain, round((n_hallucinated + n_abstain) / nullif(u, 0), 6) AS rate_incl_abstain, round(n_abstain / n, 6) AS abstain_rate FROM s""")
def pooled_counts(spark, sf):
    a = F.col("aid")
    label = F.when(a % 31 != 0, F.element_at(F.array(*[F.lit(x) for x in LABELS]), (a % 5 + 1).cast("int")))
    return rounded(X.pooled_counts(runs(spark, sf).withColumn("label", label), "alpha", "grounding"))
