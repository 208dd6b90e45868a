"""Registered queries of judges' panels, nested judge records, the leakage audit, tables by mode and settled batches, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.operators import judging as J
from threadweave.operators import leakage, panels, reports, sampling
from threadweave.operators import retrieval as R
from threadweave.operators import verdicts as V
from threadweave.plans.catalogue import A, EX, LK, QUERIES, answers, excluded, linked, query, scratch, t, vectors  # noqa: F401
from threadweave.plans.judged import LABELS, VT, votes
from threadweave.plans.reports import rounded
from threadweave.sources.files import kept, overwrite_parts, read_part
from threadweave.streaming import settled

JUDGES = ["j0", "j1", "j2"]
RELEVANCE = "['" + "', '".join(J.RELEVANCE) + "']"

# relevance votes: some calls fail, some were never made
RV = f"""{A}, it AS (SELECT aid AS item, qid AS question_id, ['B', 'C', 'D'][1 + aid % 3] AS run, line % 4 AS hop, row_number() OVER (PARTITION BY aid % 3, qid ORDER BY score DESC, aid) AS rank, author, quantity FROM a),
rv AS (SELECT item, 'j' || j AS judge, CASE WHEN (item + j) % 11 <> 0 THEN {RELEVANCE}[1 + (author * (j + 3) + question_id + quantity::BIGINT * j) % 3] END AS label FROM it, range(3) r(j) WHERE (item + 2 * j) % 13 <> 0),
gr AS (SELECT it.*, 'j' || j AS judge, label, CASE WHEN label IS NOT NULL THEN 'usable' WHEN rv.item IS NOT NULL THEN 'failed' ELSE 'missing' END AS state, CASE label WHEN 'RELEVANT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'IRRELEVANT' THEN 0.0 END::DOUBLE AS score FROM it CROSS JOIN range(3) r(j) LEFT JOIN rv ON rv.item = it.item AND rv.judge = 'j' || j),
pn AS (SELECT item, count(label) AS n_usable, count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (state = 'missing') AS n_missing, greatest(count(*) FILTER (label = 'RELEVANT'), count(*) FILTER (label = 'PARTIAL'), count(*) FILTER (label = 'IRRELEVANT')) AS top, mode(label) AS most, avg(score) AS mean FROM gr GROUP BY item),
pr AS (SELECT item, n_usable, n_failed, n_missing, CASE n_usable WHEN 3 THEN 'complete' WHEN 2 THEN 'partial' WHEN 1 THEN 'insufficient' ELSE 'none' END AS completeness, CASE WHEN n_usable < 2 THEN 'INCOMPLETE' WHEN top >= 2 THEN most WHEN n_usable = 3 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS panel_label,
  CASE WHEN n_usable < 2 THEN NULL WHEN top >= 2 THEN 'majority' WHEN n_usable = 3 THEN 'median' END AS decided_by, CASE WHEN n_usable = 3 THEN mean END AS mean_judge_score FROM pn),
ps AS (SELECT *, CASE panel_label WHEN 'RELEVANT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'IRRELEVANT' THEN 0.0 END::DOUBLE AS panel_score FROM pr)"""
NL = ", ".join(f"count(*) FILTER ({{}} = '{x}') AS n_{x.lower()}" for x in J.RELEVANCE)


def relevance_items(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    run = F.element_at(F.array(*[F.lit(x) for x in "BCD"]), (F.col("aid") % 3 + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy(F.col("aid") % 3, "qid").orderBy(F.desc("score"), "aid"))
    return answers(spark, sf).select(F.col("aid").alias("item"), F.col("qid").alias("question_id"), run.alias("run"), (F.col("line") % 4).alias("hop"), rank.cast("bigint").alias("rank"), "author", F.col("quantity").cast("bigint").alias("quantity"))


def relevance_panel(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, the grid of judges and the panel's records."""
    items = kept(relevance_items(spark, sf), "items")
    j = F.col("j")
    rows = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("item") + 2 * j) % 13 != 0)
    at = ((F.col("author") * (j + 3) + F.col("question_id") + F.col("quantity") * j) % 3 + 1).cast("int")
    label = F.when((F.col("item") + j) % 11 != 0, F.element_at(F.array(*[F.lit(x) for x in J.RELEVANCE]), at))
    grid = kept(panels.panel_grid(items, JUDGES, rows.select("item", F.concat(F.lit("j"), j.cast("string")).alias("judge"), label.alias("label"))), "grid")
    return items, grid, kept(panels.panel_records(grid, JUDGES, J.RELEVANCE), "panel")


@query(f"WITH {RV} SELECT item, n_usable, n_failed, n_missing, completeness, panel_label, decided_by, panel_score, round(mean_judge_score, 6) AS mean_judge_score FROM ps")
def panel_records(spark, sf):
    return rounded(relevance_panel(spark, sf)[2])


@query(f"WITH {RV}, s AS (SELECT run, hop, ps.* FROM ps JOIN it USING (item)) SELECT run, hop, grouping(run, hop)::INT AS level, count(*) AS n_items, count(*) FILTER (panel_label NOT IN ('INCOMPLETE', 'UNRESOLVED')) AS n_decided, count(*) FILTER (panel_label = 'INCOMPLETE') AS n_incomplete, count(*) FILTER (panel_label = 'UNRESOLVED') AS n_unresolved, count(*) FILTER (decided_by = 'majority') AS by_majority, count(*) FILTER (decided_by = 'median') AS by_median, {NL.format(*['panel_label'] * 3)}, round(avg(panel_score), 6) AS panel_mean, round(avg(mean_judge_score), 6) AS judge_mean, {', '.join(f"count(*) FILTER (completeness = '{x}') AS panels_{x}" for x in ('complete', 'partial', 'insufficient', 'none'))} FROM s GROUP BY ROLLUP (run, hop)")
def panel_summary(spark, sf):
    items, _, records = relevance_panel(spark, sf)
    return rounded(panels.panel_summary(records, items, ["run", "hop"], list(J.RELEVANCE)))


@query(f"WITH {RV} SELECT judge, run, grouping(judge, run)::INT AS level, {', '.join(f"count(*) FILTER (state = '{x}') AS n_{x}" for x in ('usable', 'failed', 'missing'))}, round(avg(score), 6) AS mean_score, {NL.format(*['label'] * 3)} FROM gr GROUP BY GROUPING SETS ((judge, run), (judge))")
def judge_summary(spark, sf):
    return rounded(panels.judge_summary(relevance_panel(spark, sf)[1], ["run"], J.RELEVANCE))


@query(f"""WITH {RV}, rt AS (SELECT item, judge AS rater, label FROM gr WHERE label IS NOT NULL UNION ALL SELECT item, 'panel', panel_label FROM pr WHERE panel_label IN ('RELEVANT', 'PARTIAL', 'IRRELEVANT')), z AS (SELECT run, count(*) AS n_items, count(DISTINCT question_id) AS nq FROM it GROUP BY run),
s AS (SELECT run, rater, count(*) AS n_rated, {', '.join(f"round(100.0 * count(*) FILTER (label = '{x}') / count(*), 6) AS pct_{x.lower()}" for x in J.RELEVANCE)}, count(DISTINCT question_id) FILTER (label = 'RELEVANT') AS met, round(avg(CASE label WHEN 'RELEVANT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END), 6) AS mean_score FROM rt JOIN it USING (item) GROUP BY run, rater)
SELECT run, rater, n_rated, pct_relevant, pct_partial, pct_irrelevant, mean_score, n_items, true AS complete, round(100.0 * met / nq, 6) AS pct_questions FROM s JOIN z USING (run)""")
def relevance_by_rater(spark, sf):
    items, grid, records = relevance_panel(spark, sf)
    return rounded(panels.relevance_by_rater(items.select("run", "question_id", "rank", "item"), grid, records, JUDGES, J.RELEVANCE))


def reading_sql(label: str, reading: str) -> str:
    abstain, error, right = panels.READINGS[reading]
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return f"CASE WHEN {label} = '{J.ABSTAIN}' THEN {text(abstain)} WHEN {label} = '{J.FACTUAL}' THEN {text(right)} WHEN {label} IS NOT NULL THEN {text(error)} END"


AG = f"""{VT}, rt AS (SELECT item, 'j' || judge AS rater, label, run FROM vt UNION ALL SELECT item, 'human', label, run FROM vt WHERE judge = 1 AND item % 5 = 0 AND item % 3 <> 0 UNION ALL SELECT item, 'human', '{J.ABSTAIN}', run FROM vt WHERE judge = 1 AND item % 5 = 0 AND item % 3 = 0),
pr AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.run, a.label AS x, b.label AS y FROM rt a JOIN rt b ON a.item = b.item AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL),
rd AS ({' UNION ALL '.join(f"SELECT '{r}' AS reading, rater_a, rater_b, run, {reading_sql('x', r)} AS x, {reading_sql('y', r)} AS y FROM pr" for r in panels.READINGS)}),
lv AS (SELECT reading, rater_a, rater_b, run, 0 AS level, x, y FROM rd UNION ALL SELECT reading, rater_a, rater_b, NULL, 1, x, y FROM rd),
nn AS (SELECT reading, rater_a, rater_b, run, level, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, count(*) FILTER (x IS NULL OR y IS NULL) AS n_left_out, count(*) FILTER (x = y) AS same FROM lv GROUP BY ALL),
mx AS (SELECT reading, rater_a, rater_b, run, level, x AS k, count(*)::DOUBLE AS c FROM lv WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), my AS (SELECT reading, rater_a, rater_b, run, level, y AS k, count(*)::DOUBLE AS c FROM lv WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
pe AS (SELECT mx.reading, mx.rater_a, mx.rater_b, mx.run, mx.level, sum(mx.c * my.c) AS s FROM mx JOIN my ON mx.reading = my.reading AND mx.rater_a = my.rater_a AND mx.rater_b = my.rater_b AND mx.run IS NOT DISTINCT FROM my.run AND mx.level = my.level AND mx.k = my.k GROUP BY ALL)"""


@query(f"WITH {AG} SELECT nn.reading, nn.rater_a, nn.rater_b, nn.run, nn.level, n, n_left_out, round(same / nullif(n, 0), 6) AS agreement, round(CASE WHEN coalesce(s, 0) / (n::DOUBLE * n) < 1 THEN (same / n - coalesce(s, 0) / (n::DOUBLE * n)) / (1 - coalesce(s, 0) / (n::DOUBLE * n)) END, 6) AS kappa FROM nn LEFT JOIN pe ON nn.reading = pe.reading AND nn.rater_a = pe.rater_a AND nn.rater_b = pe.rater_b AND nn.run IS NOT DISTINCT FROM pe.run AND nn.level = pe.level")
def agreement_in_all_readings(spark, sf):
    v = votes(spark, sf).select("item", F.concat(F.lit("j"), F.col("judge").cast("string")).alias("rater"), "label", "run")
    human = v.where("rater = 'j1' AND item % 5 = 0").withColumn("rater", F.lit("human"))
    changed = human.where("item % 3 = 0").select("item", "rater", F.lit(J.ABSTAIN).alias("label"))
    return rounded(panels.agreement(v.union(human), "run", changed))


# judge records of events, some of them broken, nested as a judge writes them
VD, SV, CF, LB, CM = "['supported', 'CONTRADICTED', ' fabricated', 'Unverifiable', 'odd']", """['"core"', '"MINOR"', 'null', '"none"', '"grave"', '"null"']""", """['true', '"false"', 'false', '"TRUE "', '0']""", "['FAKTUAL', 'abstain', 'HALUSINASI_PENUH', ' halusinasi_sebagian', 'unknown']", """['"full"', '"Partial"', 'null', '"none"']"""
RAW = f"""rw AS (SELECT event_id, user_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE (CASE WHEN event_id % 13 = 0 THEN 'Sure: ' ELSE '' END) || '{{"answer_attempted": ' || (CASE event_id % 7 WHEN 0 THEN 'false' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN '"true"' ELSE 'true' END ELSE 'true' END) || ', "completeness": ' || {CM}[1 + event_id % 4] || ', "label": "' || {LB}[1 + (event_id // 3) % CASE WHEN event_id % 10 = 0 THEN 5 ELSE 4 END] || '", "claims": [' ||
  array_to_string(list_transform(range(0, event_id % 4), lambda i: '{{"verdict": "' || {VD}[1 + (event_id + i * 7) % CASE WHEN event_id % 23 = 0 THEN 5 ELSE 4 END] || '", "severity": ' || {SV}[1 + (event_id // 2 + i) % CASE WHEN event_id % 19 = 0 THEN 5 ELSE 4 END] || ', "reference_conflict": ' || {CF}[1 + (event_id + i) % CASE WHEN event_id % 17 = 0 THEN 5 ELSE 4 END] || '}}'), ', ') || ']' || (CASE WHEN event_id % 31 = 0 THEN '' ELSE '}}' END) END AS raw FROM events)"""
VJ = f"""{RAW}, js AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON WHEN json_valid(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(raw, '(?s)\\{{.*\\}}')::JSON END AS v FROM rw),
cl AS (SELECT event_id, c, upper(trim(c->>'verdict')) AS verdict, json_type(c->'severity') AS st, upper(trim(c->>'severity')) AS sv, json_type(c->'reference_conflict') AS rt, lower(trim(c->>'reference_conflict')) AS rc FROM (SELECT event_id, unnest(json_extract(v, '$.claims[*]')) AS c FROM js WHERE v IS NOT NULL)),
cn AS (SELECT *, st = 'VARCHAR' AND sv IN ('NULL', 'NONE') AS nullish, CASE WHEN st <> 'NULL' AND NOT (st = 'VARCHAR' AND sv IN ('NULL', 'NONE')) THEN sv END AS severity, verdict IN ('CONTRADICTED', 'FABRICATED') AS error FROM cl),
cg AS (SELECT event_id, bool_and(verdict IN ('SUPPORTED', 'CONTRADICTED', 'FABRICATED', 'UNVERIFIABLE') AND coalesce(severity IN ('CORE', 'MINOR'), true) AND (rt = 'BOOLEAN' OR rt = 'VARCHAR' AND rc IN ('true', 'false'))) AS fine, count(*) AS n, bool_or(error) AS err, bool_or(error AND coalesce(severity = 'CORE', false)) AS core, count(*) FILTER (error AND severity IS NULL) AS ns,
  count(*) FILTER (nullish) + count(*) FILTER (NOT error AND severity IS NOT NULL) + count(*) FILTER (rt = 'VARCHAR' AND rc IN ('true', 'false')) AS repairs FROM cn GROUP BY event_id),
rr AS (SELECT js.event_id, coalesce(json_type(v->'answer_attempted') = 'BOOLEAN' AND (json_type(v->'completeness') = 'NULL' OR upper(trim(v->>'completeness')) IN ('FULL', 'PARTIAL', 'NONE')) AND json_type(v->'claims') = 'ARRAY' AND upper(trim(v->>'label')) IN ('FAKTUAL', 'ABSTAIN', 'HALUSINASI_PENUH', 'HALUSINASI_SEBAGIAN') AND coalesce(fine, true), false) AS good,
  CASE WHEN v->>'answer_attempted' = 'false' THEN 'ABSTAIN' WHEN core THEN 'HALUSINASI_PENUH' WHEN err THEN 'HALUSINASI_SEBAGIAN' ELSE 'FAKTUAL' END AS label, upper(trim(v->>'label')) AS reported, coalesce(n, 0) AS n, coalesce(ns, 0) AS ns, coalesce(repairs, 0) AS repairs, v->>'answer_attempted' = 'false' AND coalesce(n, 0) > 0 AS conflict FROM js LEFT JOIN cg USING (event_id))"""


def raw_records(spark, sf) -> DataFrame:
    e, i = F.col("event_id"), None
    pick = lambda sql, at: F.element_at(F.expr(f"array({sql.strip('[]')})"), (at + 1).cast("int"))
    among = lambda n: F.when(e % n == 0, 5).otherwise(4)
    half, third = F.floor(e / 2), F.floor(e / 3)
    claim = lambda i: F.concat(F.lit('{"verdict": "'), pick(VD, (e + i * 7) % among(23)), F.lit('", "severity": '), pick(SV, (half + i) % among(19)), F.lit(', "reference_conflict": '), pick(CF, (e + i) % among(17)), F.lit("}"))
    claims = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < e % 4), claim), ", ")
    attempted = F.when(e % 7 == 0, "false").when((e % 7 == 1) & (e % 3 == 0), '"true"').otherwise("true")
    raw = F.concat(F.when(e % 13 == 0, "Sure: ").otherwise(""), F.lit('{"answer_attempted": '), attempted, F.lit(', "completeness": '), pick(CM, e % 4), F.lit(', "label": "'), pick(LB, third % among(10)), F.lit('", "claims": ['), claims, F.lit("]"), F.when(e % 31 == 0, "").otherwise("}"))
    return t(spark, sf, "events").select("event_id", "user_id", F.when(e % 29 != 0, raw).alias("raw"))


@query(f"WITH {VJ} SELECT event_id, NOT good AS parse_error, CASE WHEN good THEN label END AS label, CASE WHEN good THEN reported END AS reported_label, CASE WHEN good THEN reported = label END AS consistent, CASE WHEN good THEN n END AS n_claims, CASE WHEN good THEN ns END AS n_errors_without_severity, CASE WHEN good THEN repairs END AS n_repairs, CASE WHEN good THEN conflict END AS conflict FROM rr")
def judge_records(spark, sf):
    out = V.validated(raw_records(spark, sf), "raw", strict=True)
    return out.select("event_id", "parse_error", "label", "reported_label", "consistent", F.size("claims").cast("bigint").alias("n_claims"), F.col("n_errors_without_severity").cast("bigint").alias("n_errors_without_severity"), F.size("normalized_fields").cast("bigint").alias("n_repairs"), "conflict")


AU = f"""dn AS (SELECT count(*) AS n FROM documents), rn AS (SELECT ['B', 'C', 'D'][c + 1] AS condition, c, doc_id AS query, doc_id % 17 / 10.0 + c AS latency FROM documents, range(3) r(c)),
im AS (SELECT condition, query, (query * 7 + c * 3 + j * 11) % n AS id FROM rn, dn, range(3) r(j) WHERE (query + j + c) % 5 <> 0 AND NOT (query % 17 = 0 AND c = 1)),
sb AS (SELECT DISTINCT doc_id, hash(substr(text, i, 50)) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 48)) AS i FROM documents WHERE length(text) >= 50)),
ip AS (SELECT DISTINCT query, id FROM im), sh AS (SELECT DISTINCT query, id FROM ip JOIN sb x ON x.doc_id = query JOIN sb y ON y.doc_id = id AND y.s = x.s),
si AS (SELECT query, id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM ip JOIN embeddings x ON x.vec_id = query JOIN embeddings y ON y.vec_id = id),
pq AS (SELECT condition, query, count(*) AS k, bool_or(sh.query IS NOT NULL) AS sub, coalesce(bool_or(sim >= 0.3), false) AS cs, max(sim) AS best, bool_or(im.id // 4 = im.query // 4) AS thread, bool_or(im.id // 4 = im.query // 4 OR abs(im.id - im.query) <= 10) AS wide FROM im LEFT JOIN sh USING (query, id) LEFT JOIN si USING (query, id) GROUP BY ALL),
ru AS (SELECT rn.condition, rn.query, latency, coalesce(k, 0) AS k, coalesce(sub, false) AS sub, coalesce(cs, false) AS cs, coalesce(best, 0) AS best, coalesce(thread, false) AS thread, coalesce(wide, false) AS wide FROM rn LEFT JOIN pq USING (condition, query)),
xs AS (SELECT condition, (query + s) % 3 AS n_answers, CASE WHEN (query + s + c) % 4 = 0 THEN 0 ELSE (query + s) % 3 END AS n_left FROM rn, range(2) r(s)), xc AS (SELECT condition, count(*) AS n_slots, count(*) FILTER (n_left = 0) AS n_slots_empty, count(*) FILTER (n_left = 0 AND n_answers > 0) AS n_slots_excluded FROM xs GROUP BY 1)"""
FLAGS = {"self_thread": "thread", "self_wide": "wide", "substring": "sub", "cosine": "cs", "any_leak": "sub OR cs"}


@query(f"WITH {AU} SELECT condition, count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {n}, round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS {n}_pct' for n, c in FLAGS.items())}, round(avg(best), 6) AS mean_best_sim, count(*) FILTER (k < 3) AS n_short, count(*) FILTER (k = 0) AS n_empty, round(avg(latency), 6) AS latency_mean, round(quantile_cont(latency, 0.95), 6) AS latency_p95, any_value(n_slots) AS n_slots, any_value(n_slots_empty) AS n_slots_empty, any_value(n_slots_excluded) AS n_slots_excluded FROM ru JOIN xc USING (condition) GROUP BY condition")
def leakage_report(spark, sf):
    docs, v = t(spark, sf, "documents").select("doc_id", "text"), vectors(spark, sf)
    q = F.col("query")
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.lit(n).alias("condition")) for k, n in enumerate("BCD")])).alias("x")
    runs = docs.select(F.col("doc_id").alias("query"), c).select("x.condition", "x.c", "query", (q % 17 / 10 + F.col("x.c")).alias("latency"))
    n = docs.agg(F.count("*").alias("n"))
    items = runs.join(F.broadcast(n), F.lit(True)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(((q + F.col("j") + F.col("c")) % 5 != 0) & ~((q % 17 == 0) & (F.col("c") == 1)))
    items = items.select("condition", "query", ((q * 7 + F.col("c") * 3 + F.col("j") * 11) % F.col("n")).alias("id"))
    # an item is a document
    items = items.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    items = kept(items.join(R.pair_cosines(items, v), ["query", "id"], "left").select("condition", "query", "id", "sim"), "retrieved")
    pairs = items.select("query", "id").distinct()
    thread = F.floor(F.col("id") / 4) == F.floor(q / 4)
    out = pairs.where(thread).select(F.lit("thread").alias("mode"), "query", "id").union(pairs.where(thread | (F.abs(F.col("id") - q) <= 10)).select(F.lit("wide"), "query", "id"))
    slots = runs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("n_answers", (q + F.col("slot")) % 3)
    slots = slots.withColumn("n_left", F.when((q + F.col("slot") + F.col("c")) % 4 == 0, 0).otherwise(F.col("n_answers")))
    shared = leakage.sharing_pairs(pairs, docs, "doc_id")
    return rounded(leakage.audit(runs, items, out, None, slots, ["thread", "wide"], 3, cosine=0.3, shared=shared))


@query(f"WITH {LK}, {EX}, r AS (SELECT a AS query, b AS id FROM lk WHERE b IS NOT NULL UNION SELECT b, a FROM lk WHERE b IS NOT NULL), f AS (SELECT * FROM r UNION SELECT query, query FROM r) SELECT query, 'linked' AS mode, count(DISTINCT id) AS n FROM f GROUP BY 1")
def exclusion_sets_of_a_mode(spark, sf):
    """Sets of all modes are written, a folder a mode; one mode is written anew and one is read."""
    near = excluded(spark, sf).select(F.col("query").alias("a"), F.col("id").alias("b"))
    sets, path = kept(R.exclusion_sets({"linked": linked(spark, sf), "neardup": near}), "sets"), scratch(spark, "modes")
    overwrite_parts(sets, path, "mode")
    overwrite_parts(sets.where("mode = 'neardup'"), path, "mode")
    return read_part(sets, path, "mode", "linked").select("query", "mode", F.size("ids").cast("bigint").alias("n"))


@query("WITH e AS (SELECT user_id, event_type, CASE WHEN value >= 5 THEN 'ok' END AS answer FROM events), k AS (SELECT user_id, event_type, bool_or(answer IS NOT NULL) AS done, bool_or(answer IS NULL) AS failed FROM e GROUP BY 1, 2) SELECT event_type, count(*) FILTER (done) AS n_results, count(*) FILTER (failed AND NOT done) AS n_open FROM k GROUP BY 1")
def settled_events(spark, sf):
    """Events come in four files, a batch each; a user's events of a type are judged once, small values fail."""
    path = scratch(spark, "settled")
    e = t(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    e.repartition(4, "event_id").drop("event_id").write.parquet(f"{path}/in")
    like = e.drop("event_id")
    judge = lambda rows: rows.select("user_id", "event_type", F.when(F.col("value") >= 5, "ok").alias("answer"))
    settled.judge_stream(settled.file_stream(spark, f"{path}/in", like), judge, f"{path}/out", f"{path}/state", ["user_id", "event_type"], "answer")
    results = settled.stored(judge(like), f"{path}/out", settled.RESULTS).select("event_type", F.lit(1).alias("done"), F.lit(0).alias("open"))
    rest = settled.open_failures(judge(like), f"{path}/out", ["user_id", "event_type"]).select("event_type", F.lit(0), F.lit(1))
    return results.union(rest).groupBy("event_type").agg(F.sum("done").alias("n_results"), F.sum("open").alias("n_open"))


REMARKS = ["", "According to the retrieved sources, ", "The provided context does not cover this. ", "there is no information in the given documents about it; ", "This is not mentioned in the sources. ", "In the context of threads, ", "the search results suggest that ", "More is needed beyond the context provided. "]


@query()
def blinded_answers(spark, sf):
    """Documents as answers that speak of their sources: the text that a judge gets and the phrases that went. Its patterns look ahead,
    which DuckDB's can't; a test compares them with Python's."""
    from threadweave.functions import scalars as S

    remark = F.element_at(F.array(*[F.lit(x) for x in REMARKS]), (F.col("doc_id") % len(REMARKS) + 1).cast("int"))
    said = t(spark, sf, "documents").select("doc_id", F.concat(remark, F.coalesce("text", F.lit(""))).alias("text"))
    done = said.select("doc_id", S.blinded_with_hits(F.col("text")).alias("done"))
    names = F.transform("done.hits", lambda x: x["name"])
    return done.select("doc_id", F.sha2("done.text", 256).alias("blinded_sha256"), F.array_join(names, ",").alias("phrases"))


@query("WITH p AS (SELECT o_orderkey AS qid, row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) AS place FROM orders) SELECT qid FROM p WHERE place > 384")
def donor_pool(spark, sf):
    return sampling.beyond(t(spark, sf, "orders").select(F.col("o_orderkey").alias("qid")), "qid", 384)


# users as runs, their events as answers; some users' events have no time taken, one type of event is no run's
HS = "e AS (SELECT user_id, event_type, epoch_us(ts) AS ts_us, CASE WHEN user_id % 5 <> 0 OR event_id % 3 <> 0 THEN value END AS v FROM events), r AS (SELECT user_id, count(*) * 3.0 + user_id AS duration FROM events GROUP BY user_id)"


@query(f"WITH {HS}, s AS (SELECT user_id, count(*) AS n, count(v) AS n_timed, quantile_cont(v, 0.95) AS p95 FROM e WHERE event_type <> 'error' GROUP BY 1), w AS (SELECT r.user_id, coalesce(n, 0) AS n, coalesce(n_timed, 0) AS n_timed, p95, duration, coalesce(n > 0 AND n = n_timed, false) AS whole FROM r LEFT JOIN s USING (user_id)) SELECT user_id, n, n_timed, NOT whole AS fallback, round(CASE WHEN whole THEN p95 WHEN n > 0 THEN duration / n END, 6) AS value, CASE WHEN whole AND user_id % 2 = 0 THEN p95 <= 15 END AS meets FROM w")
def latency_targets(spark, sf):
    e = t(spark, sf, "events")
    runs = e.groupBy("user_id").agg(F.count("*").alias("n_events")).select("user_id", (F.col("n_events") * 3.0 + F.col("user_id")).alias("duration"))
    timed = e.where("event_type <> 'error'").select("user_id", F.when((F.col("user_id") % 5 != 0) | (F.col("event_id") % 3 != 0), F.col("value")).alias("v"))
    return rounded(reports.latency_target(runs, timed, "user_id", "v", 15.0, F.col("user_id") % 2 == 0))


@query("WITH h AS (SELECT event_id AS history_id, user_id % 7 AS condition, event_type AS model, user_id % 3 AS n, epoch_us(ts) AS us FROM events), j AS (SELECT condition, arg_max(score, struct_pack(a := us, s := -score)) AS score FROM (SELECT user_id % 7 AS condition, epoch_us(ts) AS us, value AS score FROM events WHERE user_id % 7 <> 3 AND event_type = 'click') GROUP BY 1) SELECT model, n, row_number() OVER (PARTITION BY model, n ORDER BY us DESC, history_id) AS place, history_id, h.condition, score FROM h LEFT JOIN j ON j.condition = h.condition")
def history_comparison(spark, sf):
    e = t(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("condition", F.col("user_id") % 7)
    history = e.select(F.col("event_id").alias("history_id"), "condition", F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("n"), "at")
    judged = e.where("condition <> 3 AND event_type = 'click'").select("condition", "at", F.col("value").alias("score"))
    return reports.history_table(history, judged, ["model", "n"], "at")
