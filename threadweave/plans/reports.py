"""Registered queries of the reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadweave.functions import scalars as S
from threadweave.operators import judging as J
from threadweave.operators import reports as P
from threadweave.operators import retrieval as R
from threadweave.operators import stats
from threadweave.operators import tables as T
from threadweave.plans.catalogue import A, KN, QUERIES, SIM, U, answers, found, query, questions, r6, sources, t, tagged, vectors
from threadweave.plans.judged import IT, LABELS, LB, VT, judged, records, rounded, votes
from threadweave.sources.files import kept

__all__ = ["QUERIES"]


@query(f"WITH {U} SELECT match_source AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM u), 6) AS pct FROM u GROUP BY 1")
def match_source_distribution(spark, sf):
    return rounded(P.distribution(sources(spark, sf), "match_source"))


@query(f"WITH {U} SELECT coalesce(source, '(none)') AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM u), 6) AS pct FROM u GROUP BY 1")
def source_versions(spark, sf):
    return rounded(P.distribution(sources(spark, sf), "source"))


@query("WITH g AS (SELECT l_orderkey, string_agg('<' || l_partkey || '>', '') AS tags FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1) SELECT length(tags) - length(replace(tags, '<', '')) AS n_tags, count(*) AS n_questions FROM g GROUP BY 1")
def tags_per_question(spark, sf):
    texts = tagged(spark, sf).groupBy("q").agg(F.array_join(F.transform(F.collect_set("tag"), lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "").alias("tags"))
    return texts.groupBy(P.tag_count(F.col("tags")).cast("bigint").alias("n_tags")).agg(F.count("*").alias("n_questions"))


@query("SELECT count(DISTINCT l_partkey) AS n_tags, count(DISTINCT l_orderkey) AS n_questions FROM lineitem")
def distinct_tags(spark, sf):
    return tagged(spark, sf).agg(F.count_distinct("tag").alias("n_tags"), F.count_distinct("q").alias("n_questions"))


@query("WITH p AS (SELECT quantile_cont(s_acctbal, 0.99) AS top FROM supplier) SELECT s_suppkey, round(least(1.0, ln(1 + greatest(s_acctbal, 0)) / ln(1 + top)), 6) AS w FROM supplier, p")
def supplier_weights(spark, sf):
    s = t(spark, sf, "supplier")
    top = P.positive_percentile(s, "s_acctbal", 0.99)
    return s.join(F.broadcast(top), F.lit(True)).select("s_suppkey", r6(S.norm_log(F.col("s_acctbal"), F.col("top")), "w"))


@query("WITH d AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents) SELECT lang, count(n) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95, round(100.0 * avg((n > 2048)::INT), 6) AS pct_above FROM d GROUP BY 1")
def word_lengths(spark, sf):
    d = t(spark, sf, "documents").select("lang", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0))).alias("n"))
    return rounded(P.profile(d, ["lang"], "n", above=2048))


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) <= 2048")
def short_documents(spark, sf):
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))
    return t(spark, sf, "documents").where(words <= 2048).select("doc_id")


@query("SELECT o_orderstatus, metric, count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM (SELECT o_orderstatus, unnest(['o_totalprice', 'o_custkey']) AS metric, unnest([o_totalprice, o_custkey::DOUBLE]) AS v FROM orders) GROUP BY 1, 2")
def metric_summary(spark, sf):
    out = P.metric_summary(t(spark, sf, "orders"), ["o_orderstatus"], ["o_totalprice", "o_custkey"])
    return out.select("o_orderstatus", "metric", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query(f"WITH {VT}, c AS (SELECT judge, coalesce(label, 'failed') AS label, count(*) AS n FROM vt GROUP BY 1, 2) SELECT judge, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY judge), 6) AS pct FROM c")
def judge_shares(spark, sf):
    return rounded(P.judge_shares(votes(spark, sf)))


@query(f"WITH {VT}, p AS (SELECT x.judge AS judge_a, y.judge AS judge_b, x.label AS la, y.label AS lb FROM vt x JOIN vt y ON x.item = y.item AND x.judge < y.judge WHERE x.label IS NOT NULL AND y.label IS NOT NULL), n AS (SELECT judge_a, judge_b, count(*)::DOUBLE AS n, avg((la = lb)::INT) AS po FROM p GROUP BY 1, 2), ma AS (SELECT judge_a, judge_b, la AS l, count(*) AS x FROM p GROUP BY ALL), mb AS (SELECT judge_a, judge_b, lb AS l, count(*) AS y FROM p GROUP BY ALL), c AS (SELECT judge_a, judge_b, sum(x * y) AS xy FROM ma JOIN mb USING (judge_a, judge_b, l) GROUP BY 1, 2) SELECT judge_a, judge_b, n::BIGINT AS n, round((po - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM n JOIN c USING (judge_a, judge_b)")
def pairwise_kappa(spark, sf):
    return rounded(P.pairwise_kappa(votes(spark, sf)))


V4 = f"""{A}, v4 AS (SELECT aid AS item, j AS judge, CASE WHEN (aid + j) % 11 <> 0 THEN {LB}[1 + (author * (j + 3) + qid + quantity::BIGINT * j) % 5] END AS label FROM a, range(4) r(j)),
s4 AS (SELECT item, count(label) AS n, count(*) FILTER (label = '{J.ABSTAIN}') AS ab, list_sort(list(CASE WHEN label IN ('{J.PARTLY}', '{J.UNSPECIFIED}') THEN 1 WHEN label = '{J.FULLY}' THEN 2 ELSE 0 END) FILTER (label IS NOT NULL)) AS lo, list_sort(list(CASE WHEN label = '{J.PARTLY}' THEN 1 WHEN label IN ('{J.FULLY}', '{J.UNSPECIFIED}') THEN 2 ELSE 0 END) FILTER (label IS NOT NULL)) AS hi FROM v4 GROUP BY 1)"""


def four_label(at: str) -> str:
    return f"CASE WHEN n < 3 THEN '{J.UNRESOLVED}' WHEN 2 * ab > n THEN '{J.ABSTAIN}' WHEN lo[{at}] <> hi[{at}] THEN '{J.UNSPECIFIED}' ELSE ['{J.FACTUAL}', '{J.PARTLY}', '{J.FULLY}'][lo[{at}] + 1] END"


@query(f"WITH {V4} SELECT item, {four_label('(n + 1) // 2')} AS lower_label, {four_label('n // 2 + 1')} AS upper_label FROM s4")
def four_judge_sensitivity(spark, sf):
    v = answers(spark, sf).select(F.col("aid").alias("item"), "qid", "author", F.col("quantity").cast("bigint").alias("quantity"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("judge"))
    at = ((F.col("author") * (F.col("judge") + 3) + F.col("qid") + F.col("quantity") * F.col("judge")) % 5 + 1).cast("int")
    v = v.select("item", F.when((F.col("item") + F.col("judge")) % 11 != 0, F.element_at(F.array(*[F.lit(x) for x in LABELS]), at)).alias("label"))
    low, high = P.even_panel_labels(v, False), P.even_panel_labels(v, True)
    return low.withColumnRenamed("panel_label", "lower_label").join(high.withColumnRenamed("panel_label", "upper_label"), "item")


@query(f"WITH {VT} SELECT CASE judge WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'SUPPORTED' ELSE '(none)' END AS verdict, coalesce(label, '(none)') AS severity, count(*) AS n FROM vt GROUP BY 1, 2")
def claim_table(spark, sf):
    claim = F.struct(F.when(F.col("judge") == 0, "CONTRADICTED").when(F.col("judge") == 1, "SUPPORTED").alias("verdict"), F.col("label").alias("severity"))
    return P.claim_table(votes(spark, sf).groupBy("item").agg(F.collect_list(claim).alias("claims")))


@query(f"WITH {A}, n AS (SELECT qid, least(count(*), 5) AS n FROM a GROUP BY 1) SELECT count(*) AS n_queries, count(*) FILTER (n = 5) AS n_at_limit, round(avg(n), 6) AS mean, median(n) AS median, max(n) AS largest FROM n")
def limit_binding(spark, sf):
    sizes = answers(spark, sf).groupBy("qid").agg(F.least(F.count("*"), F.lit(5)).alias("n"))
    return rounded(P.limit_binding(sizes, "n", 5))


@query("WITH o AS (SELECT * FROM (VALUES (1, '1-URGENT'), (2, '9-NEVER'), (3, '2-HIGH'), (4, '3-MEDIUM'), (5, '4-NOT SPECIFIED'), (6, '5-LOW')) v(place, o_orderpriority)), g AS (SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1) SELECT place, o_orderpriority, n, mean FROM o LEFT JOIN g USING (o_orderpriority)")
def factorial_order(spark, sf):
    g = t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return P.in_fixed_order(g, "o_orderpriority", ["1-URGENT", "9-NEVER", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("""WITH s AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_suppkey)) AS a, list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber <= 4)) AS b0, list_sort(list(DISTINCT l_partkey)) AS c FROM lineitem GROUP BY 1), p AS (SELECT q, a, CASE WHEN q % 3 = 0 THEN a[1:2] WHEN q % 3 = 1 THEN coalesce(b0, []) ELSE c END AS b FROM s),
k AS (SELECT q, a, b, len(list_intersect(a, b)) AS common, least(len(a), len(b)) AS m FROM p) SELECT CASE WHEN a = b THEN 'equal' WHEN common = len(a) AND common = len(b) THEN 'same_set' WHEN m > 0 AND a[1:m] = b[1:m] THEN 'prefix' WHEN common = m THEN 'nested' WHEN common > 0 THEN 'overlapping' ELSE 'disjoint' END AS verdict, count(*) AS n FROM k GROUP BY 1""")
def set_verdicts(spark, sf):
    li = t(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 4, F.col("l_suppkey")))).alias("b0"), F.array_sort(F.collect_set("l_partkey")).alias("c"))
    b = F.when(F.col("q") % 3 == 0, F.slice("a", 1, 2)).when(F.col("q") % 3 == 1, F.col("b0")).otherwise(F.col("c"))
    s = s.withColumn("b", b)
    return s.groupBy(P.set_verdicts(s, "a", "b").alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT o_orderpriority AS key, count(*)::VARCHAR AS va FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_mktsegment AS key, count(*)::VARCHAR AS vb FROM customer GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%LOW%' GROUP BY 1) SELECT key, va AS value_a, vb AS value_b FROM a FULL JOIN b USING (key) WHERE va IS DISTINCT FROM vb")
def config_differences(spark, sf):
    as_map = lambda df, k: df.groupBy(F.col(k).alias("k")).agg(F.count("*").cast("string").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'")
    a, seg, low = as_map(o, "o_orderpriority"), as_map(t(spark, sf, "customer"), "c_mktsegment"), as_map(o.where("o_orderpriority LIKE '%LOW%'"), "o_orderpriority")
    one = a.select(F.col("m").alias("a")).join(F.broadcast(seg.select(F.col("m").alias("s"))), F.lit(True)).join(F.broadcast(low.select(F.col("m").alias("l"))), F.lit(True)).select("a", F.map_concat("s", "l").alias("b"))
    return P.config_differences(one, "a", "b")


@query("SELECT o_orderkey, substr(sha256('priority=' || o_orderpriority || chr(10) || 'status=' || o_orderstatus), 1, 10) AS config_hash FROM orders")
def config_hashes(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", P.config_hash(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("config_hash"))


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)")
def records_without_key(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return P.without_key(o, t(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("k")), ["k"])


@query("SELECT count(*) FILTER (c_acctbal < 0) AS n_changed, 0::BIGINT AS n_left FROM customer")
def change_and_restore(spark, sf):
    before = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    after = before.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    changes = P.applied_changes(before, after, ["c_custkey"], "c_acctbal")
    back = P.applied_changes(before, P.restored(after, changes, ["c_custkey"], "c_acctbal"), ["c_custkey"], "c_acctbal")
    return changes.agg(F.count("*").alias("n_changed")).join(back.agg(F.count("*").alias("n_left")), F.lit(True))


@query(f"WITH {IT}, x AS (SELECT question_id, max(label) AS relevance FROM jd WHERE label IS NOT NULL GROUP BY 1), y AS (SELECT o_orderkey AS question_id, o_orderstatus AS outcome FROM orders WHERE o_orderstatus <> 'P'), z AS (SELECT l_orderkey AS question_id, max(l_returnflag) AS returned FROM lineitem WHERE l_quantity > 40 GROUP BY 1) SELECT o_orderkey AS question_id, relevance, outcome, returned, (relevance IS NOT NULL)::INT + (outcome IS NOT NULL)::INT + (returned IS NOT NULL)::INT AS n_sources FROM orders LEFT JOIN x ON x.question_id = o_orderkey LEFT JOIN y ON y.question_id = o_orderkey LEFT JOIN z ON z.question_id = o_orderkey")
def three_sources(spark, sf):
    o = t(spark, sf, "orders")
    parts = {
        "relevance": judged(spark, sf).where("label IS NOT NULL").select("question_id", "label"),
        "outcome": o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("label")),
        "returned": t(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("label")),
    }
    return P.three_sources(o.select(F.col("o_orderkey").alias("question_id")), parts, "question_id")


@query(r"WITH p AS (SELECT 'the_word' AS pattern, unnest(regexp_extract_all(coalesce(text, ''), '(?i)the [a-z]{2,4}[ \n]')) AS phrase FROM documents UNION ALL SELECT 'number', unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{3,}')) FROM documents) SELECT pattern, trim(regexp_replace(lower(phrase), '\s+', ' ', 'g')) AS phrase, count(*) AS n FROM p GROUP BY 1, 2")
def phrase_counts(spark, sf):
    return P.phrase_counts(t(spark, sf, "documents"), "text", {"the_word": "(?i)the [a-z]{2,4}[ \n]", "number": "[0-9]{3,}"})


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def questions_per_user(spark, sf):
    return P.counts_with_zero(t(spark, sf, "customer"), t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("WITH h AS (SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS hit FROM orders) SELECT count(*) AS n, count(*) FILTER (hit) AS n_matched, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS pct FROM h")
def match_rate(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return rounded(P.match_rate(o, t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k"))


@query(f"WITH {KN}, {A}, p AS (SELECT query, id AS anchor, id AS via, aid, round(sim, 6) AS score FROM an JOIN a ON qid = id), r AS (SELECT 'node' AS kind, 'query-' || query AS id, 'query' AS role, NULL::DOUBLE AS weight FROM p UNION ALL SELECT 'node', 'question-' || anchor, 'question', NULL FROM p UNION ALL SELECT 'node', 'question-' || via, 'question', NULL FROM p UNION ALL SELECT 'node', 'answer-' || aid, 'answer', NULL FROM p UNION ALL SELECT 'edge', 'query-' || query || '>question-' || anchor, 'ANCHOR', score FROM p UNION ALL SELECT 'edge', 'question-' || anchor || '>question-' || via, 'STEP', score FROM p UNION ALL SELECT 'edge', 'question-' || via || '>answer-' || aid, 'ANSWER', score FROM p) SELECT kind, id, role, max(weight) AS weight FROM r GROUP BY 1, 2, 3")
def retrieval_path_graph(spark, sf):
    a = answers(spark, sf).select(F.col("qid").alias("id"), "aid")
    p = found(spark, sf).join(a, "id").select("query", F.col("id").alias("anchor"), F.col("id").alias("via"), "aid", F.round("sim", 6).alias("score"))
    return P.path_graph(p)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20")
def probes_by_language(spark, sf):
    return P.evenly_probed(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 20)


@query(f"WITH {A}, e AS (SELECT DISTINCT l_orderkey AS qid FROM lineitem WHERE l_discount >= 0.1) SELECT aid, qid, 'Q: ' || o_orderpriority || chr(10) || 'A: ' || score::BIGINT AS text FROM a JOIN orders ON o_orderkey = qid WHERE qid NOT IN (SELECT qid FROM e)")
def flat_corpus(spark, sf):
    a = answers(spark, sf).join(t(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), "o_orderpriority"), "qid")
    out = t(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("qid")).distinct()
    text = F.concat(F.lit("Q: "), F.col("o_orderpriority"), F.lit("\nA: "), F.bround("score").cast("bigint").cast("string"))
    return a.join(out, "qid", "left_anti").select("aid", "qid", text.alias("text"))


@query(f"WITH {KN} SELECT query, id, round(sim, 6) AS sim, label FROM an JOIN embeddings ON vec_id = id")
def corpus_hits_with_text(spark, sf):
    late = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return found(spark, sf).join(late, "id").select("query", "id", r6(F.col("sim"), "sim"), "label")


@query("SELECT x.vec_id AS query, y.vec_id AS owner, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim FROM embeddings x JOIN orders ON o_orderkey = x.vec_id JOIN embeddings y ON y.vec_id = o_custkey")
def owner_similarity(spark, sf):
    v = vectors(spark, sf)
    owner = questions(spark, sf).select(F.col("qid").alias("id"), F.col("uid").alias("owner"))
    both = v.join(owner, "id").join(v.select(F.col("id").alias("owner"), F.col("v").alias("u")), "owner")
    return both.select(F.col("id").alias("query"), "owner", r6(S.cosine(F.col("v"), F.col("u")), "sim"))


@query(f"WITH {KN}, {A}, al AS (SELECT unnest([0.0, 0.3, 0.7, 1.0])::DOUBLE AS alpha), c AS (SELECT query, aid, sim, least(1.0, score / 100000) AS trust FROM an JOIN a ON qid = id), n AS (SELECT *, CASE WHEN max(sim) OVER p = min(sim) OVER p THEN 1.0 ELSE (sim - min(sim) OVER p) / (max(sim) OVER p - min(sim) OVER p) END AS sn FROM c WINDOW p AS (PARTITION BY query)), r AS (SELECT alpha, query, aid, row_number() OVER (PARTITION BY alpha, query ORDER BY round((1 - alpha) * sn + alpha * trust, 9) DESC, aid) AS rank FROM n, al) SELECT alpha, query, list(aid ORDER BY rank)[1] AS best, count(*) AS n FROM r WHERE rank <= 3 GROUP BY 1, 2")
def reranked_by_alpha(spark, sf):
    a = answers(spark, sf).select(F.col("qid").alias("id"), "aid", F.least(F.lit(1.0), F.col("score") / 100000).alias("trust"))
    rows = found(spark, sf).join(a, "id").withColumn("sn", S.min_max(F.col("sim"), ["query"], 1.0)).withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.3, 0.7, 1.0)])))
    score = F.round((1 - F.col("alpha")) * F.col("sn") + F.col("alpha") * F.col("trust"), 9)
    top = T.first_by(rows.withColumn("s", score), ["alpha", "query"], [F.desc("s"), "aid"], 3)
    return top.groupBy("alpha", "query").agg(F.max_by("aid", F.struct("s", -F.col("aid"))).alias("best"), F.count("*").alias("n"))


@query(f"WITH {IT}, q AS (SELECT question_id, bool_or(label = 'RELEVANT') AS has_relevant, count(label) AS n FROM jd GROUP BY 1) SELECT o_orderstatus, coalesce(has_relevant, false) AS has_relevant, count(*) AS n_questions FROM orders LEFT JOIN q ON question_id = o_orderkey GROUP BY 1, 2")
def outcome_by_relevance(spark, sf):
    flag = judged(spark, sf).groupBy("question_id").agg(F.bool_or(F.col("label") == "RELEVANT").alias("has_relevant"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderstatus").join(flag, "question_id", "left")
    return o.groupBy("o_orderstatus", F.coalesce("has_relevant", F.lit(False)).alias("has_relevant")).agg(F.count("*").alias("n_questions"))


@query(f"WITH {IT} SELECT run, coalesce(label, 'unjudged') AS label, count(*) AS n, round(avg(score), 6) AS mean_score FROM jd GROUP BY 1, 2")
def label_distribution(spark, sf):
    return rounded(judged(spark, sf).groupBy("run", F.coalesce("label", F.lit("unjudged")).alias("label")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


@query("WITH x AS (SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m') AS month, sum(CASE WHEN value > 5 THEN value END) AS total, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, month, round(total, 4) AS total, n FROM x")
def history_sums(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.when(F.col("value") > 5, F.col("value"))), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'unknown' WHEN value > 50 THEN 'slow-' || event_type ELSE event_type END AS run_label, substr(sha256(user_id || '|' || epoch_us(ts)), 1, 16) AS run_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'v1' ELSE 'v2' END AS version FROM events")
def run_labels(spark, sf):
    e = t(spark, sf, "events")
    label = F.when(F.col("event_type") == "error", "failed").when(F.col("value").isNull(), "unknown").when(F.col("value") > 50, F.concat(F.lit("slow-"), "event_type")).otherwise(F.col("event_type"))
    run_id = F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), 256), 1, 16)
    return e.select("event_id", label.alias("run_label"), run_id.alias("run_id"), F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp"), "v1").otherwise("v2").alias("version"))


@query(f"WITH {IT}, x AS (SELECT run, question_id, list(answer_id ORDER BY rank) AS ids FROM it WHERE rank <= 2 GROUP BY 1, 2), p AS (SELECT coalesce(b.question_id, c.question_id) AS q, coalesce(b.ids, []) AS b, coalesce(c.ids, []) AS c FROM (SELECT * FROM x WHERE run = 'B') b FULL JOIN (SELECT * FROM x WHERE run = 'C') c ON b.question_id = c.question_id) SELECT len(list_filter(c, lambda i: NOT list_contains(b, i))) AS n_entered, count(*) AS n_questions FROM p GROUP BY 1")
def set_change_distribution(spark, sf):
    items = J.context_items(records(spark, sf)).where("rank <= 2")
    ids = items.groupBy("run", "question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "answer_id"))), lambda s: s["answer_id"]).alias("ids"))
    c = J.compare_lists(ids.where("run = 'B'"), ids.where("run = 'C'"), ["question_id"])
    return c.groupBy(F.col("n_entered").cast("bigint").alias("n_entered")).agg(F.count("*").alias("n_questions"))


@query("WITH s AS (SELECT l_orderkey AS q, list(DISTINCT l_suppkey) FILTER (l_linenumber = 1) AS a, list(DISTINCT l_suppkey) FILTER (l_linenumber > 1) AS b FROM lineitem GROUP BY 1) SELECT q, CASE WHEN coalesce(len(list_distinct(coalesce(a, []) || coalesce(b, []))), 0) = 0 THEN 0.0 ELSE round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(coalesce(a, []) || coalesce(b, []))), 6) END AS jaccard FROM s")
def tag_jaccard(spark, sf):
    s = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))).alias("b"))
    return s.select("q", r6(S.jaccard(F.col("a"), F.col("b"), 0.0), "jaccard"))


@query(f"WITH {SIM}, e AS (SELECT query, 'EMBED' AS edge_type FROM sm WHERE sim >= 0.3 UNION ALL SELECT vec_id, 'ORDER' FROM embeddings JOIN lineitem ON l_orderkey = vec_id) SELECT query, edge_type, count(*) AS n FROM e GROUP BY 1, 2")
def edges_around(spark, sf):
    v = vectors(spark, sf)
    near = R.similar_pairs(v, v, 0.3).select("query", F.lit("EMBED").alias("edge_type"))
    own = v.select(F.col("id").alias("query")).join(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query")), "query").select("query", F.lit("ORDER").alias("edge_type"))
    return near.union(own).groupBy("query", "edge_type").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), g AS (SELECT l.*, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS abstains FROM labels l JOIN documents USING (doc_id)), x AS (SELECT CASE WHEN abstains = 1 AND toxic = 1 THEN 2 ELSE quality END AS a, toxic + (quality = 0 AND toxic = 1)::INT AS b FROM g), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), s AS (SELECT sum(n) AS t, sum(n * (1 - abs(a - b) / 2.0)) AS ag FROM t), c AS (SELECT sum(ra * cb * (1 - abs(p.a - q.b) / 2.0)) AS ch FROM (SELECT a, sum(n) AS ra FROM t GROUP BY 1) p, (SELECT b, sum(n) AS cb FROM t GROUP BY 1) q) SELECT t::BIGINT AS n, round(ag / t, 6) AS p_observed, round(ch / (t * t), 6) AS p_chance, round((ag / t - ch / (t * t)) / (1 - ch / (t * t)), 6) AS kappa FROM s, c")
def weighted_kappa(spark, sf):
    g = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    a = F.when((F.col("lang") != "en") & (F.col("toxic") == 1), 2).otherwise(F.col("quality"))
    b = F.col("toxic") + ((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("int")
    return rounded(stats.weighted_kappa(g.select(a.alias("a"), b.alias("b")), "a", "b", 3))


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 9) AS scaled FROM orders")
def global_min_max(spark, sf):
    out = P.global_min_max(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "scaled")
    return out.select("o_orderkey", F.round("scaled", 9).alias("scaled"))


@query("SELECT CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'no_k' WHEN json_extract_string(props, '$.k')::INT >= 50 THEN 'too_large' ELSE 'fine' END AS problem, count(*) AS n FROM events GROUP BY 1")
def validated_props(spark, sf):
    k = F.col("value.k")
    out = P.judged_json(t(spark, sf, "events").drop("value"), "props", "k INT", {"no_k": k.isNotNull(), "too_large": k < 50})
    return out.groupBy(F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH lk AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), l AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM lk WHERE b IS NOT NULL AND a % 3 <> 0 UNION ALL SELECT b, a FROM lk WHERE b IS NOT NULL AND a % 3 <> 0)), d AS (SELECT a, b FROM lk WHERE b IS NOT NULL AND a % 3 = 0 UNION SELECT b, a FROM lk WHERE b IS NOT NULL AND a % 3 = 0),
m AS (SELECT a AS query, b AS id FROM l WHERE a IN (SELECT vec_id FROM embeddings) AND (a, b) NOT IN (SELECT a, b FROM d)), sm AS (SELECT x.vec_id AS query, y.vec_id AS id FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.2)
SELECT m.query, count(*) AS n_more, count(sm.id) AS n_more_similar FROM m LEFT JOIN sm ON sm.query = m.query AND sm.id = m.id GROUP BY 1""")
def linked_sensitivity(spark, sf):
    from threadweave.plans.judged import kinds_of_links

    v = vectors(spark, sf)
    q, links, a = v.select(F.col("id").alias("qid")), kept(kinds_of_links(spark, sf), "links"), answers(spark, sf)
    # only links can be what the wider mode rules out on top
    near = R.similar_among(links.select(F.col("a").alias("query"), F.col("b").alias("id")).union(links.select("b", "a")), v, 0.2)
    narrow, wide = (R.exclusions_of_mode(q, links, near, a, True, linked, None) for linked in (False, True))
    return P.mode_sensitivity(narrow, wide, near)


@query("SELECT 'documents' AS condition, 'thread' AS mode, count(*) AS n FROM documents UNION ALL SELECT 'labels', 'thread', count(*) FROM labels")
def rows_by_file(spark, sf):
    both = [t(spark, sf, n).select(F.col("doc_id"), F.col("_metadata.file_path").alias("path")) for n in ("documents", "labels")]
    # a table may be a file or a folder of files: the table's own name counts
    table = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]+)?$", 1)
    condition, mode = P.condition_of_file(table)
    return both[0].union(both[1]).groupBy(condition.alias("condition"), mode.alias("mode")).agg(F.count("*").alias("n"))
