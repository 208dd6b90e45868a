import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadweave.functions import scalars as S
from threadweave.operators import graph, retrieval, sampling, stats, tables
from threadweave.sources import files
from threadweave.streaming import events


def test_readers_skip_what_is_malformed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Body\n1,"two\nlines"\nx,bad\n2,ok\n')
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Body", T.StringType())])
    assert {r.Id: r.Body for r in files.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()} == {1: "two\nlines", 2: "ok"}
    kept = files.read_csv(spark, str(tmp_path / "a.csv"), schema, corrupt="_bad").cache()
    assert kept.where("_bad IS NOT NULL").count() == 1 and kept.count() == 3
    (tmp_path / "l.xml").write_text('<?xml version="1.0"?>\n<links><row Id="1" PostId="5" RelatedPostId="6" LinkTypeId="3" CreationDate="d"/><row PostId="5" RelatedPostId="7" LinkTypeId="2"/><row PostId="" RelatedPostId="7" LinkTypeId="1"/></links>')
    assert [(r.PostId, r.link_type_label) for r in files.read_links(spark, str(tmp_path / "l.xml")).collect()] == [(5, "Duplicate")]
    (tmp_path / "r.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"\n{"k": 3}\n')
    record = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert sorted(r.k for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl"), record).collect()) == [1, 3]
    (tmp_path / "log").write_text("x\n[latency] cond=B Id=12 retrieval_sec=0.25 end_to_end_sec=3\n")
    assert [tuple(r) for r in files.read_latency_log(spark, str(tmp_path / "log")).collect()] == [("B", 12, 0.25, None, 3.0)]


def test_sinks(spark, tmp_path):
    path, old = str(tmp_path / "t"), str(tmp_path / "old")
    assert files.overwrite_verified(spark.range(3), path, old) == 3
    assert files.overwrite_verified(spark.range(5), path, old) == 5
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(old).count() == 3
    out = str(tmp_path / "j")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    files.append_missing(rows.where("k = 1"), out, ["k"])
    files.append_missing(rows, out, ["k"])
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json") for x in open(os.path.join(out, f))]
    assert sorted(x["k"] for x in lines) == [1, 2]
    assert {r.column: (r.nulls, r.rows) for r in files.preview(rows.withColumn("n", F.lit(None).cast("int"))).collect()} == {"k": (0, 3), "v": (0, 3), "n": (3, 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([("<a><b-c>", "<p>x &lt;b&gt;</p><p>y</p>", "see [answer_id: 12] and [Answer_ID=7]", "token = \"0123456789abcdef0\" me@x.org 1.2.3.4"), ("", None, "", "")], "t string, h string, c string, s string")
    a, b = df.select(S.tags(F.col("t")).alias("t"), S.first_tag(F.col("t")).alias("f"), S.html_to_text(F.col("h")).alias("h"), S.cited_ids(F.col("c")).alias("c"), S.redacted(F.col("s")).alias("s")).collect()
    assert (a.t, a.f, a.h, a.c, a.s) == (["a", "b-c"], "a", "x <b>\ny", [12, 7], "token = *** *** ***")
    assert (b.t, b.f, b.h, b.c) == ([], None, "", [])
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(S.l2_normalised(F.col("v"))).collect()
    assert n[0][0] == pytest.approx([0.6, 0.8]) and n[1][0] == [0.0, 0.0]


def test_samples_are_nested_and_disjoint(spark):
    ids = spark.range(500)
    small = [r.id for r in sampling.sample(ids, "id", 20).orderBy("place").collect()]
    large = [r.id for r in sampling.sample(ids, "id", 50).orderBy("place").collect()]
    assert large[:20] == small and len(set(large)) == 50
    cut = sampling.slices(ids, "id", {"test": 30, "dev": 10}).groupBy("slice").count().collect()
    assert {r.slice: r["count"] for r in cut} == {"test": 30, "dev": 10}


def test_pair_guard_and_blocks(spark):
    tagged = spark.createDataFrame([(q, 1) for q in range(30)], "q long, tag long")
    with pytest.raises(ValueError, match="870"):
        graph.tag_cooccurrence(tagged, "q", "tag", most_pairs=100)
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    one, many = retrieval.nearest(v, v, 3), retrieval.nearest(v, v, 3, block=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 120
    assert retrieval.nearest(v.limit(0), v, 3).count() == 0


def test_exact_p(spark):
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert stats.paired_outcomes(pairs, F.col("a"), F.col("b")).first().p_exact == pytest.approx(2 * (1 + 10 + 45) / 1024)


def test_krippendorff_ordinal(spark):
    made = lambda rows: stats.krippendorff_ordinal(spark.createDataFrame(rows, "item long, label int"), "item", "label").first()
    assert tuple(made([(1, 0), (1, 0), (2, 0), (2, 0)])) == (4, None)  # one label
    assert tuple(made([(1, 0), (2, 1), (3, None)])) == (0, None)  # no item has two ratings
    assert made([(1, 0), (1, 0), (2, 2), (2, 2)]).alpha == pytest.approx(1.0)
    near = made([(1, 0), (1, 1), (2, 0), (2, 0), (3, 2), (3, 2), (4, 1), (4, 1)]).alpha
    far = made([(1, 0), (1, 2), (2, 0), (2, 0), (3, 2), (3, 2), (4, 1), (4, 1)]).alpha
    assert far < near < 1


def test_tables(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k long, x double")
    b = spark.createDataFrame([(1, 2.5), (2, 1.0)], "k long, x double")
    assert tables.largest_difference(a, b, ["k"], "x").first()[0] == float("inf")
    assert tables.largest_difference(a.where("k = 1"), b.where("k = 1"), ["k"], "x").first()[0] == 0.5


def test_stream_restarts_without_repeating(spark, sf, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.read.parquet(f"{sf}/events.parquet").where("event_id < 500").coalesce(1).write.parquet(str(src / "a"))
    os.rename(next((src / "a").glob("part*")), src / "1.parquet")
    days = lambda: events.once(events.event_stream(spark, str(src))).select("event_id")
    events.run_once(days(), str(tmp_path / "out"), str(tmp_path / "state"))
    spark.read.parquet(f"{sf}/events.parquet").where("event_id >= 450").coalesce(1).write.parquet(str(src / "b"))
    os.rename(next((src / "b").glob("part*")), src / "2.parquet")
    events.run_once(days(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(range(1000)) and len(got) > 900


def test_token_chunks_make_up_the_text(spark):
    import public_tokenizers

    from threadweave.functions import chunks

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "short", "日本語のテキスト 🙂🙂 and words " * 40, "  leading\n\nlines  " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").withColumn("doc", chunks.answer_text(F.lit("why"), F.col("body")))
    rows = df.select("doc", chunks.token_chunks(F.col("doc"), path, 7).alias("c"), chunks.truncated_text(F.col("doc"), path, 7).alias("t")).collect()
    for r in rows:
        n = len(chunks.encoder(path).encode(r.doc, add_special_tokens=False).ids)
        assert "".join(r.c) == r.doc and len(r.c) == max(1, -(-n // 7))
        assert r.t.text == r.c[0] and r.t.truncated == (n > 7)
    assert spark.range(1).select(chunks.token_chunks(F.lit(None).cast("string"), path, 7).alias("c")).first().c == [""]


def test_high_level_is_filled_until_there_are_enough_answers(spark):
    from threadweave.operators import dual_level as D

    scored = spark.createDataFrame([(1, v, 1 - v / 10, v) for v in (1, 2, 3, 4)], "query int, via int, score double, place int")
    answers = spark.createDataFrame([(1, 10), (2, 10), (3, 30), (4, 40)], "qid int, aid int")
    low = spark.createDataFrame([(1, 99)], "query int, aid int")
    assert [sorted(r.via for r in D.filled(scored, answers, low, 1, k).collect()) for k in (0, 2, 3, 4, 9)] == [[1], [1], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4]]


def test_cut_references_and_page_texts(spark):
    df = spark.createDataFrame([("<p>a &amp; b &amp</p>c &lt;&#233;&#xe9; &am",), (None,)], "h string")
    got = df.select(S.html_to_text(F.col("h"), 100, S.unescaped_if_closed), S.html_to_text(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("a & b &amp\nc <éé &am", "a & b &\nc <éé &am"), ("", "")]


def test_signed_ranks_of_millions(spark):
    """n (n + 1) (2 n + 1) is beyond 64 bits here."""
    r = stats.wilcoxon(spark.range(3_000_000).select((F.col("id") % 3 - 1).alias("d")), F.col("d")).first()
    assert r.n == 2_000_000 and r.w_plus == r.w_minus and r.z == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 1.0])
def test_cooccurrence_of_few_and_many_tags(spark, threshold):
    """Items of one tag up to thirty, common tags among them, against all pairs."""
    import random

    r = random.Random(4)
    pools = [range(9), range(5, 40), range(30, 60)]
    sets = {q: frozenset(r.sample(list(pools[q % 3]), r.choice([1, 2, 3, 4, 5, 7] if q % 3 < 2 else [2, 13, 20, 30]))) for q in range(90)}
    sets |= {90 + k: frozenset(list(sets[3 * k + 2])[: 4 + k]) for k in range(5)}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    good = {t for t, n in df.items() if n <= 20}
    rows = spark.createDataFrame([(q, t) for q, s in sets.items() for t in s], "q long, tag long")
    got = {(x.src, x.dst): x.jaccard for x in graph.tag_cooccurrence(rows, "q", "tag", max_df=20, threshold=threshold, top_k=100).collect()}
    # informative tags make the pairs and are counted against all tags
    k = {(p, q): len(sets[p] & sets[q] & good) for p in sets for q in sets if p != q}
    want = {pq: n / (len(sets[pq[0]]) + len(sets[pq[1]]) - n) for pq, n in k.items() if n and n / (len(sets[pq[0]]) + len(sets[pq[1]]) - n) >= threshold}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_cooccurrence_has_no_bound_of_its_own(spark):
    import inspect

    assert inspect.signature(graph.tag_cooccurrence).parameters["most_pairs"].default is None
