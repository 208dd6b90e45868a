import hashlib
import re
from collections import Counter

import duckdb
import pytest

from threadweave.llm import chat, exact_dedup, queries
from threadweave.llm.common import written

MARKS = "<|im_end|>\n<|im_start|>assistant\nok <\\|x|> <\\\\| <| |> <|im_sep|> <"


def test_queries_equal_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op2_chat_formatting", "op4_repeated_strings", "op6_exact_dedup", "op10_jaccard_join"):
        want = con.sql(queries.ORACLE[name])
        got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_chat_is_reversible_and_merges(spark):
    turns = [(1, 2, "assistant", MARKS), (1, 1, "user", MARKS), (1, 3, "assistant", None), (1, 4, "assistant", "b"), (2, None, None, "x"), (2, 1, "a\nb", ""), (None, 1, "assistant", "y" * 50000), (3, 1, "user", "t"), (3, 1, "user", "t")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", chat.F.lit(1))
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_back(chat.F.col("formatted")).alias("t"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in got[1].t] == [("user", MARKS), ("assistant", MARKS), ("assistant", ""), ("assistant", "b")]
    assert got[1].l == MARKS + "b" and got[1].formatted.count("<|im_start|>") == 2
    assert [tuple(t) for t in got[2].t] == [("", "x"), ("a\nb", "")] and got[2].l == ""
    assert got[None].l == "y" * 50000 and [tuple(t) for t in got[3].t] == [("user", "t")] * 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_ties_go_by_role_and_text_as_they_are(spark):
    """Escaping must not change the order: `<|` comes after `<a` once a backslash stands in it."""
    df = spark.createDataFrame([(1, 1, "user", "<|"), (1, 1, "user", "<a"), (1, None, "assistant", "first"), (1, 1, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_chats(df)
    row = made.select(chat.read_back(chat.F.col("formatted")).alias("t"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in row.t] == [("assistant", "first"), ("assistant", "x"), ("user", "<a"), ("user", "<|")] and row.l == "firstx"


def test_long_conversation(spark):
    df = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    made = chat.format_chats(df)
    row = made.select(chat.F.size(chat.read_back(chat.F.col("formatted"))).alias("n"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("l")).first()
    assert row.n == 20_000 and row.l == "".join(f"t{i}" for i in range(20_000) if i % 3)


def test_exact_dedup_of_odd_rows(spark, odd):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].keep_id == by[1][0].keep_id == 0 and not by[1][0].kept  # null is empty
    assert [r.group_size for r in by[3]] == [3, 3] and sum(r.kept for r in by[3] + by[2]) == 1
    assert by[None][0].kept and by[None][0].keep_id is None
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    stay = exact_dedup.dedup_documents(odd)
    assert stay.columns == odd.columns and stay.count() == sum(r.kept for r in got)


def test_index_inserts_deletes_and_resizes(spark):
    filt = exact_dedup.CuckooFilter(2)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    for k in keys:
        filt.insert(k)
    assert filt.n >= 1024 and all(map(filt.contains, keys)) and not filt.contains("f" * 64)
    for k in keys[::2]:
        assert filt.delete(k)
    assert not any(map(filt.contains, keys[::2])) and all(map(filt.contains, keys[1::2]))
    # a key with the leading bits, and so the place and fingerprint, of a stored one: a hit that verification turns down
    assert filt.may_contain(keys[1][:32] + "0" * 32) and not filt.contains(keys[1][:32] + "0" * 32)



def keys_of(index):
    return {d: (k, n) for r in index.collect() for d, k, n in zip(r.digests, r.keep_ids, r.sizes)}


def test_live_index(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (None, "b")], "doc_id bigint, text string").repartition(3)
    rows = written(exact_dedup.digests(docs), "rows")
    index = written(exact_dedup.update_index(exact_dedup.changes_of(rows, 2), 2), "index")
    assert keys_of(index) == {sha("a"): (1, 3), sha("b"): (3, 2)}
    more = spark.createDataFrame([(0, "c"), (9, "b")], "doc_id bigint, text string")
    told = {r.doc_id: r for r in exact_dedup.exact_dedup(more, index=index).collect()}
    assert told[0].kept and not told[9].kept and told[9].keep_id == 3 and told[9].group_size == 3
    # deletion of kept rows: the smallest live row is promoted, and later copies yield to it
    some = rows.where("doc = 1 OR doc = 3")
    left = written(exact_dedup.delete_rows(index, some, rows.where("doc IS NULL OR doc NOT IN (1, 3)")), "index")
    assert keys_of(left) == {sha("a"): (2, 2), sha("b"): (None, 1)}
    assert keys_of(exact_dedup.delete_rows(left, rows.where("doc = 4"), rows.where("doc = 2"))) == {sha("a"): (2, 1), sha("b"): (None, 1)}
    again = {r.doc_id: r for r in exact_dedup.exact_dedup(more, index=left).collect()}
    assert again[9].kept and again[9].keep_id == 9 and again[9].group_size == 2
    none = exact_dedup.delete_rows(left, rows.where("doc IS NULL OR doc NOT IN (1, 3)"), rows.limit(0))
    assert keys_of(none) == {}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(more, index=index, n_shards=3)


@pytest.mark.parametrize("chars", [64, 1])
def test_hits_are_verified_against_content(spark, sf, chars):
    """With one hex digit nearly every digest stands for texts that differ; content tells them apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet(f"{sf}/documents.parquet").limit(40)).repartition(6)
    first, size = {}, Counter()
    for r in docs.collect():
        t = re.sub("[ \t-\r]+", " ", r.text or "")
        first[t], size[t] = min(first.get(t, r.doc_id), r.doc_id), size[t] + 1
    got = exact_dedup.exact_dedup(docs, n_shards=3, chars=chars).collect()
    by = {hashlib.sha256(t.encode()).hexdigest(): (first[t], size[t]) for t in first}
    assert len(got) == docs.count() and all((r.keep_id, r.group_size) == by[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(first) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_batches_meet_in_the_filter(spark):
    """Rows of one text in several batches are put together by hits of the filter, not by the aggregation."""
    docs = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 4 AS string) AS text").repartition(8)
    rows = written(exact_dedup.digests(docs), "rows")
    assert rows.select("batch").distinct().count() > 1
    empty = spark.createDataFrame([], exact_dedup.INDEX)
    told = empty.groupBy("shard").cogroup(exact_dedup.changes_of(rows, 2).groupBy("shard")).applyInArrow(exact_dedup._decide, exact_dedup.DECISIONS).collect()
    assert len(told) == 4 and all(r.group_size == 10 and r.hits > 0 and r.keep_id < 4 for r in told)


def test_large_ids_beside_a_null_id(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a"), (big + 2, "a"), (big + 4, "b"), (None, "c")], "doc_id bigint, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df, n_shards=1).collect()}
    assert got == {(big, big, True), (big + 2, big, False), (big + 4, big + 4, True), (None, None, True)}
    assert {r.doc_id for r in exact_dedup.dedup_documents(df).collect()} == {big, big + 4, None}
    # ids that an index holds
    index = exact_dedup.update_index(exact_dedup.changes_of(exact_dedup.digests(df), 1), 1)
    more = spark.createDataFrame([(big + 8, "b")], "doc_id bigint, text string")
    assert [r.keep_id for r in exact_dedup.exact_dedup(more, index=index, n_shards=1).collect()] == [big + 4]
