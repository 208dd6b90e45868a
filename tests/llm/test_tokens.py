import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from threadweave.llm import packing, queries, token_counts, token_files
from threadweave.llm.common import scratch_path
from threadweave.llm.tokens import tokenizer_path


def library(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def in_order(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))


def check_files(rows, got):
    start, want = 0, []
    for r, ids in zip(rows, library(queries.WORD_BPE, [r.text for r in rows])):
        want.append((r.doc_id, start, len(ids) + 1, crc(ids + [2])))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def check_pieces(rows, got, window=4096):
    ids = library(queries.WORD_BPE, [r.text for r in rows])
    whole = Counter((r.doc_id, len(i) + 1) for r, i in zip(rows, ids))
    total = sum(len(i) + 1 for i in ids)
    assert sum(p.length for p in got) == total
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in got:
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    lengths = []
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at <= window
        lengths.append(at)
    padded = sum(n if n & (n - 1) == 0 else window for n in lengths)
    assert padded - total <= 0.01 * total
    repeated = {d for (d, _), n in whole.items() if n > 1}
    for r, i in zip(rows, ids):
        if r.doc_id in repeated:
            continue
        i, at = i + [2], 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(i)) and p.ids_crc32 == crc(i[at : at + p.length])
            at += p.length
        assert at == len(i)


def test_query_results_equal_the_library(spark, sf):
    rows = in_order(spark.read.parquet(f"{sf}/documents.parquet"))
    check_files(rows, queries.op3_token_files(spark, sf).collect())
    check_pieces(rows, queries.op8_packing(spark, sf).collect())
    counts = {r.doc_id: r for r in queries.op7_token_counts(spark, sf).collect()}
    for r, ids in zip(rows, library(queries.BYTE_BPE, [r.text for r in rows])):
        assert counts[r.doc_id][1:] == (len((r.text or "").encode()), len(ids), len(ids) > 512)


@pytest.mark.parametrize("name", [queries.WORD_BPE, queries.BYTE_BPE])
def test_odd_texts_equal_the_library(spark, odd, name):
    path = scratch_path(spark, "odd")
    token_files.write_tokens(odd, path, tokenizer_path(name))
    rows = in_order(odd)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.ids for r in got] == [i + [2] for i in library(name, [r.text for r in rows])]
    assert [(r.doc_id, r.n_tokens) for r in token_files.read_lengths(spark, path).orderBy("start").collect()] == [(r.doc_id, len(r.ids)) for r in got]


def test_files_are_encoded_and_indexed_as_said(spark, sf):
    """Footers: encodings, row groups, page indexes; plans: no ids for the lengths, id filters pushed down."""
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    token_files.write_tokens(docs, path, tokenizer_path(queries.WORD_BPE))
    files = sorted(glob.glob(path.removeprefix("file://") + "/part-*.parquet"))
    chunks = [m.row_group(g).column(c) for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups) for c in range(m.num_columns)]
    ids = [c for c in chunks if c.path_in_schema.startswith("ids")]
    assert ids and all({"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings) for c in ids)
    assert all("DELTA_BINARY_PACKED" in c.encodings or "RLE_DICTIONARY" in c.encodings for c in chunks if c.path_in_schema == "doc_id")
    assert all(c.has_offset_index and c.has_column_index for c in chunks)
    assert all(m.row_group(g).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups))
    plan = token_files.read_lengths(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    plan = token_files.read_tokens(spark, path).where("doc_id BETWEEN 5 AND 9")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and token_files.read_tokens(spark, path).where("doc_id BETWEEN 5 AND 9").count() == 5


def test_parts_go_by_number(spark):
    """Part 100000 comes after part 99999, whatever their files are called."""
    path = scratch_path(spark, "parts")
    rows = [(99999, 1, 0, 2, [7, 2]), (100000, 2, 0, 3, [8, 9, 2]), (100000, 3, 3, 1, [2]), (7, 0, 0, 1, [2])]
    spark.createDataFrame(rows, token_files.FILE).repartition(3).write.parquet(path)
    assert {r.doc_id: r.start for r in token_files.read_lengths(spark, path).collect()} == {0: 0, 1: 1, 2: 3, 3: 6}


def test_very_many_rows_of_one_id_are_split(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(id AS string) AS text")
    path = scratch_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(df, path, tokenizer_path(queries.WORD_BPE))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(path).groupBy("part").count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 4000
    starts = sorted((r.start, r.n_tokens) for r in token_files.read_lengths(spark, path).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_packing_of_odd_texts(spark, odd):
    check_pieces(in_order(odd), packing.pack_documents(odd, tokenizer_path(queries.WORD_BPE)).collect())
    some = packing.pack_documents(odd.repartition(5), tokenizer_path(queries.WORD_BPE), window=64, n_open=2, slack=0, keep_ids=True).collect()
    assert sum(len(p.ids) for p in some) == sum(p.length for p in some) and max(p.offset + p.length for p in some) <= 64
    assert packing.pack_documents(odd.limit(0), tokenizer_path(queries.WORD_BPE)).count() == 0


def test_cache_encodes_only_misses(spark, odd):
    cache, path = scratch_path(spark, "cache"), tokenizer_path(queries.BYTE_BPE)
    first = token_counts.count_tokens(odd.where("doc_id < 9"), path, cache).collect()
    assert spark.read.parquet(cache).count() == 8  # null and empty are one content, rows 3 twice
    token_counts.count_tokens(odd, path, cache).collect()
    n = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(odd, path, cache).collect()
    assert spark.read.parquet(cache).count() == n and set(first) <= set(again) and len(again) == odd.count()
    assert token_counts.count_tokens(odd.limit(0), path, cache).count() == 0


def test_sentencepiece_counts(spark, odd):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    got = token_counts.count_tokens(odd.where("doc_id < 8"), path, scratch_path(spark, "cache")).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.n_tokens == len(sp.encode(texts[r.doc_id])) for r in got)


def test_packing_keeps_large_ids_beside_a_null_id(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b"), (big + 2, "c"), (None, "d")], "doc_id bigint, text string")
    assert {r.doc_id for r in packing.pack_documents(df, tokenizer_path(queries.WORD_BPE)).collect()} == {big, big + 2, None}


@pytest.mark.parametrize("change", ["prefix", "normalizer", "stripping", "regex", None])
def test_files_that_cuts_do_not_fit_are_encoded_whole(tmp_path, change):
    from tests.llm.conftest import ODD
    from threadweave.llm.common import text_bytes
    from threadweave.llm.tokens import Encoder, known

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    if change == "prefix":
        file["pre_tokenizer"]["add_prefix_space"] = True
    if change == "normalizer":
        file["normalizer"] = {"type": "Lowercase"}
    if change == "stripping":
        file["added_tokens"][0]["lstrip"] = True
    if change == "regex":
        file["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, file["pre_tokenizer"]]}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    assert known(Tokenizer.from_file(path)) == (change is None)
    column = pa.array([*ODD, "Plain text, it goes on.  And on 123!"])
    ids, bounds = Encoder(path).encode(pa.array([x or "" for x in column.to_pylist()]), *text_bytes(column))
    whole = Tokenizer.from_file(path)
    for k, text in enumerate(column.to_pylist()):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids
