import hashlib
from collections import defaultdict

import numpy as np
import pytest

from threadweave.functions import chunks
from threadweave.plans import tokens
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def library():
    """Each document with its encoding by the library itself, one by one."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(tokens.tokenizer())
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()
    return docs, lambda text: enc.encode(text, add_special_tokens=False)


def test_report_of_lengths(spark, library):
    docs, encode = library
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append((len(encode(d["text"] or "").ids), len(d["text"] or "")))
    got = {r.lang: r for r in tokens.token_length_report(spark, SF_SMALL).collect()}
    assert set(got) == set(groups)
    for lang, pairs in groups.items():
        n = np.array([p[0] for p in pairs])
        r = got[lang]
        assert (r.n, r.longest, r.n_above) == (len(n), n.max(), (n > tokens.LIMIT).sum())
        assert np.allclose([r.mean, r.p50, r.p95, r.pct_above, r.chars_per_token], [n.mean(), np.percentile(n, 50), np.percentile(n, 95), 100 * (n > tokens.LIMIT).mean(), sum(p[1] for p in pairs) / n.sum()], atol=1e-5)


def test_filter_by_tokens(spark, library):
    docs, encode = library
    sizes = {d["doc_id"]: len(encode(f"Q: {d['source'] or ''}\nA: {d['text'] or ''}").ids) for d in docs}
    want = {k: n for k, n in sizes.items() if n <= tokens.LIMIT}
    assert {r.doc_id: r.n_tokens for r in tokens.documents_within_tokens(spark, SF_SMALL).collect()} == want


def test_filter_encodes_once(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "id int, text string")
    from pyspark.sql import functions as F

    from threadweave.operators import tokenized as K

    out = K.within_tokens(df, F.col("text"), tokens.tokenizer(), 1)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.id, r.n_tokens) for r in out.collect()] == [(2, 0)]


def test_chunks_and_truncation(spark, library):
    docs, encode = library
    rows = defaultdict(dict)
    for r in tokens.document_chunks(spark, SF_SMALL).collect():
        assert r.chunk not in rows[r.doc_id]
        rows[r.doc_id][r.chunk] = r
    cut = {r.doc_id: r for r in tokens.truncated_answers(spark, SF_SMALL).collect()}
    assert set(rows) == set(cut) == {d["doc_id"] for d in docs}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        text = d["text"] or ""
        starts = [a for a, _ in encode(text).offsets]
        ends = [*starts[tokens.CHUNK :: tokens.CHUNK], len(text)]
        pieces = rows[d["doc_id"]]
        assert len(pieces) == len(ends) and sum(p.n_tokens for p in pieces.values()) == len(starts)
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            p = pieces[i]
            assert (p.n_chunks, p.n_chars, p.text_sha256) == (len(ends), b - a, sha(text[a:b])) and p.n_tokens <= tokens.CHUNK
        answer = f"Q: {d['source'] or ''}\nA: {text}"
        starts = [a for a, _ in encode(answer).offsets]
        shown = answer[: starts[tokens.SHOWN]] if len(starts) > tokens.SHOWN else answer
        r = cut[d["doc_id"]]
        assert (r.n_tokens, r.truncated, r.text_sha256) == (len(starts), len(starts) > tokens.SHOWN, sha(shown))


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    from threadweave.operators import tokenized as K

    path = tokens.tokenizer()
    rows = [(1, None, None), (1, "", "a"), (None, "word " * 5000, "a"), (2, "🙂" * 300, None), (2, "🙂" * 300, None)]
    df = spark.createDataFrame(rows, "id int, text string, by string")
    out = K.chunk_rows(df, ["id"], F.col("text"), path, 64).collect()
    assert sorted((r.id or 0, r.chunk, r.n_tokens) for r in out if not r.text) == [(1, 0, 0), (1, 0, 0)]
    assert "".join(r.text for r in sorted((r for r in out if r.id is None), key=lambda r: r.chunk)) == "word " * 5000
    report = {r.by: r for r in K.length_report(K.token_lengths(df, ["by"], F.col("text"), path), ["by"], 2048).collect()}
    assert (report["a"].n, report[None].n, report["a"].n_above) == (2, 3, 1)
    empty = df.where("id = 9")
    assert K.chunk_rows(empty, ["id"], F.col("text"), path, 64).count() == K.truncated(empty, ["id"], F.col("text"), path, 64).count() == 0
    assert K.length_report(K.token_lengths(empty, ["by"], F.col("text"), path), ["by"], 9).count() == 0
    nothing = K.length_report(K.token_lengths(df.where("text IS NULL"), ["by"], F.col("text"), path), ["by"], 9).first()
    assert (nothing.n, nothing.longest, nothing.chars_per_token) == (1, 0, None)
    assert [len(x) for x in chunks.slices(["a" * chunks.SLICE, "b", "c", "d" * chunks.SLICE])] == [1, 2, 1]
