import re

import corpus_pipeline
from tests.llm import brute
from threadweave.llm import queries


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    flags = queries.op1_quality_classifier(spark, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in flags.where("kept").collect()}
    once = corpus_pipeline.drop_copies(spark, kept, sf)
    seen: dict[str, int] = {}
    for r in sorted(kept.collect()):
        seen.setdefault(" ".join(__import__("re").split("[ \t-\r]+", r.text or "")), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(seen.values()) and once.columns == docs.columns
    near = corpus_pipeline.drop_near_copies(spark, once, sf)
    rows = [(r.doc_id, r.text) for r in once.collect()]
    assert {r.doc_id for r in near.collect()} == {i for i, (n, c) in brute.components(rows, 5, 80).items() if i == c or not n}
    clean = corpus_pipeline.drop_contaminated(spark, near, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    left = [(r.doc_id, r.text) for r in near.collect()]
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in brute.contamination(left, items) if not x[-1]} and clean.columns == docs.columns
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_stages_of_odd_rows(spark, sf, odd):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns and empty tables: each stage keeps what its
    docstring says, and the columns."""
    nulls = odd.selectExpr("doc_id", "text", "CAST(IF(doc_id % 2 = 0, 'en', NULL) AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(length(text) AS bigint) AS n_chars", "kept", "text_sha256", "'x' AS k", "1 AS n")
    docs = nulls.union(nulls.where("doc_id = 5"))
    n, words = docs.count(), docs.where("text RLIKE '[^ \t-\r]'")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
        got = out.count()
        if name in ("quality_classifier", "decontamination"):
            assert docs.where("text IS NULL OR text = ''").count() == out.where("text IS NULL OR text = ''").count() and got <= n
        elif name == "exact_dedup":
            want = {" ".join(re.split("[ \t-\r]+", r.text or "")) for r in docs.collect()}
            assert got == len(want)
        else:
            assert out.where("text IS NULL OR NOT text RLIKE '[^ \t-\r]'").count() == n - words.count()
            assert out.where("doc_id = 5").count() == 2 and got <= n
    pieces = corpus_pipeline.pack(spark, docs, sf)
    assert pieces.where("start = 0").count() == n and corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
