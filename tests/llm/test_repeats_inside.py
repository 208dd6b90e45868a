"""Repetition rules, periodic runs and phrase mining against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from threadweave.llm import collocations, periodic, queries, repetition


def made(seed, n=40):
    """Texts with repeated words, phrases, lines and periods of several lengths."""
    r = random.Random(seed)
    v = ["".join(r.choice("abcdeé#%") for _ in range(r.randint(1, 7))) for _ in range(30)]
    out = []
    for i in range(n):
        w = [r.choice(v[: r.choice([2, 5, 30])]) for _ in range(r.randint(0, 150))]
        if r.random() < 0.5 and w:
            a, p = r.randrange(len(w)), r.randint(1, 9)
            w[a:a] = (w[a : a + p] * 12)[: r.randint(1, 60)]
        if r.random() < 0.4:
            w += w[5:20] + ["\n"] + w[5:20]
        out.append((i, "".join(x + r.choice([" ", " ", "\t", "  ", "\n", ". ", "\r\n"]) for x in w)))
    return out + [(100, None), (101, ""), (102, " \n "), (103, "x " * 500), (104, "a\n" * 300), (105, "wörd" * 5000)]


def frame(spark, rows, schema="doc_id bigint, text string, lang string, kept string, n_words int, runs int"):
    return spark.createDataFrame([(i, t, "x", "k", 7, 7) for i, t in rows], schema).repartition(3)


def test_repetition(spark):
    rows = made(1)
    got = {r.doc_id: r.asDict() for r in repetition.repetition(frame(spark, rows)).collect()}
    kinds = set()
    for i, t in rows:
        want, r = brute.repetition(t, repetition.GRAM_PERCENT), got[i]
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        fine = 100 * want["dup_line_chars"] <= 20 * want["word_chars"] and all(100 * want[f"dup_chars_{n}"] <= p * want["word_chars"] for n, p in repetition.GRAM_PERCENT.items())
        assert (r["base_failed"], r["kept"]) == (failed, not failed and fine)
        kinds.add((failed, fine))
    assert len(kinds) >= 3


def test_repetition_other_lengths_and_odd_rows(spark, odd):
    got = repetition.repetition(frame(spark, made(2)), {2: 50, 3: 40}, window=3).collect()
    texts = dict(made(2))
    assert all(r.asDict().items() >= brute.repetition(texts[r.doc_id], {2: 50, 3: 40}, 3).items() for r in got)
    rows = odd.select("doc_id", "text").collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_dup_lines"])
    want = sorted([brute.repetition(r.text, {}) | {"doc_id": r.doc_id} for r in rows], key=key)
    got = sorted([r.asDict() for r in repetition.repetition(odd).collect()], key=key)
    assert len(got) == len(want) and all(g.items() >= w.items() for g, w in zip(got, want))
    assert repetition.repetition(odd.limit(0)).count() == 0


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_symbols(least):
    r = random.Random(least)
    for _ in range(300):
        w = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randint(0, 60))]
        a, b, q = periodic.runs_of(np.array([*w, 99], np.int64), least)
        assert sorted(zip(a.tolist(), (b - a).tolist(), q.tolist())) == brute.runs(w, least)


def test_suffix_order_and_reach():
    r = np.random.default_rng(3)
    x = np.append(r.integers(0, 3, 200), 9)
    levels = periodic.suffix_ranks(x)
    suffixes = sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert np.argsort(levels[-1][1]).tolist() == suffixes
    common = periodic.common_prefixes(levels, np.array(suffixes))
    for k, (i, j) in enumerate(zip(suffixes, suffixes[1:])):
        n = common[k]
        assert x[i : i + n].tolist() == x[j : j + n].tolist() and x[i + n] != x[j + n]
    depth = r.integers(0, 4, 300)
    for strict in (True, False):
        for k, n in enumerate(periodic.reach(depth, strict)):
            before = depth[:k][::-1]
            ends = np.flatnonzero(before <= depth[k] if strict else before < depth[k])
            assert n == (0 if not depth[k] else ends[0] if len(ends) else k)


def test_periodic_runs(spark, odd, monkeypatch):
    rows = made(5) + [(200, " ".join(["a b c d e f g"] * 200)), (201, " ".join(f"w{k}" for k in range(3000)) + " end " + " ".join(f"w{k}" for k in range(3000)))]
    for least, at_once in ((12, 2 << 20), (4, 50)):
        monkeypatch.setattr(periodic, "LOOKUPS", at_once)
        got = periodic.periodic_runs(frame(spark, rows), least).collect()
        want = {i: (w, t) for i, w, t in brute.periodic(rows[:-1], least)}
        assert {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id != 201} == want
        assert next(r for r in got if r.doc_id == 201).runs == []
    want = sorted((str(i), w, t) for i, w, t in brute.periodic([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(odd).collect()) == want
    assert periodic.periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, 1)


def test_periodic_query(spark, sf):
    """The planted periods, and the digests of the query."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    planted = []
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), brute.re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(len(w))]
        planted.append((i, " ".join(w)))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, found, left in brute.periodic(planted):
        a, n, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want[i] = (len(found), a, n, q, n and 1000 * n // q, digest("".join(f"{x},{y},{z}\n" for x, y, z in found)), digest(left))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got == want and any(x[0] for x in want.values())


@pytest.mark.parametrize("bits", [collocations.BITS, 1 << 10])
def test_collocations(spark, bits, monkeypatch):
    monkeypatch.setattr(collocations, "GATHERED", 500)
    monkeypatch.setattr(collocations, "ROWS", 300)
    r = random.Random(7)
    rows = [(r.choice(["en", "de", None, "und"]), t) for seed in (7, 8, 9) for _, t in made(seed)]
    rows += [("en", "New  York\tCity, new york city. NEW york state! " * 40), ("de", "ÄB äb ÄB x")]
    docs = spark.createDataFrame([(i, lang, t, "p", 1) for i, (lang, t) in enumerate(rows)], "doc_id bigint, lang string, text string, phrase string, count int").repartition(4)
    got = collocations.collocations(docs, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute.phrases(rows)
    few = collocations.collocations(docs, least=4, longest=4, inside=80, first=5, bits=bits)
    assert sorted(map(tuple, few.collect())) == brute.phrases(rows, 4, 4, 80, 5)


def test_collocations_of_odd_rows(spark, odd):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    docs = docs.union(docs)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs, least=2).collect())) == brute.phrases(rows, 2)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_misra_gries(monkeypatch):
    """No key of `threshold` occurrences is lost, merging or not, and no more counters than the mass allows are left."""
    monkeypatch.setattr(collocations, "BUFFERED", 200)
    r = np.random.default_rng(11)
    for threshold in (3, 10):
        stream = np.concatenate((r.integers(0, 1 << 30, 6000), r.zipf(1.3, 3000) % 5000, np.repeat(np.arange(40) + (1 << 31), threshold))).astype(np.uint32)
        r.shuffle(stream)
        summary = collocations.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 30):
            summary.add(*np.unique(part, return_counts=True))
        left = summary.survivors(threshold)
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold].tolist()) <= set(left.tolist())
        assert summary.lost < threshold and len(summary.keys) <= summary.capacity and len(left) < len(keys) / 2
