import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from threadweave.llm import decontamination, jaccard_join, quality, queries, repeats, toxicity


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, kept string, size int")


def texts(n, seed, words=400, vocabulary=60):
    """Random texts, some with pasted passages, some edited copies."""
    r = random.Random(seed)
    v = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    passage = " ".join(r.choice(v) for _ in range(40))
    out = []
    for i in range(n):
        w = [r.choice(v) for _ in range(r.randint(1, words))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if i % 4 == 1 and out:
            w = out[-1][1].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(v)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("length", [8, 20, 100])
def test_longest_previous_factors(length):
    """The array itself, against comparing every pair of suffixes."""
    r = np.random.default_rng(4)
    for letters, n in ((1, 150), (2, 300), (2, 40), (5, 400), (3, 1), (3, 9)):
        data = r.integers(97, 97 + letters, n).astype(np.uint8)
        if n > 200:
            data[150:290] = data[5:145]
        start = np.arange(n)
        position = r.permutation(n) if letters == 5 else start // 2 if letters == 3 else start
        raw = data.tobytes()

        def common(a, b):
            k = 0
            while k < length and max(a, b) + k < n and raw[a + k] == raw[b + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(n) if position[j] < position[i]), default=0) for i in range(n)]
        assert repeats.previous_factors(data, start, position, length).tolist() == want


@pytest.mark.parametrize("hot", [5000, 1])
def test_repeats(spark, sf, hot):
    rows = texts(60, 1) + [(100, None), (101, ""), (102, "ab" * 5000), (103, "short"), (-5, "é" * 300), (104, "x" * 99)]
    got = repeats.remove_repeats(docs_of(spark, rows).repartition(3), hot=hot, with_text=True).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute.repeated(rows)
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in got)
    assert repeats.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_repeats_of_repeated_rows(spark):
    rows = [(None, "q" * 50 + "w" * 120), (1, "a b c " * 30), (1, "a b c " * 30), (2, "q" * 50 + "w" * 120)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(docs_of(spark, rows)).collect())
    one = brute.repeated([(1, "a b c " * 30)])[1][1]
    # windows of one letter repeat inside a text, too
    assert got == [(False, 0, 119), (True, 1, one), (True, 1, one), (True, 2, 170)]


def test_repeats_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_repeated_strings(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute.repeated(rows)


@pytest.mark.parametrize("options", [{}, {"shingle": 5, "percent": 80}, {"often": 1, "paired": 2, "block": 3}])
def test_jaccard_components(spark, options):
    rows = texts(70, 2, 120, 400) + [(200, None), (201, " \n"), (202, "one two"), (203, "ONE  two"), (204, "one two three four five")]
    base = "w%d " * 150 % tuple(range(150))
    rows += [(300 + k, base.replace(f"w{k} ", "z ", 1).replace(f"w{k + 40} ", f"y{k} ", 1)) for k in range(25)] + [(400, base)]
    n, percent = options.get("shingle", 4), options.get("percent", 85)
    got = jaccard_join.jaccard_components(docs_of(spark, rows).repartition(3), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows, n, percent)
    stay = jaccard_join.one_of_each(docs_of(spark, rows), **options)
    want = {i for i, (m, c) in brute.components(rows, n, percent).items() if i == c or not m}
    assert {r.doc_id for r in stay.collect()} == want and stay.columns == ["doc_id", "text", "kept", "size"]


def test_jaccard_tells_swapped_words_apart(spark):
    """Long words of two letters whose polynomial hashes modulo 2^64 are equal."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("paired", [0, 3, 16])
def test_lists_skip_blocks_but_no_similar_pair(paired):
    """Every pair of sets that sizes and positions allow comes out of a list, hanging together at least, and no other pair."""
    r, skipped = np.random.default_rng(11), 0
    for _ in range(60):
        n = int(r.integers(2, 14))
        size = np.sort(r.integers(20, 40, n))
        place = r.integers(0, 6, n)
        order = np.lexsort((place, size))
        rows = {"shingle": np.full(n, 7), "half": np.arange(n) * 10, "size": size[order], "size_to": size[order], "place": place[order], "place_to": place[order]}
        batch = jaccard_join.pa.RecordBatch.from_pydict({k: jaccard_join.pa.array(v) for k, v in rows.items()})
        out = [b for b in jaccard_join.listed(85, paired)(iter([batch]))]
        got = {(int(a), int(b)) for t in out for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())}
        may = set()
        for i in range(n):
            for j in range(i):
                small, large = sorted((rows["size"][i], rows["size"][j]))
                need = -(-85 * (small + large) // 185)
                room = min(rows["size"][i] - rows["place"][i], rows["size"][j] - rows["place"][j]) + min(rows["place"][i], rows["place"][j])
                if 100 * small >= 85 * large and room >= need:
                    may.add((j * 10, i * 10))
        if n <= paired:
            assert got == may
            skipped += n * (n - 1) // 2 - len(may)
        else:
            x, y = (np.array([p[k] // 10 for p in sorted(may)], int) for k in (0, 1))
            a, b = (np.array([p[k] // 10 for p in sorted(got)], int) for k in (0, 1))
            assert (jaccard_join.closure(n, x, y) == jaccard_join.closure(n, a, b)).all()
    assert paired < 16 or skipped > 100


def test_jaccard_of_odd_rows(spark, odd, sf):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == odd.count() and all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_jaccard_join(spark, sf).collect()} == brute.components(rows)


def test_contamination(spark, odd, sf):
    items = [(1, texts(3, 1)[0][1]), (2, "Two words"), (3, None), (4, "!!"), (5, texts(3, 1)[0][1]), (6, "x y Z")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = texts(12, 1) + [(50, "a two WORDS b"), (51, None), (52, ""), (53, "two x words"), (54, "x-y,z " + "q " * 100)]
    for size in (8 << 20, 60):  # one block of items, and several
        got = decontamination.mark_contamination(docs_of(spark, rows), bench, block_bytes=size).drop("text", "kept", "size")
        assert sorted(map(tuple, got.collect())) == sorted(brute.contamination(rows, items))
    none = decontamination.mark_contamination(docs_of(spark, rows), bench.limit(0))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontamination.mark_contamination(odd, bench).count() == odd.count()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE["op5_decontamination"])
    assert sorted(map(tuple, queries.op5_decontamination(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("table_rows", [quality.TABLE_ROWS, 0])
def test_perplexities(spark, table_rows):
    rows = texts(40, 7) + [(90, None), (91, ""), (92, "Ω≈ç√ unseen")]
    docs = docs_of(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r for r in quality.score(docs, trusted, table_rows=table_rows).collect()}
    held = {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()}
    model = brute.kneser_ney([t for i, t in rows if i % 2 == 0 and i < 40 and i not in held])
    for i, t in rows:
        assert math.isclose(got[i]["__nll"], model(t), rel_tol=1e-9, abs_tol=1e-9) and got[i]["__n"] == len((t or "").encode())


def test_thresholds_and_rejection_against_brute_force(spark):
    """Perplexities, thresholds by language (null is one with rows enough, one has too few) and what is kept."""
    rows = texts(420, 3, 60)
    lang = {i: None if i % 3 == 0 else "few" if i in (1, 7) else "a" for i, _ in rows}
    docs = spark.createDataFrame([(i, t, lang[i], "k", i, "own") for i, t in rows], "doc_id bigint, text string, lang string, k string, m bigint, own string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i, _ in rows] + [(5, 0), (None, 1)], "doc_id bigint, quality int")
    held = {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()} - {5}
    model = brute.kneser_ney([t for i, t in rows if i not in held and i != 5])
    nll, size = {i: model(t) for i, t in rows}, {i: len(t.encode()) for i, t in rows}

    def mean(ids):
        return sum(nll[i] for i in ids) / sum(size[i] for i in ids)

    groups = {g: [i for i in held if lang[i] == g] for g in (None, "few", "a")}
    assert len(groups[None]) >= quality.ENOUGH and len(groups["a"]) >= quality.ENOUGH > len(groups["few"])
    usual = {g: mean(ids) if len(ids) >= quality.ENOUGH else mean(held) for g, ids in groups.items()}
    ppl = {i: math.exp((nll[i] + quality.STEADY * usual[lang[i]]) / (size[i] + quality.STEADY)) for i, _ in rows}

    def cut(ids):
        return sorted(ppl[i] for i in ids)[math.ceil(0.9 * len(ids)) - 1]

    own = {g: cut(ids) if len(ids) >= quality.ENOUGH else cut(held) for g, ids in groups.items()}
    got = quality.classify(docs, labels, quantile=0.9).collect()
    assert len(got) == len(rows) and got[0].k == "k" and got[0].own == "own"
    for r in got:
        assert math.isclose(r.perplexity, ppl[r.doc_id], rel_tol=1e-9) and math.isclose(r.threshold, own[lang[r.doc_id]], rel_tol=1e-9)
        assert r.kept == (ppl[r.doc_id] <= own[lang[r.doc_id]] * (1 + 1e-12))
    assert quality.classify(docs.limit(0), labels).count() == 0
    stay = quality.reject(docs, labels, quantile=0.9)
    assert stay.columns == docs.columns and stay.count() == sum(r.kept for r in got) < len(rows)


def test_extra_columns_clash_with_nothing(spark):
    """Every operator and every stage of the pipeline takes tables whose other columns are named like helper columns."""
    names = ["k", "m", "own", "g", "c", "n", "p", "h", "w", "doc", "row", "digest", "label", "block", "node", "__spans", "__items", "__lang", "__nll", "part", "hash", "toxic", "kept", "contaminated", "n_tokens"]
    plain = spark.createDataFrame([(i, f"some words {i % 3} and more of them here", "en") for i in range(6)] + [(7, None, None), (8, "", "en")], "doc_id bigint, text string, lang string")
    docs = plain.select("*", *[F.lit(f"x{k}").alias(v) for k, v in enumerate(names)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([("a", "nothing like it"), ("b", None)], "item_id string, text string")
    from threadweave.llm import exact_dedup, packing, token_counts, token_files
    from threadweave.llm.common import scratch_path
    from threadweave.llm.tokens import tokenizer_path

    word = tokenizer_path(queries.WORD_BPE)
    assert quality.classify(docs, labels).count() == 8
    for df in (quality.reject(docs, labels), exact_dedup.dedup_documents(docs), jaccard_join.one_of_each(docs), decontamination.decontaminate(docs, bench)):
        assert df.columns == docs.columns and all(r["own"] == "x2" for r in df.collect())
    assert exact_dedup.dedup_documents(docs).count() == 4
    assert exact_dedup.exact_dedup(docs).count() == repeats.remove_repeats(docs).count() == toxicity.score_toxicity(docs, toxicity.train(docs, labels)).count() == 8
    token_files.write_tokens(docs, path := scratch_path(spark, "clash"), word)
    assert token_files.read_tokens(spark, path).count() == token_counts.count_tokens(docs, word, scratch_path(spark, "clash")).count() == 8
    assert packing.pack_documents(docs, word).select("doc_id").distinct().count() == 8


def test_quality_keeps_the_clean(spark, sf, odd):
    sf = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op1_quality_classifier(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.985 and kept[0] < 0.1
    plain = odd.withColumn("lang", F.lit(None).cast("string"))
    out = quality.classify(plain, labels.limit(0))
    assert out.where("kept").count() == odd.count() and "text_sha256" in out.columns
    assert quality.reject(plain, labels.limit(0)).columns == plain.columns


def test_toxicity_on_held_out_labels(spark, sf, odd):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    scored = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "called").join(labels.where("doc_id % 5 = 0"), "doc_id")
    cells = {(r.toxic, r.called): r["count"] for r in scored.groupBy("toxic", "called").count().collect()}
    assert cells.get((0, True), 0) <= 0.01 * cells[0, False] and cells[1, True] >= 0.75 * (cells[1, True] + cells[1, False])
    assert model.cuts[0] < model.cuts[1]
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    none = toxicity.train(docs.limit(0), labels)
    assert toxicity.score_toxicity(odd, none).where("toxic").count() == 0


def test_toxicity_recall_by_language(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels.where("doc_id % 5 <> 0"))).withColumnRenamed("toxic", "called").join(labels.where("doc_id % 5 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = {r.lang: r for r in scored.groupBy("lang").agg(F.avg(F.when(F.col("toxic") == 1, F.col("called").cast("int"))).alias("recall"), F.count_if((F.col("toxic") == 0) & F.col("called")).alias("wrong")).collect()}
    assert {k: r.recall >= (0.5 if k == "es" else 0.9) for k, r in got.items()} == dict.fromkeys(("de", "en", "es", "fr"), True)
    assert sum(r.wrong for r in got.values()) <= 7


def test_ordinal_fit_against_the_plain_likelihood(spark):
    """The gradient against differences of the likelihood written out by grade, and the fit against plain gradient descent."""
    r = np.random.default_rng(8)
    n, f = 300, 4
    x = r.integers(0, 3, (n, f))
    z = np.log1p(x) @ np.array([1.5, -1.0, 0.5, 0.0]) + r.logistic(size=n)
    grade = (z > 0.5).astype(int) + (z > 1.8)
    row, k = np.nonzero(x)
    c = x[row, k]

    def plain(theta):
        at = np.log1p(x) @ theta[:f]
        up = [np.ones(n), *(1 / (1 + np.exp(-(at - b))) for b in theta[f:]), np.zeros(n)]
        return -sum(math.log(up[g][i] - up[g + 1][i]) for i, g in enumerate(grade))

    theta = np.array([0.3, -0.2, 0.1, 0.4, 0.2, 0.9])
    got = toxicity.slopes(theta, grade, row, k, c)
    steps = np.eye(f + 2) * 1e-5
    assert math.isclose(got[0], plain(theta), rel_tol=1e-9)
    assert np.allclose(got[1 : f + 3], [(plain(theta + s) - plain(theta - s)) / 2e-5 for s in steps], atol=1e-4)
    second = [(toxicity.slopes(theta + s, grade, row, k, c)[1 + i] - toxicity.slopes(theta - s, grade, row, k, c)[1 + i]) / 2e-5 for i, s in enumerate(steps)]
    assert np.allclose(got[f + 3 :], second, rtol=1e-3)
    rows = spark.createDataFrame([(int(g), [int(j) for j in np.flatnonzero(v)], [int(v[j]) for j in np.flatnonzero(v)]) for g, v in zip(grade, x)], "grade int, k array<int>, c array<int>")
    w, cuts = toxicity.fit_ordinal(rows, f)
    slow = np.array([0.0] * f + [0.0, 1.0])
    for _ in range(4000):
        grad = toxicity.slopes(slow, grade, row, k, c)[1 : f + 3]
        slow = slow - 0.002 * (grad + np.array([1.0] * f + [1e-6] * 2) * slow)
    assert np.allclose(np.concatenate((w, cuts)), slow, atol=0.02) and cuts[0] < cuts[1]


def test_grades_of_labels_are_taken(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} {'mud' if i % 4 == 3 else 'sky'} {i}") for i in range(400)] + [(900, None), (901, "")], "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("k", F.lit("x"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic", "IF(doc_id % 4 = 3, 2, 1) AS severity").where("doc_id < 400")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 402 and got[3].p_severe > 0.5 > got[1].p_severe and got[1].toxic and not got[2].toxic and not got[900].toxic
    assert math.isclose(got[3].expected_severity, got[3].p_toxic + got[3].p_severe)


def test_toxicity_uses_all_telling_words_and_counts_copies_once(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    bad, plain = [word() for _ in range(400)], [word() for _ in range(50)]
    rows = [(" ".join([*r.choices(plain, k=6), bad[i % 400], str(i)]), 1) for i in range(4000)] + [(" ".join([*r.choices(plain, k=6), str(i)]), 0) for i in range(4000, 16000)]
    rows += [("zebra tulips here", 1)] * 200
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    tried = spark.createDataFrame([(i, f"{plain[0]} {w}") for i, w in enumerate(bad)] + [(1000, "zebra tulips there")], "doc_id bigint, text string")
    assert {r.doc_id for r in toxicity.score_toxicity(tried, model).where("toxic").collect()} == set(range(400))
    # steps summed by jobs
    other = toxicity.train(docs, labels, local=0)
    assert np.array_equal(model.known, other.known) and np.allclose(model.weights, other.weights, atol=0.01) and np.allclose(model.cuts, other.cuts, atol=0.01)


@pytest.mark.parametrize("remembered", [0, 1, 256])
def test_linked_joins_all_components(remembered):
    """Drifting sets make components that grow side by side and meet late, whichever is the largest in between."""

    def named(n, links):
        label = list(range(n))
        for a, b in links:
            x, y = label[a], label[b]
            label = [min(x, y) if z in (x, y) else z for z in label]
        return label

    for seed in range(200):
        r, made = np.random.default_rng(seed), []
        for _ in range(int(r.integers(2, 16))):
            last = made[-1] if made and r.random() < 0.85 else np.arange(12)
            made.append(np.unique(np.concatenate((r.choice(last, len(last) - 1, False), r.integers(12, 40, 1)))))
        made = [made[i] for i in r.permutation(len(made))]
        truth = [(i, j) for i in range(len(made)) for j in range(i) if 100 * len(np.intersect1d(made[i], made[j])) >= 80 * len(np.union1d(made[i], made[j]))]
        got = jaccard_join.linked(np.arange(len(made)), made, 80, remembered)
        assert named(len(made), got) == named(len(made), truth)
        assert all((a, b) in truth or (b, a) in truth for a, b in got)
