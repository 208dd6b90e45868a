"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words, and runs of GRAMS bytes of words and their edges, whose presence sets toxic texts apart, found by counting
every distinct labelled text once. All that are telling are used, however many they are. Grades: 0 for texts labelled clean. Those
labelled toxic get the `severity` (1 or 2) of their label; where labels have none, 2 if they hold at least the median number of
telling words, else 1. Which words those are is learnt from the other half of the labelled texts, so that no text's own
label has a part in its grade. One weight vector serves all thresholds: P(grade >= k) = sigmoid(w.x - b_k) with b_1 < b_2, and
the likelihood is that of the grades, P(grade = k) = P(grade >= k) - P(grade >= k + 1).
The expected severity is the sum of P(grade >= k); a document is toxic if P(grade >= 1) is at least one half.

Features are counted over all distinct labelled texts. The regression is fitted to SAMPLE values of their features at most: beyond
that, to a share of the texts by a hash of their content. Up to LOCAL values are fitted in the driver, more of them (with a
larger sample) by jobs, which sum each step's loss, gradient and curvature."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import RangeHash, mix, slices, small, spread, text_of, written
from threadweave.llm.decontamination import split
from threadweave.llm.exact_dedup import normalised

#: Texts that a feature must occur in; lengths of the byte runs; values (a text's distinct features, of all texts together) that
#: the fit uses at most, and that are fitted in the driver at most (24 bytes a value).
SUPPORT, GRAMS, SAMPLE, LOCAL = 8, (4, 5), 1_500_000, 2_000_000
#: Cells of a matrix of texts and features that a task fills at once.
CELLS = 16 << 20
#: Log-likelihood ratio (a chi-squared value of one degree) from which a feature is telling.
TELLING = 20.0
GRADES = 3
#: Shares in which samples are measured.
SHARES = 1 << 20


@dataclass
class Model:
    known: np.ndarray  # hashes of the features, ascending; even for words, odd for byte runs
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text, a column for each k."""
        row, k, c = features(self.known, column)
        z = np.bincount(row, np.log1p(c) * self.weights[k], len(column))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts, -40, 40)))


def vocabulary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: the text and the distinct word of each word; the distinct word and the hash of each feature, by word."""
    data, start, end, hashes, first = split(column)
    _, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    # the distinct words one after the other, each between two spaces, which no word holds
    n = end[at] - start[at]
    base = np.cumsum(n + 2) - (n + 2)
    padded = np.full(int((n + 2).sum()), 32, np.uint8)
    padded[spread(base + 1, n)] = data[spread(start[at], n)]
    hashed = RangeHash(padded)
    runs = []
    for size in GRAMS:
        runs.append(np.maximum(n + 2 - size, -1) + 1)
        runs[-1][n + 2 == size] = 0  # the whole word
    total = 1 + sum(runs)
    place = np.cumsum(total) - total
    feature = np.empty(int(total.sum()), np.uint64)
    feature[place] = hashes[at] & ~np.uint64(1)
    place += 1
    for size, r in zip(GRAMS, runs):
        begin = spread(base, r)
        feature[spread(place, r)] = mix(hashed(begin, begin + size)) | np.uint64(1)
        place += r
    return np.repeat(np.arange(len(first) - 1), np.diff(first)), word, np.repeat(np.arange(len(at)), total), feature


def features(known: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and its number of occurrences, for the known features of each text, in order."""
    none = np.zeros(0, np.int64)
    if not len(known):
        return none, none, none
    doc, word, owner, feature = vocabulary(column)
    k = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hit = known[k] == feature
    owner, k = owner[hit], k[hit]
    n = np.bincount(owner, minlength=int(word.max()) + 1 if len(word) else 0)
    begin, at = np.cumsum(n) - n, np.flatnonzero(n[word])
    n = n[word[at]]
    key = np.repeat(doc[at], n) * len(known) + k[spread(begin[word[at]], n)]
    if len(column) * len(known) <= CELLS:
        count = np.bincount(key)
        key = np.flatnonzero(count)
        count = count[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return key // len(known), key % len(known), count


COUNTS = ("n", "bad", "n1", "bad1")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic ones, that hold each feature: all of them, and those of half 1."""
    for batch in batches:
        for part in slices(batch):
            doc, word, owner, feature = vocabulary(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False) > 0
            half = part.column("half").to_numpy(zero_copy_only=False) == 1
            n_words = int(word.max()) + 1 if len(word) else 0
            pair = np.unique(doc * max(1, n_words) + word)
            doc, word = pair // max(1, n_words), pair % max(1, n_words)
            known, k = np.unique(feature, return_inverse=True)
            n = np.bincount(owner, minlength=n_words)
            begin, n = (np.cumsum(n) - n)[word], n[word]
            total, of = np.zeros((4, len(known)), np.int64), np.stack((np.ones(len(toxic)), toxic, half, toxic & half)).astype(np.float32)
            some = max(1, CELLS // max(1, len(known)))
            for a in range(0, len(toxic), some):
                i, j = np.searchsorted(doc, (a, a + some))
                held = np.zeros((min(some, len(toxic) - a), len(known)), bool)
                held[np.repeat(doc[i:j] - a, n[i:j]), k[spread(begin[i:j], n[i:j])]] = True
                total += (of[:, a : a + some] @ held.astype(np.float32)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(known.view(np.int64)), **{c: pa.array(t) for c, t in zip(COUNTS, total)}})


def likelihood_ratio(n: Column, a: Column, docs: int, toxic: int) -> Column:
    """2 * sum of observed * log(observed / expected) over the four cells of word and label, for words in n texts, a of them
    toxic; negative for words of clean texts."""
    cells = ((a, n, toxic), (n - a, n, docs - toxic), (F.lit(toxic) - a, F.lit(docs) - n, toxic), (F.lit(docs - toxic) - (n - a), F.lit(docs) - n, docs - toxic))
    g2 = sum((F.when(o > 0, 2 * o * F.log(o * docs / (row * col))).otherwise(0.0) for o, row, col in cells), F.lit(0.0))
    return F.when(a * docs > n * toxic, g2).otherwise(-g2)


def slopes(theta: np.ndarray, grade: np.ndarray, row: np.ndarray, k: np.ndarray, c: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """The negative log-likelihood of these rows' grades; its gradient by theta, weights and cuts; and the diagonal of its second
    derivatives. Cuts that don't rise are infinitely unlikely.

    A difference of two sigmoids is sigmoid(z - b) * (1 - sigmoid(z - b')) * (1 - exp(b - b')), so that a row of grade g has one
    logistic term for the cut below its grade, one for the cut above, and one that is about the cuts alone."""
    f, x = len(theta) - grades + 1, np.log1p(c)
    z = np.bincount(row, x * theta[k], len(grade))
    out, pull, bend = np.zeros(2 * len(theta) + 1), np.zeros(len(grade)), np.zeros(len(grade))
    grad, curve = out[1 : len(theta) + 1], out[len(theta) + 1 :]
    for j in range(1, grades):
        m, y, near = z - theta[f + j - 1], grade >= j, (grade == j) | (grade == j - 1)
        p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        out[0] += np.logaddexp(0, np.where(y, -m, m))[near].sum()
        grad[f + j - 1] += (y - p)[near].sum()
        curve[f + j - 1] += (p * (1 - p))[near].sum()
        pull += np.where(near, p - y, 0.0)
        bend += np.where(near, p * (1 - p), 0.0)
    for j in range(1, grades - 1):
        n, gap = (grade == j).sum(), theta[f + j] - theta[f + j - 1]
        if n and gap <= 0:
            out[0] = np.inf
        elif n:
            less = 1 / np.expm1(gap)
            out[0] -= n * np.log(-np.expm1(-gap))
            grad[f + j] -= n * less
            grad[f + j - 1] += n * less
            curve[f + j - 1 : f + j + 1] += n * less * (1 + less)
    grad[:f], curve[:f] = np.bincount(k, x * pull[row], f), np.bincount(k, x * x * bend[row], f)
    return out


def minimum(sums: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, penalty: np.ndarray, steps: int = 200, near: float = 1e-3, gain: float = 1e-6) -> np.ndarray:
    """Where sums' first value plus penalty.theta^2 / 2 is least: limited-memory BFGS steps from the diagonal of the second
    derivatives, halved until the value falls, until no slope exceeds `near` or a step gains less than `gain` of the value."""
    n = len(theta)

    def value(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = sums(t)
        return s[0] + (penalty * t * t).sum() / 2, s[1 : n + 1] + penalty * t, s[n + 1 :] + penalty

    (at, grad, curve), past = value(theta), []
    for _ in range(steps):
        if np.abs(grad).max() < near:
            break
        way, used = grad.copy(), []
        for s, y in reversed(past):
            used.append((s @ way) / (s @ y))
            way -= used[-1] * y
        way /= curve
        for (s, y), a in zip(past, reversed(used)):
            way += s * (a - (y @ way) / (s @ y))
        size = min(1.0, 5.0 / max(1e-9, np.abs(way).max()))
        while True:
            new = theta - size * way
            got, slope, bent = value(new)
            if got <= at - 1e-4 * size * (way @ grad) or size < 1e-6:
                break
            size /= 2
        if got >= at:  # no digits left
            break
        if (new - theta) @ (slope - grad) > 0:
            past = [*past, (new - theta, slope - grad)][-10:]
        done = at - got < gain * got
        theta, at, grad, curve = new, got, slope, bent
        if done:
            break
    return theta


def flat(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """The arguments of slopes from rows (grade, k, c)."""
    grade, k, c = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in map(batch.column, ("grade", "k", "c")))
    row = np.repeat(np.arange(len(grade)), np.diff(k.offsets.to_numpy()))
    return grade.to_numpy(zero_copy_only=False), row, k.flatten().to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False)


def summed(rows: DataFrame, grades: int) -> Callable[[np.ndarray], np.ndarray]:
    """slopes over a table of rows, by a job for each call."""

    def sums(theta: np.ndarray) -> np.ndarray:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * len(theta) + 1)
            for b in batches:
                total += slopes(theta, *flat(b), grades)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "v": pa.array(total[at])})

        got = rows.mapInArrow(some, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(2 * len(theta) + 1)
        out[got["at"].to_numpy(int)] = got["v"]
        return out

    return sums


def fit_ordinal(rows: DataFrame, f: int, local: int = LOCAL, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of f features and rising cuts with the least penalised loss over all rows (grade, k, c). A grade that no row has
    is as good as impossible: its cut is that of the next grade, or beyond all where there is none."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.size("k") + 1).alias("values"), *(F.count_if(F.col("grade") >= j).alias(f"g{j}") for j in range(1, GRADES))).first()
    above = [total["n"], *(total[f"g{j}"] for j in range(1, GRADES)), 0]
    met = [0] + [j for j in range(1, GRADES) if above[j] > above[j + 1]]
    rows = rows.withColumn("grade", sum((F.when(F.col("grade") >= j, 1).otherwise(0) for j in met[1:]), F.lit(0)))
    if total["values"] <= local:
        held = flat(rows.toArrow())
        sums = lambda theta: slopes(theta, *held, len(met))
    else:
        sums = summed(rows, len(met))
    share = np.clip([above[j] / total["n"] for j in met[1:]], 1e-4, 1 - 1e-4) * 0.9 ** np.arange(len(met) - 1)
    theta = minimum(sums, np.concatenate((np.zeros(f), np.log(1 / share - 1))), np.concatenate((np.full(f, penalty), np.full(len(share), 1e-6))))
    cuts = [next((theta[f + i] for i, g in enumerate(met[1:]) if g >= j), 40.0) for j in range(1, GRADES)]
    return theta[:f], np.array(cuts)


def train(docs: DataFrame, labels: DataFrame, local: int = LOCAL, sample: int = SAMPLE, support: int = SUPPORT, telling: float = TELLING, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents. labels: the id, toxic (0 or 1), perhaps severity. Labels without a
    document, null labels and null ids are left out; of several labels of a document or of a text the largest counts; a null
    severity is 1. Texts that are equal when white-space runs become one space count once, empty ones too. Without
    toxic documents, or an empty table, the model has no features and calls nothing toxic."""
    grade = F.greatest(F.lit(1), F.least(F.col("severity").cast("int"), F.lit(GRADES - 1))) if "severity" in [c.lower() for c in labels.columns] else F.lit(1)
    one = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.when(F.col("toxic") > 0, grade).otherwise(0)).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("text"))
    rows = texts.join(small(one), "__id").groupBy(F.sha2("text", 256).alias("sha")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    # the half by one bit of the content's hash, the place among the samples by others
    hashed = F.xxhash64("sha")
    rows = written(rows.select("text", "toxic", F.pmod(hashed, F.lit(2)).alias("half"), F.pmod(F.shiftright(hashed, 1), F.lit(SHARES)).alias("place")), "labelled")
    bad = F.col("toxic") > 0
    seen = rows.groupBy().agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("half") == 1).alias("n1"), F.count_if(bad & (F.col("half") == 1)).alias("bad1")).first()
    if not seen.bad or seen.bad == seen.n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0 if not seen.bad else -40.0))
    counts = rows.mapInArrow(counted, "feature bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS])

    def tells(n: Column, a: Column, docs: int, toxic: int, least: int) -> Column:
        return (n >= least) & (a > 0) & (likelihood_ratio(n, a, docs, toxic) >= telling)

    n, a, n1, a1 = map(F.col, COUNTS)
    told = [tells(n, a, seen.n, seen.bad, support), tells(n - n1, a - a1, seen.n - seen.n1, seen.bad - seen.bad1, support // 2), tells(n1, a1, seen.n1, seen.bad1, support // 2)]
    found = counts.select("feature", *[t.alias(c) for t, c in zip(told, ("all", "in0", "in1"))]).where("all OR in0 OR in1").toPandas()
    feature = found["feature"].to_numpy(np.int64).view(np.uint64)
    known = np.sort(feature[found["all"].to_numpy(bool)])
    word = feature & np.uint64(1) == 0
    # for texts of half 0 the words that half 1 tells, and the other way round
    other = [np.sort(feature[found[c].to_numpy(bool) & word]) for c in ("in1", "in0")]
    every = np.unique(feature)
    place = np.where(np.isin(every, known), np.searchsorted(known, every), -1)
    counts_as_hit = np.stack([np.isin(every, o) for o in other])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, k, c = features(every, part.column("text"))
                half = part.column("half").to_numpy(zero_copy_only=False).astype(int)
                hits = np.bincount(row, c * counts_as_hit[half[row], k], part.num_rows).astype(np.int64)
                used = place[k] >= 0
                row, k, c = row[used], place[k[used]], c[used]
                first = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                k, c = (pa.ListArray.from_arrays(first, pa.array(v.astype(np.int32))) for v in (k, c))
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic").cast(pa.int32()), "hits": pa.array(hits), "place": part.column("place"), "k": k, "c": c})

    rows = written(rows.mapInArrow(encoded, "toxic int, hits bigint, place bigint, k array<int>, c array<int>"), "encoded")
    values = rows.agg(F.sum(F.size("k") + 1)).first()[0]
    if "severity" in [c.lower() for c in labels.columns]:
        grade = F.col("toxic")
    else:
        median = rows.where("toxic > 0").agg(F.percentile("hits", F.lit(0.5)).alias("m")).first().m
        grade = F.when(F.col("toxic") > 0, F.when(F.col("hits") >= median, 2).otherwise(1)).otherwise(0)
    fitted = rows.where(F.col("place") < SHARES * sample // values)
    return Model(known, *fit_ordinal(fitted.select(grade.alias("grade"), "k", "c"), len(known), local))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to 2), p_toxic, p_severe, toxic of every row. A null or wordless text has no features and
    gets the model's base rate; repeated rows and null ids each have their row; other columns are ignored."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = model.severity(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "expected_severity": pa.array(p.sum(axis=1)), "p_toxic": pa.array(p[:, 0]), "p_severe": pa.array(p[:, 1]), "toxic": pa.array(p[:, 0] >= 0.5)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, expected_severity double, p_toxic double, p_severe double, toxic boolean")
