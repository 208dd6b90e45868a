"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text gives each document a perplexity, and
documents above their language's quantile of the trusted documents' perplexities are rejected.

The grams are of ORDER bytes of UTF-8, so that a gram is a number and word formation in any language is modelled. One pass
counts every gram of every document, and how often it occurs in trusted ones. Count tables of all orders, sharded by
the bytes before the last, are joined with the documents' distinct grams, which gives each gram that occurs its log probability;
another pass adds these up by document. A model is kinder to the text it was trained on, so every HELD_OUT-th
trusted document, by a hash of its id, is left out of the training and the quantiles are taken over those. The table of
grams grows with the text, more and more slowly: up to TABLE_ROWS rows (counted) it is sent to every task, beyond that its
rows are joined to blocks of documents by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadweave.llm.common import name_of, numbered, slices, small, text_bytes, text_of, written

ORDER = 5
#: Quantile of trusted perplexities, by language, above which a document is rejected; trusted documents that a language needs
#: for a threshold of its own; bytes' worth of the average that steadies the estimate of short texts.
QUANTILE, ENOUGH, STEADY = 0.99, 30, 200.0
HELD_OUT = 4
TABLE_ROWS, BLOCK_BYTES = 4_000_000, 16 << 20
PAD = 2
#: Shards of the count tables. The two bytes before the last go to one shard; what depends on fewer bytes is summed over all.
SHARDS = 256


def grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte, texts starting after pad bytes, and the texts' offsets."""
    off, data = text_bytes(column)
    n = len(off) - 1
    pads = order - 1
    wide = np.full(len(data) + pads * n, PAD, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(off))
    at = np.arange(len(data)) + pads * (doc + 1)
    wide[at] = data
    value = np.zeros(len(wide), np.uint64)
    for k in range(order):
        value[k:] |= wide[: len(wide) - k].astype(np.uint64) << np.uint64(8 * k)
    return value[at].view(np.int64), off


def counted(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.Series | None = None
        for batch in batches:
            for part in slices(batch, "__text"):
                g, off = grams(part.column("__text"), order)
                trusted = np.repeat(part.column("__trusted").to_numpy(zero_copy_only=False), np.diff(off))
                codes, distinct = pd.factorize(g)
                got = pd.Series(np.bincount(codes, weights=trusted, minlength=len(distinct)), distinct)
                total = got if total is None else total.add(got, fill_value=0)
                if len(total) > 2_000_000:
                    yield emit(total)
                    total = None
        if total is not None:
            yield emit(total)

    return count


def emit(total: pd.Series) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"g": pa.array(total.index.to_numpy(np.int64)), "c": pa.array(total.to_numpy().astype(np.int64))})


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))  # type: ignore[return-value]


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def levels_of(g: np.ndarray, c: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Grams of each length from `order` down to 2 with their counts: occurrences for the longest, for shorter ones how many
    different bytes stand before them (for those of length 2: in this shard)."""
    by = np.argsort(g[c > 0])
    out = {order: (g[c > 0][by], c[c > 0][by])}
    for n in range(order - 1, 1, -1):
        out[n] = distinct_counts(out[n + 1][0] & ((1 << 8 * n) - 1))
    return out


def shard_counts(order: int):
    """Of a shard: how many grams of length n have count c (1 to 4), and, as n = 2, the count k of each pair of bytes c."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out, levels = [], levels_of(rows["g"].to_numpy(), rows["c"].to_numpy(), order)
        for n in range(3, order + 1):
            out += [(n, k, int((levels[n][1] == k).sum())) for k in (1, 2, 3, 4)]
        out += [(2, int(pair), int(k)) for pair, k in zip(*levels[2])]
        return pd.DataFrame(out, columns=["n", "c", "k"])

    return count


def cut_off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


def counts_of_counts(c: np.ndarray) -> dict[int, int]:
    return {k: int((c == k).sum()) for k in (1, 2, 3, 4)}


def pair_probabilities(pairs: dict[int, int]) -> np.ndarray:
    """The probability of each byte after each byte (of the pair's number), from the counts of pairs of bytes."""
    count = np.zeros((256, 256), np.int64)
    for pair, k in pairs.items():
        count[pair >> 8, pair & 255] = k
    follow = (count > 0).sum(axis=0)
    off = cut_off(follow, discounts(counts_of_counts(follow)))
    single = (follow - off + off.sum() / 256) / follow.sum() if follow.sum() else np.full(256, 1 / 256)
    off, total = cut_off(count, discounts(counts_of_counts(count))), count.sum(axis=1, keepdims=True)
    return np.where(total > 0, (count - off + off.sum(axis=1, keepdims=True) * single) / np.maximum(total, 1), single).ravel()


def shard_join(order: int, cuts: dict[int, tuple[float, float, float]], pair: np.ndarray):
    """Joins a shard's grams with its count tables of all lengths from 3, the shortest first: g, lp."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows["g"].to_numpy()
        p = pair[g & 0xFFFF]
        levels = levels_of(g, rows["c"].to_numpy(), order)
        for n in range(3, order + 1):
            keys, c = levels[n]
            if not len(keys):
                continue
            off = cut_off(c, cuts[n])
            contexts, first = np.unique(keys >> 8, return_index=True)
            total, left = np.add.reduceat(c, first), np.add.reduceat(off, first)
            x = g & ((1 << 8 * n) - 1)
            k, h = np.minimum(np.searchsorted(keys, x), len(keys) - 1), np.minimum(np.searchsorted(contexts, x >> 8), len(contexts) - 1)
            known = np.where(keys[k] == x, c[k] - off[k], 0.0)
            p = np.where(contexts[h] == x >> 8, (known + left[h] * p) / total[h], p)
        return pd.DataFrame({"g": g, "lp": np.log(p)})

    return join


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """g, lp of every gram of `counts` (g, c: occurrences in trusted text, which may be 0).

    Shards go by the two bytes before the last: a gram, its endings of three bytes or more and their contexts all share them, so
    that each shard's count tables are joined in one place. Pairs of bytes, 65,536 at most, are summed over the shards."""
    shard = F.pmod(F.xxhash64(F.shiftright("g", 8).bitwiseAND(0xFFFF)), F.lit(SHARDS))
    told: dict[int, dict[int, int]] = {n: {} for n in range(2, order + 1)}
    for r in counts.groupBy(shard).applyInPandas(shard_counts(order), "n int, c int, k bigint").groupBy("n", "c").agg(F.sum("k").alias("k")).collect():
        told[r.n][r.c] = r.k
    cuts = {n: discounts(told[n]) for n in range(3, order + 1)}
    return counts.groupBy(shard).applyInPandas(shard_join(order, cuts, pair_probabilities(told[2])), "g bigint, lp double")


def added(table: np.ndarray, lp: np.ndarray, part: pa.RecordBatch, order: int) -> tuple[pa.Array, pa.Array]:
    """Negative log probability and bytes of each text."""
    g, off = grams(part.column("__text"), order)
    where = pd.Index(table).get_indexer(g) if len(g) else np.zeros(0, np.int64)
    sums = np.concatenate(([0.0], np.cumsum(-lp[where]))) if len(g) else np.zeros(1)
    return pa.array(sums[off[1:]] - sums[off[:-1]]), pa.array(np.diff(off))


def held_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT)) == 0


def with_scores(part: pa.RecordBatch, nll: pa.Array, n: pa.Array) -> pa.RecordBatch:
    keep = {c: part.column(c) for c in part.schema.names if c not in ("__text", "__trusted", "__block")}
    return pa.RecordBatch.from_pydict(keep | {"__known": part.column("__trusted"), "__nll": nll, "__n": n})


def score(docs: DataFrame, trusted: DataFrame, order: int = ORDER, table_rows: int = TABLE_ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' columns with __known (the document is trusted), __nll and __n. trusted: ids in a column named id_col, a row each.

    Null texts are empty and have __nll 0. Without trusted text every byte has the probability 1/256."""
    spark, rows, id_ = docs.sparkSession, numbered(docs), name_of(docs, id_col)
    flag = trusted.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__flag", F.lit(True))
    rows = rows.join(small(flag), F.col(id_) == F.col("__id"), "left").withColumns({"__trusted": F.coalesce("__flag", F.lit(False)), "__text": text_of(name_of(docs, text_col))}).drop("__id", "__flag")
    taught = F.col("__trusted") & ~held_out(id_)
    counts = rows.select("__text", taught.alias("__trusted")).mapInArrow(counted(order), "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
    table = written(log_probabilities(written(counts, "gram-counts"), order), "gram-table")
    schema = T.StructType([*numbered(docs).schema.fields, T.StructField("__known", T.BooleanType()), T.StructField("__nll", T.DoubleType()), T.StructField("__n", T.LongType())])
    names = [*docs.columns, "__known", "__nll", "__n"]
    if table.count() <= table_rows:
        held = table.toArrow()
        sent = spark.sparkContext.broadcast((held.column("g").to_numpy(), held.column("lp").to_numpy()))
        del held

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "__text"):
                    yield with_scores(part, *added(*sent.value, part, order))

        return rows.mapInArrow(near, schema).toDF(*names)

    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = max(1, size // BLOCK_BYTES)
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(id_, "__text"), F.lit(blocks)))

    def distinct(t: pa.Table) -> pa.Table:
        parts = [pd.unique(grams(p.column("__text"), order)[0]) for b in t.combine_chunks().to_batches() for p in slices(b, "__text")]
        g = pd.unique(np.concatenate(parts))
        return pa.table({"b": pa.array(np.full(len(g), t.column("__block")[0].as_py(), np.int64)), "g": pa.array(g)})

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        by = np.argsort(right.column("g").to_numpy())
        g, lp = right.column("g").to_numpy()[by], right.column("lp").to_numpy()[by]
        parts = [with_scores(p, *added(g, lp, p, order)) for b in left.combine_chunks().to_batches() for p in slices(b, "__text")]
        return pa.Table.from_batches(parts)

    wanted = dealt.select("__text", "__block").groupBy("__block").applyInArrow(distinct, "b bigint, g bigint").join(table, "g")
    return dealt.groupBy("__block").cogroup(wanted.groupBy("b")).applyInArrow(far, schema).toDF(*names)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, table_rows: int = TABLE_ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """docs' columns and __perplexity, __threshold, __kept; see classify."""
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name_of(docs, id_col))).agg(F.min("quality").alias("q")).where("q = 1")
    id_, lang_ = name_of(docs, id_col), name_of(docs, lang_col)
    scored = written(score(numbered(docs), trusted, order, table_rows, name_of(docs, text_col), id_), "perplexity")
    scored = scored.withColumn("__lang", F.coalesce(F.col(lang_).cast("string"), F.lit("")))
    measured = F.col("__known") & (F.col("__n") > 0) & held_out(id_)
    known = scored.where(measured)
    means = known.groupBy("__lang").agg((F.sum("__nll") / F.sum("__n")).alias("__mean"), F.count("*").alias("__rows"))
    mean = known.groupBy().agg((F.sum("__nll") / F.sum("__n")).alias("m")).first().m
    joined = scored.join(small(means), "__lang", "left")
    usual = F.coalesce(F.when(F.col("__rows") >= ENOUGH, F.col("__mean")), F.lit(mean), F.lit(0.0))
    joined = joined.withColumn("__perplexity", F.exp((F.col("__nll") + STEADY * usual) / (F.col("__n") + STEADY)))
    cut = F.percentile_approx("__perplexity", quantile, 10_000)
    cuts = joined.where(measured).groupBy("__lang").agg(F.when(F.count("*") >= ENOUGH, cut).alias("__own"))
    overall = joined.where(measured).groupBy().agg(cut.alias("t")).first().t
    out = joined.join(small(cuts), "__lang", "left").withColumn("__threshold", F.coalesce("__own", F.lit(overall).cast("double")))
    out = out.withColumn("__kept", F.coalesce(F.col("__perplexity") <= F.col("__threshold"), F.lit(True)))
    return out.select(*numbered(docs).columns, "__perplexity", "__threshold", "__kept").toDF(*docs.columns, "__perplexity", "__threshold", "__kept")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs' columns and perplexity, threshold, kept, a row for each row of docs. options: those of judge.

    Trusted are documents labelled quality 1 (and never 0). A null text is empty; an empty one has the perplexity of its
    language's average. A null language is one of its own; languages with few trusted documents take the threshold over all.
    Without trusted documents the threshold is null and every row is kept. Repeated rows each have their row; columns of docs
    that are named like a result are replaced by it."""
    names = {"__" + n: n for n in ("perplexity", "threshold", "kept")}
    return judge(docs.drop(*names.values()), labels, **options).withColumnsRenamed(names)


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with docs' columns, whatever their names; nulls, ties, repeated rows and empty tables as
    in classify."""
    return judge(docs, labels, **options).where("__kept").drop("__perplexity", "__threshold", "__kept")
