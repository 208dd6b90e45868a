"""Batch retrieval: exact nearest neighbours, leakage-safe exclusion, expansion over the graph, score fusion, top-k. Everything
is keyed by query, so all queries of a batch run as one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions.scalars import min_max
from threadweave.operators.tables import first_by

# Defaults of retrieval and fusion.
PATH_WEIGHT, OWN_WEIGHT, EXPANSION_CAP, TOP_K, TWO_HOP_LIMIT = 0.7, 0.3, 0.4, 5, 50
#: Numbers in a block of vectors: a task meets a block of queries and a block of vectors. Vectors in a block at most. Cells of similarities
#: that it fills at once.
NUMBERS, BLOCK, CELLS = 4 << 20, 1 << 16, 2 << 20
#: Blocks that queries are dealt into even if they would fit into fewer, if that leaves them this many each.
SHARES, SHARE = 16, 2048
#: More than a rounding to 9 places moves a value.
CLOSE = 2e-9


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None, threshold: float = -1.0, id_col: str = "id", vec_col: str = "v", block: int | None = None, below: float | None = None) -> DataFrame:
    """query, id, sim: each query's k vectors of greatest cosine (all, if k is None), its own id left out, at least `threshold` and less
    than `below`. With `below`, near-duplicates are passed over in the search itself, so that nobody has to list them."""
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.lit(k).cast("bigint").alias("k"))
    return best_of_blocks(asked, vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), threshold, block, below)


def blocks_of(n: int, numbers: int, block: int | None) -> int:
    """How many blocks n vectors of so many numbers make."""
    return max(1, -(-n // (block or max(1, min(BLOCK, NUMBERS // max(1, numbers))))))


def best_of_blocks(queries: DataFrame, vectors: DataFrame, threshold: float, block: int | None = None, below: float | None = None) -> DataFrame:
    """query, id, sim: each query's own number k of nearest vectors (a null k: all of them), k a column of the queries. Vectors whose
    cosine to the query, or to its column `bar` if there is one, is `below` or more are passed over.

    Queries and vectors are dealt into blocks by a hash of their ids, and each block of queries meets each block of vectors in
    one task, by matrix products; nothing passes through the driver. A task gives out its best k of each query, which an
    aggregation by query merges. Each block is copied for each block that it meets, so they are as large as a task's memory allows."""
    (na, da), (nb, db) = (d.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for d in (queries, vectors))
    nq, nv = (blocks_of(n, max(da, db), block) for n in (na, nb))
    if block is None:
        nq = max(nq, min(-(-SHARES // nv), -(-na // SHARE)))
    block_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", block_of(nq)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    right = vectors.withColumn("vb", block_of(nv)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(asked) and len(held):
            vid, v = held.column("id").to_numpy(), unit(matrix(held.column("v")))
            qid, q = asked.column("id").to_numpy(), unit(matrix(asked.column("v")))
            bar = unit(matrix(asked.column("bar"))) if "bar" in asked.column_names else q
            take = np.minimum(asked.column("k").fill_null(len(vid)).to_numpy(), len(vid))
            step = max(1, CELLS // len(vid))
            parts = [closest(qid[a : a + step], q[a : a + step], take[a : a + step], vid, v, threshold, below, bar[a : a + step]) for a in range(0, len(qid), step)]
            out = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({n: pa.array(x) for n, x in zip(("query", "id", "sim"), out)})

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(search, "query bigint, id bigint, sim double")
    if nv == 1:
        return found
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "id"))
    limits = queries.select(F.col("id").alias("query"), "k").distinct()
    return found.withColumn("place", place).join(limits, "query").where("k IS NULL OR place <= k").select("query", "id", "sim")


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(lists.combine_chunks().flatten(), np.float64).reshape(len(lists), -1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("qd,vd->qv", q, v) if min(q.shape[0], v.shape[0], q.shape[1]) < 2 else q @ v.T


def closest(qid: np.ndarray, q: np.ndarray, take: np.ndarray, vid: np.ndarray, v: np.ndarray, threshold: float, below: float | None = None, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, sim of the `take` nearest of each query: by similarity, ties by id. Rounding makes ties of what is equal but for
    the last bits; only what reaches a row's last place is rounded and sorted. Vectors whose cosine to the query's `bar` is `below` or more
    are passed over."""
    sims = products(q, v)
    if below is not None:
        sims[(sims if bar is None or bar is q or np.shares_memory(bar, q) else products(bar, v)) >= below] = -np.inf
    return best_of(sims, qid, take, vid, threshold)


def best_of(sims: np.ndarray, qid: np.ndarray, take: np.ndarray, vid: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, sim: the `take` greatest of each row, a query's own id left out; what is -inf isn't there."""
    sims[qid[:, None] == vid[None, :]] = -np.inf
    floor = np.full(len(qid), threshold if threshold > -1 else -2.0)
    for k in np.unique(take):
        if 0 < k < len(vid):
            of = np.flatnonzero(take == k)
            last = np.partition(sims if len(of) == len(qid) else sims[of], len(vid) - k, axis=1)[:, len(vid) - k]
            floor[of] = np.maximum(floor[of], last - CLOSE)
    row, col = np.nonzero(sims >= floor[:, None])
    keyed = np.round(sims[row, col], 9)
    order = np.lexsort((vid[col], -keyed, row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    ok = nth < take[row]
    return qid[row[ok]], vid[col[ok]], sims[row[ok], col[ok]]


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """query, id, sim of distinct pairs (query, id) of which both have a vector (id, v)."""
    side = lambda name, v: vectors.where(F.col("v").isNotNull()).select(F.col("id").alias(name), F.col("v").alias(v))
    both = pairs.select("query", "id").distinct().join(side("id", "b"), "id").join(side("query", "a"), "query").select("query", "id", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (unit(matrix(pa.chunked_array([batch.column(c)]))) for c in "ab")
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(np.einsum("rd,rd->r", a, b))], names=["query", "id", "sim"])

    kind = dict(pairs.dtypes)
    return both.mapInArrow(work, f"query {kind['query']}, id {kind['id']}, sim double")


def similar_among(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """query, id: those of the pairs, of two ids, that are similar by `threshold` or more. What is excluded for near-duplicates is looked up by this
    for candidates alone; all near-duplicates of all queries grow with the square of the vectors."""
    return pair_cosines(pairs.where("query <> id"), vectors).where(F.col("sim") >= threshold).select("query", "id")


def similar_pairs(queries: DataFrame, vectors: DataFrame, threshold: float, **columns: str) -> DataFrame:
    """query, id, sim: all pairs of cosine `threshold` or more, such as near-duplicate questions."""
    return nearest(queries, vectors, None, threshold, **columns)


def nearest_with_room(queries: DataFrame, vectors: DataFrame, excluded: DataFrame, n: int, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """As many nearest vectors that n are left of each query whatever is excluded: n and the number of ids excluded for it."""
    more = excluded.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("more"))
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).join(more, "id", "left").select("id", "v", (F.lit(n) + F.coalesce("more", F.lit(0))).alias("k"))
    return best_of_blocks(asked, vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), -1.0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def without_excluded(candidates: DataFrame, excluded: DataFrame, col: str) -> DataFrame:
    """Candidates whose `col` isn't excluded for their query (excluded: query, id)."""
    return candidates.join(excluded.select("query", F.col("id").alias(col)), ["query", col], "left_anti")


def anchors(similar: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """The n most similar of each query after exclusion, with rank."""
    left = without_excluded(similar, excluded, "id")
    return first_by(left, ["query"], [F.desc(F.round("sim", 9)), "id"], n)


def answerable_anchors(similar: DataFrame, excluded: DataFrame, answers: DataFrame, n: int, depth: int = 400, excluded_answers: DataFrame | None = None) -> DataFrame:
    """As anchors, but of the first `depth` only those that have an answer, one that isn't among the excluded answers (query, id) if
    those are given: ids of questions say nothing about answers."""
    near = first_by(without_excluded(similar, excluded, "id"), ["query"], [F.desc(F.round("sim", 9)), "id"], depth)
    has = near.join(answers.select(F.col("qid").alias("id"), "aid"), "id")
    if excluded_answers is not None:
        has = without_excluded(has, excluded_answers, "aid")
    return first_by(near.join(has.select("query", "id").distinct(), ["query", "id"], "left_semi"), ["query"], [F.desc(F.round("sim", 9)), "id"], n)


def one_hop(found: DataFrame, answers: DataFrame, excluded: DataFrame) -> DataFrame:
    """query, via, aid, weight, hop: answers of the anchors; excluded ones are out."""
    rows = found.select("query", F.col("id").alias("via")).join(answers.select(F.col("qid").alias("via"), "aid", "weight"), "via")
    return without_excluded(rows, excluded, "aid").select("query", "via", "aid", "weight", F.lit("1").alias("hop"))


def two_hop(found: DataFrame, edges: DataFrame, answers: DataFrame, excluded: DataFrame, excluded_answers: DataFrame | None = None, limit: int = TWO_HOP_LIMIT) -> DataFrame:
    """Answers of the anchors' neighbours, weights multiplied, exclusion at both steps (of answers only if those are given); the `limit` best
    over all anchors of a query."""
    mid = found.select("query", F.col("id").alias("src")).join(edges.select("src", F.col("dst").alias("via"), F.col("weight").alias("w")), "src").select("query", "via", "w")
    mid = without_excluded(mid, excluded, "via")
    rows = mid.join(answers.select(F.col("qid").alias("via"), "aid", "weight"), "via").select("query", "via", "aid", (F.col("w") * F.col("weight")).alias("weight"), F.lit("2").alias("hop"))
    if excluded_answers is not None:
        rows = without_excluded(rows, excluded_answers, "aid")
    return first_by(rows, ["query"], [F.desc("weight"), "aid", "via"], limit)


def fuse_path(candidates: DataFrame, trust: DataFrame, k: int = TOP_K) -> DataFrame:
    """query, aid, hop, score, rank: path weight (at most 1; expansion's times EXPANSION_CAP) and own trust; the best row of each
    answer, then the k best of each query."""
    weight = F.least(F.lit(1.0), F.when(F.col("hop") == "semantic", F.col("weight") * EXPANSION_CAP).otherwise(F.col("weight")))
    scored = candidates.join(trust, "aid", "left").withColumn("score", PATH_WEIGHT * weight + OWN_WEIGHT * F.coalesce("trust", F.lit(0.0)))
    best = first_by(scored, ["query", "aid"], [F.desc("score"), "hop", "via"])
    return ranked(best, k)


def fuse_similarity(candidates: DataFrame, trust: DataFrame, alpha: float, k: int = TOP_K) -> DataFrame:
    """(1 - alpha) * similarity, min-max over the query's pool, + alpha * trust."""
    rows = candidates.join(trust, "aid", "left").withColumn("sim_norm", min_max(F.col("sim"), ["query"], 1.0))
    rows = rows.withColumn("score", (1 - alpha) * F.col("sim_norm") + alpha * F.coalesce("trust", F.lit(0.0)))
    return ranked(first_by(rows, ["query", "aid"], [F.desc("score"), "via"]), k)


def fuse_uniform(candidates: DataFrame, order: list, k: int = TOP_K) -> DataFrame:
    """The ablation without scores: each answer as it was first discovered, the first k of each query. order: of discovery."""
    best = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    best = first_by(best, ["query", "aid"], ["__n"])
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("__n"))).where(F.col("rank") <= k).drop("__n")


def blended_trust(trust: Column, author: Column, beta: float) -> Column:
    """An answer's trust with a part of its author's; an unknown author has none."""
    return (1 - beta) * trust + beta * F.coalesce(author, F.lit(0.0))


def refilled(scored: DataFrame, dropped: Column, k: int = TOP_K) -> DataFrame:
    """The k best of each query (query, aid, sim, score) that aren't dropped; where fewer are left, dropped ones by similarity."""
    rows = scored.withColumn("dropped", dropped)
    place = F.row_number().over(Window.partitionBy("query").orderBy("dropped", F.desc(F.round(F.when(F.col("dropped"), F.col("sim")).otherwise(F.col("score")), 9)), "aid"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def answer_level_anchors(hits: DataFrame, n: int, shallow: int = 10, deep: int = 50) -> DataFrame:
    """query, id, sim: questions by their best answer among a query's first `shallow` answers, or, where those belong to fewer than
    n questions, its first `deep`. hits: query, aid, qid, sim, place (from 1)."""
    def questions(most: int) -> DataFrame:
        best = hits.where(F.col("place") <= most).groupBy("query", F.col("qid").alias("id")).agg(F.max("sim").alias("sim"))
        return best.withColumn("found", F.count("*").over(Window.partitionBy("query")))

    near, far = questions(shallow).where(F.col("found") >= n), questions(deep)
    rows = near.unionByName(far.join(near.select("query").distinct(), "query", "left_anti"))
    return first_by(rows, ["query"], [F.desc(F.round("sim", 9)), "id"], n).drop("found")


# The parts of modes' names.
def mode_name(dup: bool, linked: bool, near: float | None, on: bool = True) -> str:
    """The canonical name of an exclusion mode: off, thread, or dup with what comes on top; linked and near imply dup."""
    if not on:
        return "off"
    if not (dup or linked or near is not None):
        return "thread"
    return "dup" + "+linked" * linked + (f"+neardup{near:g}" if near is not None else "")


def exclusions_of_mode(questions: DataFrame, links: DataFrame, near: DataFrame, answers: DataFrame, dup: bool, linked: bool, threshold: float | None) -> DataFrame:
    """query, mode, question_ids, answer_ids, n_dup, n_linked, n_near: what a question's own thread and its relatives rule out.

    links: a, b, kind (Duplicate or Linked), of either direction. near: query, id, sim. answers: qid, aid."""
    both = links.select(F.col("a").alias("query"), F.col("b").alias("id"), "kind").union(links.select("b", "a", "kind")).where("query <> id")
    rows = both.where(F.lit(dup or linked or threshold is not None) & (F.col("kind") == "Duplicate")).select("query", "id", F.lit("dup").alias("why"))
    rows = rows.union(both.where(F.lit(linked) & (F.col("kind") == "Linked")).select("query", "id", F.lit("linked")))
    if threshold is not None:
        rows = rows.union(near.where((F.col("sim") >= threshold) & (F.col("query") != F.col("id"))).select("query", "id", F.lit("near")))
    asked = questions.select(F.col("qid").alias("query")).distinct()
    every = asked.select("query", F.col("query").alias("id"), F.lit("own").alias("why")).union(rows.join(asked, "query", "left_semi")).distinct()
    n = [F.count_if(F.col("why") == w).alias(f"n_{w}") for w in ("dup", "linked", "near")]
    sets = every.groupBy("query").agg(F.array_sort(F.collect_set("id")).alias("question_ids"), *n)
    of = every.select("query", "id").distinct().join(answers.select(F.col("qid").alias("id"), "aid"), "id").groupBy("query").agg(F.array_sort(F.collect_set("aid")).alias("answer_ids"))
    return sets.join(of, "query", "left").select("query", F.lit(mode_name(dup, linked, threshold)).alias("mode"), "question_ids", F.coalesce("answer_ids", F.array().cast("array<bigint>")).alias("answer_ids"), "n_dup", "n_linked", "n_near")


def leakage_audit(items: DataFrame, excluded: DataFrame, wanted: int) -> DataFrame:
    """One row: queries, shares of those whose items hold an excluded id or fall short of `wanted`, mean of the best similarity.
    items: query, id, sim."""
    bad = items.join(excluded.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    per = bad.groupBy("query").agg(F.count("*").alias("n"), F.max(F.coalesce("hit", F.lit(0))).alias("leaked"), F.max("sim").alias("best"))
    return per.agg(F.count("*").alias("n_queries"), (100 * F.avg("leaked")).alias("leaked_pct"), (100 * F.avg((F.col("n") < wanted).cast("double"))).alias("short_pct"), F.avg("best").alias("mean_best"))


def ranked(best: DataFrame, k: int) -> DataFrame:
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "aid"))).where(F.col("rank") <= k)


def exclusion_sets(edges: dict[str, DataFrame]) -> DataFrame:
    """query, mode, ids from undirected relations by mode; each query is excluded in every mode it occurs in."""
    rows = None
    for mode, e in edges.items():
        both = e.select(F.col("a").alias("query"), F.col("b").alias("id")).union(e.select("b", "a"))
        both = both.union(both.select("query", F.col("query").alias("id"))).withColumn("mode", F.lit(mode))
        rows = both if rows is None else rows.union(both)
    return rows.groupBy("query", "mode").agg(F.array_sort(F.collect_set("id")).alias("ids"))
