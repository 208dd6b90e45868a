"""Shared substrings between two tables of texts: every run of n characters of one that occurs in the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct shingles of the smaller side that are sent to every task (8 bytes each); with more, both sides are shuffled by hash.
SENT = 1_000_000
#: Characters of the hashes that tell which pairs of texts may share a longer run.
GRAM = 24


def window_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < n:
        return np.zeros(0, np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    points ^= points >> np.uint64(29)
    points *= np.uint64(0xBF58476D1CE4E5B9)
    points ^= points >> np.uint64(32)
    # windows of doubling width, then the rest of n
    base, out, width = np.array([0xD6E8FEB86659FD93], np.uint64), np.zeros(len(points) - n + 1, np.uint64), 1
    power, have, done, level = base, points, 0, n
    while level:
        if level & 1:
            out = out * power + have[done : done + len(out)]
            done += width
        level >>= 1
        if level:
            have = have[:-width] * power + have[width:]
            power, width = np.multiply(power, power, dtype=np.uint64), 2 * width
    return out


def hashed_windows(df: DataFrame, key: str, text: str, n: int, only: np.ndarray | None = None) -> DataFrame:
    """key, h, w: distinct window hashes of each text; if `only` (ascending) is given, of those in it, with the windows themselves."""
    sent = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], [], []
            for k, t in enumerate(batch.column("t").to_pylist()):
                h = window_hashes(t or "", n)
                if sent is None:
                    h = np.unique(h)
                    held += [None] * len(h)
                else:
                    known = sent.value
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.zeros(0, int)
                    found = {(int(h[i]), t[i : i + n]) for i in at.tolist()}
                    h = np.array([x for x, _ in found], np.uint64)
                    held += [w for _, w in found]
                ids.append(np.full(len(h), k))
                out.append(h)
            at, h = np.concatenate(ids) if ids else np.zeros(0, int), np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({key: batch.column(key).take(pa.array(at, pa.int64())), "h": pa.array(h.view(np.int64)), "w": pa.array(held, pa.string())})

    rows = df.select(key, F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(windows, f"{key} {dict(df.dtypes)[key]}, h bigint, w string")


def shared_substrings(texts: DataFrame, key: str, items: DataFrame, item_key: str, n: int = 50, text: str = "text", sent: int = SENT) -> DataFrame:
    """Distinct (key, item_key) of texts that share n consecutive characters. Null and shorter texts share nothing.

    Hashes find the windows in question; those that match are compared as text. Where the items have more than `sent` distinct
    hashes, both sides meet in a join by hash, and the pairs that do are compared text by text."""
    hashed = hashed_windows(items, item_key, text, n)
    distinct = hashed.select("h").distinct()
    if distinct.limit(sent + 1).count() > sent:
        met = hashed_windows(texts, key, text, n).select(key, "h").join(hashed.select(item_key, "h"), "h").select(key, item_key).distinct()
        both = met.join(texts.select(key, F.col(text).cast("string").alias("__a")), key).join(items.select(item_key, F.col(text).cast("string").alias("__b")), item_key)
        return pairs_share(both, "__a", "__b", n).where("shares").select(key, item_key).distinct()
    only = np.sort(distinct.toArrow().column("h").to_numpy().view(np.uint64))
    return hashed_windows(texts, key, text, n, only).join(hashed_windows(items, item_key, text, n, only), ["h", "w"]).select(key, item_key).distinct()


def pairs_share(pairs: DataFrame, a: str, b: str, n: int = 50) -> DataFrame:
    """pairs with shares: whether the texts a and b of a row have n consecutive characters in common. Null and shorter texts have none."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                x, y = x or "", y or ""
                left, right = window_hashes(x, n), window_hashes(y, n)
                met = np.flatnonzero(np.isin(left, right))
                flags.append(any(x[k : k + n] in y for k in met.tolist()))
            yield batch.append_column("shares", pa.array(flags, pa.bool_()))

    return pairs.mapInArrow(compare, kinds + ", shares boolean")


def least_hashes(text: str, n: int) -> np.ndarray:
    """The least of each n - GRAM + 1 hashes in a row of GRAM characters, 32 bits of it: about one in w / 2 of the text's places. Texts with n
    consecutive characters in common have one of these in common."""
    k = min(GRAM, n)
    least, wide, w = window_hashes(text, k) >> np.uint64(32), 1, n - k + 1
    if len(least) < w:
        return np.zeros(0, np.uint32)
    while 2 * wide <= w:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < w:
        least = np.minimum(least[: len(least) - w + wide], least[w - wide :])
    return np.unique(least).astype(np.uint32)


def sharing_pairs(pairs: DataFrame, texts: DataFrame, key: str, text: str = "text", n: int = 50) -> DataFrame:
    """Those of the distinct pairs (query, id) whose texts (key, text) have n consecutive characters in common. Texts travel only for pairs that
    have a least hash in common."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [least_hashes(t or "", n).view(np.int32) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, pa.list_(pa.int32()))], names=["k", "f"])

    asked = pairs.select("query", "id").distinct()
    all_texts = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    hashes = all_texts.mapInArrow(work, f"k {dict(all_texts.dtypes)['k']}, f array<int>").where(F.size("f") > 0)
    side = lambda rows, name, column, new: rows.select(F.col("k").alias(name), F.col(column).alias(new))
    likely = asked.join(side(hashes, "id", "f", "__f"), "id").join(side(hashes, "query", "f", "__g"), "query").where(F.arrays_overlap("__f", "__g")).select("query", "id")
    both = likely.join(side(all_texts, "id", "t", "__a"), "id").join(side(all_texts, "query", "t", "__b"), "query")
    return pairs_share(both, "__a", "__b", n).where("shares").select("query", "id")


def audit(runs: DataFrame, items: DataFrame, excluded: DataFrame, accepted: DataFrame | None, expansions: DataFrame, modes: list[str], wanted: int, n: int = 50, cosine: float = 0.95, shared: DataFrame | None = None) -> DataFrame:
    """A row a condition: what its retrieval gave away, and what it cost.

    runs: condition, query, latency. items: condition, query, id, text, sim (to the accepted answer). excluded: mode, query, id. accepted:
    query, text. expansions: condition, query, slot, n_answers (in the graph), n_left (after exclusion). Columns: n; self_<mode>
    and its pct, queries with an item that the mode excludes; substring, cosine, any_leak and their pcts, queries with an item that shares n
    characters with the accepted answer, or is as similar as `cosine`; mean_best_sim (0 without items); n_short and n_empty (fewer
    items than wanted, none); latency_mean, latency_p95; n_slots, n_slots_empty, n_slots_excluded (empty though there are answers). Where
    the pairs (query, id) that share are known already (shared), neither items nor accepted ones need their texts."""
    from threadweave.operators.tables import percentiles_of, share

    key = ["condition", "query"]
    if shared is None:
        pairs = items.join(accepted.select("query", F.col("text").alias("__accepted")), "query", "left")
        pairs = pairs_share(pairs.select(*key, "id", "sim", "text", "__accepted"), "text", "__accepted", n)
    else:
        pairs = items.join(shared.select("query", "id").distinct().withColumn("shares", F.lit(True)), ["query", "id"], "left").withColumn("shares", F.col("shares").isNotNull())
    seen = pairs.groupBy(*key).agg(
        F.count("*").alias("k"), F.bool_or("shares").alias("substring"), F.coalesce(F.bool_or(F.col("sim") >= cosine), F.lit(False)).alias("cosine"), F.max("sim").alias("best")
    )
    hits = items.select(*key, "id").join(excluded.select("mode", "query", "id").distinct(), ["query", "id"]).groupBy(*key).agg(F.collect_set("mode").alias("hit"))
    rows = runs.join(seen, key, "left").join(hits, key, "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    flags = {f"self_{m}": flag(F.array_contains("hit", m)) for m in modes} | {"substring": flag(F.col("substring")), "cosine": flag(F.col("cosine")), "any_leak": flag(F.col("substring")) | flag(F.col("cosine"))}
    size = F.coalesce("k", F.lit(0))
    counts = [x for name, c in flags.items() for x in (F.count_if(c).alias(name), (100 * F.avg(c.cast("double"))).alias(f"{name}_pct"))]
    out = rows.groupBy("condition").agg(F.count("*").alias("n"), *counts, F.avg(F.coalesce("best", F.lit(0.0))).alias("mean_best_sim"), F.count_if(size < wanted).alias("n_short"), F.count_if(size == 0).alias("n_empty"), F.avg(F.coalesce("latency", F.lit(0.0))).alias("latency_mean"))
    late = percentiles_of(runs.withColumn("latency", F.coalesce("latency", F.lit(0.0))), ["condition"], "latency", {"latency_p95": share(0.95)}).drop("n")
    slots = expansions.groupBy("condition").agg(F.count("*").alias("n_slots"), F.count_if(F.col("n_left") == 0).alias("n_slots_empty"), F.count_if((F.col("n_left") == 0) & (F.col("n_answers") > 0)).alias("n_slots_excluded"))
    out = out.join(late, "condition").join(slots, "condition", "left")
    return out.fillna(0, ["n_slots", "n_slots_empty", "n_slots_excluded"])
