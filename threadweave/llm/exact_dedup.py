"""Exact deduplication by a live index of digests: cuckoo filters, one a shard, in front of bucketed keys.

Rows carry the SHA-256 of their normalised text. The table goes through the index as BATCHES batches of changes; inside a
batch, rows of one digest are counted first (with map-side combining, so a text that a third of the rows hold costs each task
one row). The digests are dealt to shards by their leading bits. A shard's filter answers at once that a digest is new; a hit
is looked up among the stored keys of the filter's bucket, and then the copies found are verified against content: the texts of
all digests that were met more than once are bucketed by digest and compared. Texts that differ under one digest are taken
apart again.

When an insertion finds no room the filter is rebuilt at twice the size from the stored keys. Digests can be deleted, which takes
rows away from the live count and, when none is left, the fingerprint from the filter; when the row that stays is deleted,
the smallest of the rows still live is promoted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import small, text_of, written

#: Distinct digests that one shard is meant to hold; batches of changes that a table is taken in as.
SHARD_KEYS, BATCHES = 50_000, 4
SLOTS, MOVES = 4, 200

INDEX = "shard int, n_shards int, n_buckets int, filter binary, digests array<string>, keep_ids array<bigint>, keep_rows array<bigint>, sizes array<bigint>"
DECISIONS = "digest string, keep_id bigint, keep_row bigint, group_size bigint, hits bigint"
#: The keep_row of a key whose row was deleted while copies are live, until one of them is promoted.
ORPHAN = -1


class CuckooFilter:
    """Partial-key cuckoo hashing with 16-bit fingerprints, four slots a bucket; 0 marks a free slot. stored: the keys behind
    each fingerprint, by bucket pair and fingerprint, against which hits are verified."""

    def __init__(self, n_buckets: int = 16) -> None:
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16)
        self.stored: dict[tuple[int, int], list[str]] = {}
        self.turn = 0

    def _place(self, digest: str) -> tuple[int, int, int]:
        value = int((digest * 32)[8:32], 16)
        print_ = (value & 0xFFFF) or 1
        one = (value >> 16) % self.n
        return print_, one, one ^ ((print_ * 0x5BD1E995) % self.n)

    def _key(self, print_: int, one: int, two: int) -> tuple[int, int]:
        return print_, min(one, two)

    def may_contain(self, digest: str) -> bool:
        p, one, two = self._place(digest)
        return bool((self.table[one] == p).any() or (self.table[two] == p).any())

    def contains(self, digest: str) -> bool:
        """A hit of the filter, verified against the keys stored for that bucket."""
        return self.may_contain(digest) and digest in self.stored.get(self._key(*self._place(digest)), ())

    def insert(self, digest: str) -> None:
        if not self._settle(digest):
            self._resize([*self.keys(), digest])

    def _settle(self, digest: str) -> bool:
        p, one, two = self._place(digest)
        # more equal fingerprints than a bucket pair has slots would be moved for ever
        if len(self.stored.get(self._key(p, one, two), ())) >= 2 * SLOTS - 1:
            return False
        before = self.table.copy() if self.n <= 64 else None
        undo, at, moved = [], one, p
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = p
                self.stored.setdefault(self._key(p, one, two), []).append(digest)
                return True
        for _ in range(MOVES):
            self.turn = (self.turn + 1) % SLOTS
            undo.append((at, self.turn, self.table[at, self.turn]))
            moved, self.table[at, self.turn] = int(self.table[at, self.turn]), moved
            at ^= (moved * 0x5BD1E995) % self.n
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = moved
                self.stored.setdefault(self._key(p, one, two), []).append(digest)
                return True
        if before is not None:
            self.table = before
        else:
            for b, s, v in reversed(undo):
                self.table[b, s] = v
        return False

    def delete(self, digest: str) -> bool:
        if not self.contains(digest):
            return False
        p, one, two = self._place(digest)
        b = one if (self.table[one] == p).any() else two
        self.table[b, np.flatnonzero(self.table[b] == p)[0]] = 0
        kept = self.stored[self._key(p, one, two)]
        kept.remove(digest)
        if not kept:
            del self.stored[self._key(p, one, two)]
        return True

    def keys(self) -> list[str]:
        return [d for ds in self.stored.values() for d in ds]

    def _resize(self, keys: list[str]) -> None:
        n = self.n
        while True:
            n *= 2
            other = CuckooFilter(n)
            if all(other._settle(d) for d in keys):
                self.n, self.table, self.stored = other.n, other.table, other.stored
                return

    @classmethod
    def of(cls, digests: list[str]) -> CuckooFilter:
        n = 16
        while n * SLOTS * 0.8 < len(digests):
            n *= 2
        out = cls(n)
        for d in digests:
            out.insert(d)
        return out


def normalised(col: str = "text") -> Column:
    """Each run of white space as one space; a null text is empty."""
    return F.regexp_replace(text_of(col), r"[\x20\x09-\x0D]+", " ")


def _changed(index: pa.Table, changes: pa.Table) -> tuple[CuckooFilter, dict, dict]:
    """Applies one shard's changes to its keys, batch after batch: n > 0 inserts rows, n < 0 deletes them, n = 0 promotes one.
    The filter, the keys (digest: smallest id, its row, live rows), and of each digest changed how often it was a hit."""
    keys: dict[str, list] = {}
    for r in index.to_pylist():
        keys.update({d: [k, w, s] for d, k, w, s in zip(r["digests"], r["keep_ids"], r["keep_rows"], r["sizes"])})
    live = CuckooFilter.of(list(keys))
    hits: dict[str, int] = {}
    changes = changes.sort_by([("batch", "ascending"), ("digest", "ascending")])
    for d, doc, row, n in zip(*(changes.column(c).to_pylist() for c in ("digest", "doc", "row", "n"))):
        hit = live.contains(d)
        hits[d] = hits.get(d, 0) + hit
        if not hit:
            if n > 0:
                live.insert(d)
                keys[d] = [doc, row, n]
            continue
        known = keys[d]
        known[2] += n
        if known[2] <= 0:
            live.delete(d)
            del keys[d]
        elif n < 0:
            if (doc, row) == (known[0], known[1]):
                known[:2] = None, ORPHAN
        elif known[1] == ORPHAN or (doc is None, doc or 0, row) < (known[0] is None, known[0] or 0, known[1]):
            known[:2] = doc, row
    return live, keys, hits


def _decide(index: pa.Table, changes: pa.Table) -> pa.Table:
    _, keys, hits = _changed(index, changes)
    columns = list(zip(*[(d, *keys[d], n) for d, n in hits.items() if d in keys])) or [()] * 5
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(DECISIONS.split(", "), columns, types)})


def _update(n_shards: int):
    def update(index: pa.Table, changes: pa.Table) -> pa.Table:
        live, keys, _ = _changed(index, changes)
        shard = (index if len(index) else changes).column("shard")[0].as_py()
        lists = [list(keys), *([v[i] for v in keys.values()] for i in range(3))]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3]
        row = (shard, n_shards, live.n, live.table.tobytes(), *lists)
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(INDEX.split(", "), row, types)})

    return update


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 64) -> DataFrame:
    """doc, row (a number for each row, which tells repeated ids apart), text_sha256, digest (its first `chars` hex digits, the
    index's key) and batch of every row."""
    sha = F.sha2(normalised(text_col), 256)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.monotonically_increasing_id().alias("row"), sha.alias("text_sha256"), F.substring(sha, 1, chars).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(BATCHES)).alias("batch")
    )


def changes_of(rows: DataFrame, n_shards: int, sign: int = 1) -> DataFrame:
    """A batch's rows of one digest as one change: shard, digest, batch, doc and row of the smallest id (null last), n rows."""
    first = F.min(F.struct(F.col("doc").isNull().alias("z"), "doc", "row"))
    shard = (F.xxhash64("digest") % n_shards + n_shards) % n_shards
    return rows.groupBy("digest", "batch").agg(first.alias("first"), (F.count("*") * sign).alias("n")).select(shard.cast("int").alias("shard"), "digest", "batch", F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), "n")


def shards_of(index: DataFrame) -> int | None:
    """The number of shards that an index was made with."""
    return index.agg(F.max("n_shards").alias("n")).first().n


def update_index(changes: DataFrame, n_shards: int, index: DataFrame | None = None) -> DataFrame:
    """The index after these changes (of changes_of, for so many shards), one row a shard."""
    if index is not None and shards_of(index) not in (None, n_shards):
        raise ValueError("the index has another number of shards")
    index = changes.sparkSession.createDataFrame([], INDEX) if index is None else index
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update(n_shards), INDEX)


def delete_rows(index: DataFrame, gone: DataFrame, live: DataFrame) -> DataFrame:
    """The index without the rows `gone`; both tables have the columns of digests. live: the rows that stay, from which keys whose
    row was deleted get the smallest."""
    n = shards_of(index)
    left = written(update_index(changes_of(gone, n, sign=-1), n, index), "index")
    orphans = left.select(F.explode(F.arrays_zip("digests", "keep_rows")).alias("k")).where(F.col("k.keep_rows") == ORPHAN).select(F.col("k.digests").alias("digest"))
    return update_index(changes_of(live.join(orphans, "digest", "left_semi"), n).withColumn("n", F.lit(0).cast("bigint")), n, left)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None, stored: DataFrame | None = None, n_shards: int | None = None, chars: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after white-space runs become one space. Of equal texts the row with the smallest id stays;
    of rows that also share the id, one. A null text counts as empty; a row with a null id yields to any other row, and groups
    with null ids only keep one row and have a null keep_id. An empty table gives an empty result. Other columns are ignored.
    index: keys from earlier tables; texts known there count as earlier copies. stored: digest and text (normalised) of their
    kept rows, against which hits on them are verified; without it their digests are trusted. chars: hex digits of the digest
    that the index holds; texts that share it and differ are told apart by content, but not from an index's."""
    rows = written(digests(docs, id_col, text_col, chars), "digests")
    if index is None:
        index = docs.sparkSession.createDataFrame([], INDEX)
    made = shards_of(index)
    if made and n_shards not in (None, made):
        raise ValueError("the index has another number of shards")
    n_shards = made or n_shards or max(1, -(-rows.count() // SHARD_KEYS))
    told = index.groupBy("shard").cogroup(changes_of(rows, n_shards).groupBy("shard")).applyInArrow(_decide, DECISIONS)
    told = written(told, "decisions")
    out = rows.join(told, "digest").select(F.col("doc").alias("doc_id"), "keep_id", "group_size", (F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "row", "digest")

    # content, bucketed by digest, of all digests that were met more than once
    text = normalised(text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.substring(F.sha2(text, 256), 1, chars).alias("digest"), text.alias("text"))
    copied = told.where("group_size > 1").select("digest")
    content = texts.join(small(copied), "digest").select("digest", "text")
    if stored is not None:
        content = content.union(stored.select("digest", "text").join(small(copied), "digest", "left_semi").select("digest", "text"))
    clash = written(content.groupBy("digest", "text").count().groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    if not clash.isEmpty():
        out = out.join(small(clash), "digest", "left_anti").unionByName(_by_content(texts.join(small(clash), "digest")))
    return out.drop("digest")


def _by_content(rows: DataFrame) -> DataFrame:
    """The result for texts that differ under one digest, from the texts themselves."""
    own = rows.withColumn("row", F.monotonically_increasing_id())
    own = written(own, "apart")
    best = own.groupBy(F.col("text").alias("same")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
    joined = own.join(best, own["text"] == best["same"])
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.sha2("text", 256).alias("text_sha256"), "row", "digest")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names; nulls, ties, repeated rows and empty tables as in
    exact_dedup."""
    out = docs.columns
    rows = docs.select("*", F.sha2(normalised(text_col), 256).alias("__tw_sha"))
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__tw_keep"), F.col("text_sha256").alias("__tw_sha"))
    found = rows.join(stay, (rows["__tw_sha"] == stay["__tw_sha"]) & rows[id_col].cast("bigint").eqNullSafe(stay["__tw_keep"]), "left_semi")
    # rows that share id and text: one of them
    twice = found.groupBy("__tw_sha", id_col).agg(F.count("*").alias("__tw_n")).where("__tw_n > 1").limit(1).count()
    return (found.dropDuplicates(["__tw_sha", id_col]) if twice else found).select(*out)
