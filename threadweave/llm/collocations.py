"""Phrases whose words occur together far more often than apart, per language.

Counting every n-gram of a large corpus means keeping every n-gram that occurs once. Here two passes are made instead:

1. Each task counts the hashes of its n-grams and deals the counts out to hash partitions. A partition merges them into one Misra-Gries
   summary. The tasks say first how much mass they send it, so the summary's capacity is above mass / threshold, and what it takes
   off its counts in all stays below the threshold: every n-gram with `threshold` occurrences survives. Survivors become a bit map of a fixed
   size, of which each partition fills its own part.
2. n-grams whose bit is set are counted by their words, exactly. Those that come through the bit map by chance fall to their counts.

Everything after that is joins and aggregations of frequent phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.llm.common import LOWER, gram_hashes, joined, lookup, mix, slices, spread, strings, text_bytes, text_of, tidy, word_hashes, words, written

LEAST, LONGEST, INSIDE_PERCENT, FIRST = 10, 3, 50, 2000
#: Text bytes for each hash partition, partitions at most, and bits of the bit map (32 MB), the one thing that passes through the driver.
PARTITION_BYTES, MOST_PARTITIONS, BITS = 16 << 20, 1 << 16, 1 << 28
#: Occurrences of n-grams that a task sorts and counts at once.
GATHERED = 8_000_000
#: Counts that a partition gathers before it merges them, rows of the second pass that a task gathers.
BUFFERED, ROWS = 1_000_000, 1_000_000

PIECE_ENDS = lookup(b".,;:!?\n\v\f\r")
WORD = ~(PIECE_ENDS | lookup(b" \t"))
_KEY = (0x59C2E07B8D4A361F, 0x26F1B48E9A7D03C5)


class Words:
    """The words of a slice of texts, lower-cased, and the n-grams inside their pieces."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        off, data = text_bytes(texts)
        self.data = LOWER[data]
        self.start, self.end, first = words(off, self.data, WORD)
        self.langs, code = np.unique(np.array(langs.to_pylist(), object), return_inverse=True) if len(langs) else (np.zeros(0, object), np.zeros(0, np.int64))
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        self.lang = code[text]
        self.hashes = word_hashes(self.data, self.start, self.end, _KEY)
        ends = np.concatenate(([0], np.cumsum(PIECE_ENDS[self.data])))[self.start]
        self.linked = (text[1:] == text[:-1]) & (ends[1:] == ends[:-1])
        self.salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.salt = self.salts[self.lang] if len(self.salts) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes, which depend on words and language, of all n-grams that stay within a piece."""
        whole = np.ones(max(0, len(self.start) - n + 1), bool)
        for k in range(n - 1):
            whole &= self.linked[k : k + len(whole)]
        at = np.flatnonzero(whole)
        return at, mix(gram_hashes(self.hashes, n)[at] + self.salt[at])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return key[head], np.add.reduceat(count, head) if len(head) else count


def partition_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as compressed gaps, byte by byte."""
    gaps = np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(keys).to_bytes(8, "little") + pa.compress(gaps.T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    gaps = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(gaps.T).view("<u4")[:, 0], dtype=np.uint32)


def counted(longest: int, parts: int):
    """Arrow batches of lang and text to rows (part, seq, mass, once, several, counts): for each hash partition its mass (seq 0) and, after
    it, the low halves of hashes that occurred once and of the others with their counts (seq 1)."""

    def given(key: np.ndarray) -> pa.RecordBatch:
        key.sort()
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(head, len(key)))
        key = key[head]
        first = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)
        edge = np.append(np.searchsorted(key, first), len(key))
        low = key.astype(np.uint32)
        rows = []
        for p in np.flatnonzero(np.diff(edge)).tolist():
            k, c = low[edge[p] : edge[p + 1]], count[edge[p] : edge[p + 1]]
            one = c == 1
            rows += [(p, 0, int(c.sum()), b"", b"", b""), (p, 1, 0, packed(k[one]), packed(k[~one]), c[~one].tobytes())]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("part", "seq", "mass", "once", "several", "counts"), zip(*rows), types)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(GATHERED, np.uint64), 0
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column("text"), part.column("lang"))
                for size in range(1, longest + 1):
                    keys = found.grams(size)[1]
                    while len(keys):
                        room = min(len(keys), len(held) - n)
                        held[n : n + room] = keys[:room]
                        keys, n = keys[room:], n + room
                        if n == len(held):
                            yield given(held)
                            n = 0
        if n:
            yield given(held[:n])
        tidy()

    return count


class Summary:
    """A Misra-Gries summary, mergeable: its counts are too low by `lost` at most, which is less than mass / capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(BUFFERED, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        """Takes in what waits. If there are too many counters, the (capacity + 1)-th largest count is taken off all of them:
        capacity + 1 of them lose that much each, so that nothing is lost more often than the mass allows."""
        self.keys, self.counts = summed([self.keys, *[k for k, _ in self.more]], [self.counts, *[c for _, c in self.more]])
        self.more, self.waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            off = np.partition(self.counts, over - 1)[over - 1]
            stay = self.counts > off
            self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay] - off, self.lost + int(off)

    def survivors(self, threshold: int) -> np.ndarray:
        """All keys with `threshold` occurrences or more are among these."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def surviving(threshold: int, segment: int):
    """Rows of `counted`, sorted by part and seq, to (part, bits): the part's segment of the bit map."""

    def bits(summary: Summary) -> bytes:
        flags = np.zeros(segment, bool)
        flags[summary.survivors(threshold).astype(np.uint64) * np.uint64(segment) >> np.uint64(32)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None
        row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "bits": pa.array([bits(summary or Summary(1))], pa.binary())})
        for batch in batches:
            for p, seq, m, once, several, counts in zip(*(batch.column(k) for k in ("part", "seq", "mass", "once", "several", "counts"))):
                if p.as_py() != now:
                    if now is not None:
                        yield row()
                    now, mass, summary = p.as_py(), 0, None
                if seq.as_py() == 0:
                    mass += m.as_py()
                    continue
                summary = summary or Summary(mass // threshold + 1)
                ones = unpacked(once.as_py())
                summary.add(ones, np.ones(len(ones), np.int64))
                summary.add(unpacked(several.as_py()), np.frombuffer(counts.as_buffer(), np.int64))
        if now is not None:
            yield row()
        tidy()

    return survive


def phrase_table(lang, size, phrase, count) -> pa.Table:
    return pa.table({"lang": lang, "size": size, "phrase": phrase, "count": count})


def hit_phrases(longest: int, parts: int, segment: int, shared):
    """Arrow batches of lang and text to (part, rows): n-grams whose bit is set with their counts, and each language's number of words
    (size 0), as compressed Arrow tables for each hash partition."""

    def merged(rows: list[tuple]) -> tuple:
        key, first, count = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
        lang, phrase = (pa.concat_arrays([r[k] for r in rows]) for k in (3, 4))
        key, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        take = pa.array(at)
        return key, first[at], np.bincount(inverse, count, len(key)).astype(np.int64), lang.take(take), phrase.take(take)

    def given(rows: tuple) -> pa.RecordBatch:
        key, size, count, lang, phrase = rows
        edge = np.searchsorted(partition_of(key, parts), np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edge))
        table = phrase_table(lang, pa.array(size.astype(np.int32)), phrase, pa.array(count))
        bodies = []
        for p in full.tolist():
            part = table.slice(edge[p], edge[p + 1] - edge[p]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part.sort_by("phrase"))
            bodies.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_pydict({"part": pa.array(full.astype(np.int32)), "rows": pa.array(bodies, pa.binary())})

    def rows_of(found: Words, bitmap: np.ndarray) -> Iterator[tuple]:
        norm, at = joined(found.data, found.start, found.end)
        langs = pa.array(found.langs.tolist(), pa.string())
        for n in range(1, longest + 1):
            i, key = found.grams(n)
            place = partition_of(key, parts) * segment + ((key & np.uint64(0xFFFFFFFF)) * np.uint64(segment) >> np.uint64(32)).astype(np.int64)
            hit = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            key, where, count = np.unique(key[hit], return_index=True, return_counts=True)
            i = i[hit][where]
            yield key, np.full(len(key), n), count, langs.take(pa.array(found.lang[i])), strings(norm, at[i], at[i + n] - 1)
        totals = np.bincount(found.lang, minlength=len(langs))
        yield found.salts, np.zeros(len(langs), np.int64), totals, langs, pa.array([""] * len(langs), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held = np.frombuffer(shared.value, np.uint8), []
        for batch in batches:
            for part in slices(batch):
                held += rows_of(Words(part.column("text"), part.column("lang")), bitmap)
                if sum(len(r[0]) for r in held) > ROWS:
                    held = [merged(held)]
                    if 2 * len(held[0][0]) > ROWS:
                        yield given(held[0])
                        held = []
        if held:
            yield given(merged(held))
        tidy()

    return count


def exactly(least: int):
    """Rows of `hit_phrases`, sorted by part, to (lang, size, phrase, count) of phrases that occur `least` times, and languages' words."""

    def summed_up(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["lang", "size", "phrase"]).aggregate([("count", "sum")])
        return phrase_table(*(whole.column(c) for c in ("lang", "size", "phrase", "count_sum")))

    def given(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = summed_up(tables)
        enough = pc.or_(pc.greater_equal(whole.column("count"), least), pc.and_(pc.equal(whole.column("size"), 0), pc.greater(whole.column("count"), 0)))
        yield from whole.filter(enough).combine_chunks().to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []
        for batch in batches:
            for p, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
                if p != now and tables:
                    yield from given(tables)
                    tables = []
                now = p
                tables.append(pa.ipc.open_stream(rows.as_buffer()).read_all())
                if sum(map(len, tables[1:])) > max(ROWS, len(tables[0])):
                    tables = [summed_up(tables)]
        if tables:
            yield from given(tables)
        tidy()

    return count


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, size, phrase, count of every phrase of 1 to `longest` words that occurs `least` times or more in its language; size 0 and an
    empty phrase: the language's words, however few. The result is a table in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(MOST_PARTITIONS, max(8, -(-size // PARTITION_BYTES)))
    segment = max(8, bits // parts // 8 * 8)
    sent = texts.mapInArrow(counted(longest, parts), "part int, seq int, mass bigint, once binary, several binary, counts binary")
    kept = sent.repartition(parts, "part").sortWithinPartitions("part", "seq").mapInArrow(surviving(least, segment), "part int, bits binary")
    bitmap = bytearray(parts * segment // 8)
    held = kept.toArrow()
    for part, flags in zip(held.column("part").to_pylist(), held.column("bits")):
        bitmap[part * segment // 8 : (part + 1) * segment // 8] = flags.as_py()
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    rows = texts.mapInArrow(hit_phrases(longest, parts, segment, shared), "part int, rows binary")
    counts = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(exactly(least), "lang string, size int, phrase string, count bigint")
    return written(counts, "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE_PERCENT, first: int = FIRST, bits: int = BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` phrases of 2 to `longest` words by score, then a, then phrase.

    Texts are lower-cased (A-Z), split into pieces at .,;:!? and line ends, pieces into words at spaces and tabs. a: occurrences of the phrase,
    overlaps included; it takes part from `least` on. A phrase cut in two has score floor(1000000 * a * a / (l * r)), l and r being the
    occurrences of its parts; its lowest-scoring cut counts, of equals the first. A phrase that lies within a longer one of at least `inside`
    percent of its occurrences is left out. n: words of the language. A null language is `und`, a null text is empty; repeated rows and
    ids count each time; other columns are ignored; without phrases there are no rows. Scores are exact for counts of up to 15 digits; within a
    slice of 2 MB phrases are told apart by keyed 64-bit hashes, beyond it by their words."""
    counts = frequent_phrases(docs, least, longest, bits, lang_col, text_col)
    phrases = counts.where("size > 0").select("lang", "phrase", "count")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("count").alias("a"))
    w = F.split("phrase", " ")
    within = lambda k: lambda i: F.array_join(F.slice(w, i, k), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(w, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("count").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    # at most 38 digits: counts of up to 15 digits
    exact = lambda c: f"CAST({c} AS decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000BD * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), within(k)))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", place).where(F.col("rank") <= first)
    totals = counts.where("size = 0").select("lang", F.col("count").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
