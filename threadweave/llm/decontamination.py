"""Benchmark decontamination by a prefix-filtered set join. An item's text is a set of windows of 13 consecutive words (one window
of all words if it has fewer). A document contains a window only if it contains the window's rarest word, so the windows are
indexed by that word alone (the necessary prefix at containment 1), rarity being the number of documents of the corpus
that hold the word. A document word that is a prefix gives a candidate start; starts before the text or windows longer than
what is left are dropped by position and length, and the others are verified word by word.

The item index is sent to the tasks in blocks of bounded size; each block takes one pass over the documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadweave.llm.common import LOWER, RangeHash, gram_hashes, lookup, mix, name_of, numbered, slices, text_bytes, words, written

WINDOW = 13
#: Bytes of item text whose index is sent to the tasks at once.
BLOCK_BYTES = 8 << 20
IS_WORD = lookup(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends and hashes of the words; the index of each text's first word."""
    off, data = text_bytes(column)
    data = LOWER[data]
    start, end, first = words(off, data, IS_WORD)
    return data, start, end, RangeHash(data)(start, end), first


class Index:
    """Windows of some items under their prefix words."""

    def __init__(self, items: list[tuple[str, str]], rarity: dict[int, int], window: int) -> None:
        data, start, end, hashes, first = split(pa.array([t for _, t in items], pa.string()))
        self.windows: list[tuple[bytes, ...]] = []
        self.items: list[set[str]] = []
        seen: dict[tuple[bytes, ...], int] = {}
        postings = defaultdict(list)
        raw = data.tobytes()
        for (item, _), a, b in zip(items, first[:-1], first[1:]):
            m = min(window, b - a)
            for s in range(a, b - m + 1) if m else ():
                text = tuple(raw[start[k] : end[k]] for k in range(s, s + m))
                if text not in seen:
                    seen[text] = len(self.windows)
                    self.windows.append(text)
                    self.items.append(set())
                    o = min(range(m), key=lambda k: (rarity.get(int(hashes[s + k]), 0), text[k], k))
                    postings[int(hashes[s + o])].append((o, m, int(gram_hashes(hashes[s : s + m], m)[0]), seen[text]))
                self.items[seen[text]].add(item)
        self.prefix = np.array(sorted(postings), np.uint64)
        flat = [p for h in self.prefix for p in postings[int(h)]]
        self.begin = np.concatenate(([0], np.cumsum([len(postings[int(h)]) for h in self.prefix]))).astype(np.int64)
        self.offset, self.size, self.nr = (np.array([p[k] for p in flat], np.int64) for k in (0, 1, 3))
        self.hash = np.array([p[2] for p in flat], np.uint64)

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words of the texts; text, first word and window of each verified occurrence."""
        data, start, end, hashes, first = split(column)
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(hashes):
            return first, none, none, none
        k = np.minimum(np.searchsorted(self.prefix, hashes), len(self.prefix) - 1)
        at = np.flatnonzero(self.prefix[k] == hashes)
        k = k[at]
        n = self.begin[k + 1] - self.begin[k]
        posting = np.repeat(self.begin[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        s = at - self.offset[posting]
        doc = np.searchsorted(first, at, side="right") - 1
        fits = (s >= first[doc]) & (s + self.size[posting] <= first[doc + 1])
        s, doc, posting = s[fits], doc[fits], posting[fits]
        same = np.zeros(len(s), bool)
        for m in np.unique(self.size[posting]):
            of = np.flatnonzero(self.size[posting] == m)
            h = np.zeros(len(of), np.uint64)
            for j in range(m):  # as gram_hashes does, at these places only
                h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[s[of] + j]
            same[of] = mix(h + np.uint64(m)) == self.hash[posting[of]]
        s, doc, window = s[same], doc[same], self.nr[posting[same]]
        exact = [all(data[start[a + j] : end[a + j]].tobytes() == w for j, w in enumerate(self.windows[v])) for a, v in zip(s, window)]
        keep = np.array(exact, bool)
        return first, doc[keep], s[keep], window[keep]


STATE = [("__spans", pa.list_(pa.int64())), ("__items", pa.list_(pa.string()))]
RESULT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def matched(index, last: bool, text: str):
    """A pass of one block of items: adds to the spans and items found so far; the last one makes the result of them."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                first, doc, s, window = index.value.hits(part.column(text))
                spans, items = part.column("__spans").to_pylist(), part.column("__items").to_pylist()
                found = defaultdict(set)
                for d, a, v in zip(doc, s, window):
                    a -= first[d]
                    spans[d] += [int(a), int(a + len(index.value.windows[v]))]
                    found[d] |= index.value.items[v]
                for d, more in found.items():
                    items[d] = sorted({*items[d], *more})
                keep = {n: part.column(n) for n in part.schema.names if n not in ("__spans", "__items")}
                if not last:
                    yield pa.RecordBatch.from_pydict(keep | {n: pa.array(c, t) for (n, t), c in zip(STATE, (spans, items))})
                    continue
                rows = []
                for d, n in enumerate(np.diff(first).tolist()):
                    hit = np.zeros(n + 1, np.int64)
                    if spans[d]:
                        np.add.at(hit, spans[d][0::2], 1)
                        np.add.at(hit, spans[d][1::2], -1)
                    n_hit = int((np.cumsum(hit)[:n] > 0).sum()) if spans[d] else 0
                    rows.append((n, n_hit, len(items[d]), hashlib.sha256(",".join(items[d]).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n))
                made = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_pydict(keep | {n: pa.array(c, t) for (n, t), c in zip(RESULT, made)})

    return match


def counted(vocabulary, text: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch, text):
                _, _, _, hashes, first = split(part.column(text))
                if len(known) and len(hashes):
                    k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    at = np.flatnonzero(known[k] == hashes)
                    pairs = np.unique(np.searchsorted(first, at, side="right") * len(known) + k[at])
                    total += np.bincount(pairs % len(known), minlength=len(known))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(known[got].view(np.int64)), "n": pa.array(total[got])})

    return count


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs' columns and n_words, n_hit, n_items, items_sha256, contaminated, a row for each row.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or wordless texts have no words and no hits; items without words
    or without id match nothing; equal items and repeated rows each count. Without items nothing is contaminated, without
    documents the result is empty. Columns of docs that are named like a result are replaced by it; prefix goes before the
    results' names."""
    spark = docs.sparkSession
    base = docs.drop(*[prefix + n for n, _ in RESULT])
    rows, text = numbered(base), name_of(base, text_col)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    fields = rows.schema.fields
    rows = rows.select("*", F.expr("CAST(array() AS array<bigint>)").alias("__spans"), F.expr("CAST(array() AS array<string>)").alias("__items"))
    result = T.StructType(fields + [T.StructField(n, t) for n, t in zip([n for n, _ in RESULT], [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()])])
    for k in range(blocks):
        held = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()]
        vocabulary = spark.sparkContext.broadcast(np.unique(split(pa.array([t for _, t in held], pa.string()))[3]))
        counts = rows.select(text).mapInArrow(counted(vocabulary, text), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
        rarity = {r.word % (1 << 64): r.n for r in counts}
        index = spark.sparkContext.broadcast(Index(held, rarity, window))
        last = k == blocks - 1
        rows = rows.mapInArrow(matched(index, last, text), result if last else rows.schema)
        if not last:
            rows = written(rows, "decontamination")
    return rows.toDF(*base.columns, *[prefix + n for n, _ in RESULT])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' columns. Nulls, empty texts and tables, repeated rows: see
    mark_contamination; ties don't matter, since each row is judged by itself."""
    marked = mark_contamination(docs, benchmark, prefix="__tw_")
    return marked.where(~F.col("__tw_contaminated")).drop(*["__tw_" + n for n, _ in RESULT])
