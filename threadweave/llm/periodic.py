"""Runs: stretches of consecutive words that repeat with a period, found by the branching-tandem test on an enhanced suffix array.

A run of at least m words with at least two periods in it holds ceil(m / 2) words or more that stand one period later again, so only texts
with such an n-gram twice (a hash of each, one sort a slice) have their suffixes sorted; others have no run.

1. The word suffixes of a slice's texts, each closed by a word of its own, are sorted by prefix doubling; only groups that are still tied
   are sorted again. Ranks by 1, 2, 4, ... words are kept; they give common prefixes of neighbours.
2. Each boundary between neighbours splits the widest interval that shares its common prefix of d words. The suffixes i of the smaller
   part look up the ranks of i + d and i - d: one in the other part is a branching tandem, a square of period d that no square follows one word on.
3. Squares are rotated to the left as far as the text goes on with their period (by the kept ranks, whole blocks at a time); each gives
   the run it ends. Of one stretch found with several periods the smallest is its period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import SPACES, joined, slices, spread, strings, text_bytes, text_of, word_hashes, words
from threadweave.llm.repetition import repeated_starts

MIN_LENGTH = 12
#: Suffixes that are looked up at once.
LOOKUPS = 2 << 20
_KEY = (0x3D9E5A70C2F1846B, 0x6C84A1F39B5D027E)


def suffix_ranks(symbols: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(width, rank) for widths 1, 2, 4, ...: ranks of all suffixes by their first `width` symbols, equal ones having one rank, until
    no two are equal. The last symbol, and the last of each text, must occur nowhere else."""
    n = len(symbols)

    def split(at: np.ndarray, key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in order of key, their new ranks, whether others share them; groups start at the ranks given."""
        order = np.argsort(key)
        at, key, group = at[order], key[order], group[order]
        place = np.arange(len(at))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        old = np.concatenate(([True], group[1:] != group[:-1]))
        rank = group + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        tied = ~(fresh & np.append(fresh[1:], True))
        return at, rank, tied

    at, new, tied = split(np.arange(n), symbols, np.zeros(n, np.int64))
    rank = np.empty(n, np.int64)
    rank[at] = new
    width, out, todo = 1, [(1, rank)], at[tied]
    while len(todo):
        at, new, tied = split(todo, rank[todo] * n + rank[todo + width], rank[todo])
        rank = rank.copy()
        rank[at] = new
        width, todo = 2 * width, at[tied]
        out.append((width, rank))
    return out


def common_prefixes(levels: list[tuple[int, np.ndarray]], suffixes: np.ndarray) -> np.ndarray:
    """How many symbols neighbours in suffix order share."""
    a, b = suffixes[:-1], suffixes[1:]
    shared = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels[:-1]):
        i, j = a + shared, b + shared
        shared += width * (rank[i] == rank[j])
    return shared


def reach(depth: np.ndarray, strict: bool) -> np.ndarray:
    """For each place, how many places before it in a row are deeper (strict) or at least as deep. Places of depth 0 have none."""
    n = len(depth)
    levels, width = [depth], 1
    zero = np.flatnonzero(np.concatenate(([True], depth == 0, [True])))
    longest = int(np.diff(zero).max()) if len(zero) > 1 else n
    while 2 * width <= longest:
        last = levels[-1]
        levels.append(np.minimum(last[width:], last[:-width]))  # least depth of 2 * width places from here
        width *= 2
    begin = np.arange(n)
    open_ = np.flatnonzero(depth > 0)
    for low in reversed(levels):
        to = begin[open_] - width
        fits = np.flatnonzero(to >= 0)
        least, own = low[to[fits]], depth[open_[fits]]
        ok = fits[(least > own) if strict else (least >= own)]
        begin[open_[ok]] = to[ok]
        width //= 2
    return np.arange(n) - begin


def branching_tandems(levels: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each square that isn't followed by another of its period one symbol on."""
    rank = levels[-1][1]
    n = len(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    depth = common_prefixes(levels, suffixes)
    before, after = reach(depth, True), reach(depth[::-1], False)[::-1]
    # boundary k: places k - before .. k in suffix order on its left, k + 1 .. k + 1 + after on its right
    k = np.flatnonzero(depth > 0)
    left, right = before[k] + 1, after[k] + 1
    small = np.minimum(left, right)
    begin = np.where(left <= right, k - before[k], k + 1)
    low = np.where(left <= right, k + 1, k - before[k])
    high = low + np.where(left <= right, right, left)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.searchsorted(np.cumsum(small), np.arange(LOOKUPS, small.sum() + LOOKUPS, LOOKUPS)) + 1
    a = 0
    for b in cuts.tolist():
        d = np.repeat(depth[k[a:b]], small[a:b])
        i = suffixes[spread(begin[a:b], small[a:b])]
        lo, hi = np.repeat(low[a:b], small[a:b]), np.repeat(high[a:b], small[a:b])
        for step, first in ((d, i), (-d, i - d)):
            j = i + step
            ok = (j >= 0) & (j < n)
            at = rank[np.where(ok, j, 0)]
            ok &= (at >= lo) & (at < hi)
            starts.append(first[ok])
            periods.append(d[ok])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of each run of at least `least` symbols, by start, then period."""
    if not len(symbols):
        none = np.zeros(0, np.int64)
        return none, none, none
    levels = suffix_ranks(symbols)
    start, period = branching_tandems(levels)
    end = start + 2 * period
    for width, rank in reversed(levels[:-1]):
        to = start - width
        ok = to >= 0
        ok[ok] = rank[to[ok]] == rank[to[ok] + period[ok]]
        start = np.where(ok, to, start)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def collapsed(least: int):
    """Arrow batches of doc_id and text to doc_id, n_words, runs and what is left of the text."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                off, data = text_bytes(part.column("text"))
                start, end, first = words(off, data, ~SPACES)
                count, size = len(off) - 1, np.diff(first)
                text = np.repeat(np.arange(count), size)
                hashes = word_hashes(data, start, end, _KEY)
                head = least - least // 2
                at = np.arange(len(text))
                twice, _ = repeated_starts(hashes, text, head, at[first[1:][text] - at >= head])
                some = np.unique(text[twice])
                # the words of these texts, each text closed by a symbol of its own
                room = size[some] + 1
                begin = np.cumsum(room) - room
                own = spread(begin, size[some])
                symbols = np.empty(int(room.sum()), np.int64)
                values, symbols[own] = np.unique(hashes[spread(first[some], size[some])], return_inverse=True)
                symbols[begin + room - 1] = len(values) + np.arange(len(some))
                a, b, period = runs_of(symbols, least)
                of = np.searchsorted(begin, a, side="right") - 1
                # the words after each run's first period go
                shift = first[some] - begin
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, (a + period) + shift[of], 1)
                np.add.at(edge, b + shift[of], -1)
                kept = np.cumsum(edge[:-1]) == 0
                out, place = joined(data, start[kept], end[kept])
                upto = np.concatenate(([0], np.cumsum(kept)))[first]
                left = strings(out, place[upto[:-1]], np.maximum(place[upto[1:]] - 1, place[upto[:-1]]))
                per = np.bincount(some[of], minlength=count)
                found = pa.StructArray.from_arrays([pa.array(x) for x in (a - begin[of], b - a, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), found)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(size), "runs": lists, "collapsed": left})

    return collapse


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (the words that are in no run after its
    first period, joined by one space): a row for each row of docs.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, as long as
    `least` and 2 * q at least, that can't be extended keeping q. A null or empty text has no words, no runs and collapses to an empty text. Rows
    stand for themselves, repeated ids or not; other columns are ignored. Nothing is shuffled. Words are told apart by keyed 64-bit
    hashes. A single text's suffixes are sorted in one task: about 16 bytes a word and level of doubling, 100 bytes a byte or so in all."""
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(collapsed(least), f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
