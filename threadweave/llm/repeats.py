"""Removal of repeated byte strings by longest previous factors: each byte covered by a string of `length` bytes that also
starts earlier (smaller document id, or same document and earlier start) goes, the first occurrence stays.

1. Every window of `length` bytes has an anchor, the gram of least hash inside it, which depends on the window's bytes alone. Windows
   with one anchor are consecutive and together make a context. Contexts that are equal as a whole (same anchor, same 64-bit BLAKE2
   digest) are copies: all but the first are repeats, so that copies of long passages aren't sorted again and again. A task
   settles its own before anything is shuffled.
2. An anchor with one distinct context has no further repeats. Distinct contexts that share an anchor are cut out of the texts
   and dealt out by anchor, so equal windows meet. There their suffixes are sorted by their first `length` bytes (prefix
   doubling), with the common prefixes of neighbours; the previous and the next smaller position in suffix order give each window's
   longest previous factor, and windows whose factor is `length` or more are repeats.
3. An anchor with more than HOT distinct contexts (the edges of a passage in very many documents) is not sorted in one place: its
   windows are compared by 128-bit digests, with the first occurrence found by an aggregation that combines on the map side."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import mix, runs, slices, small, spread, text_bytes, text_of, written

LENGTH, GRAM = 100, 24
HOT, SORT_BYTES = 5_000, 1 << 20
#: Blocks of documents for each input partition; a block's texts meet in one task.
BLOCKS = 3

ROW = {"h": np.int64, "c": np.int64, "doc": np.int64, "p": np.int64, "n": np.int32}


def anchors(off: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each context: the text it is in, its first window's start, the windows in it, digest of the anchor, of the context."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(gram + 8, np.uint8))).astype(np.uint64)
    eight = np.zeros(n + gram, np.uint64)
    for k in range(8):
        eight |= wide[k : k + n + gram] << np.uint64(8 * k)
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h = mix(h + eight[k : k + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least[: n - width] = np.minimum(least[: n - width], least[width:])
        width *= 2
    if width < span:
        least[: n - (span - width)] = np.minimum(least[: n - (span - width)], least[span - width :])
    whole = np.zeros(n + 1, np.int32)
    last = off[1:] - length
    fits = last >= off[:-1]
    np.add.at(whole, off[:-1][fits], 1)
    np.add.at(whole, last[fits] + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(off, start, side="right") - 1
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    first, count = start[cut], np.diff(np.append(cut, len(start)))
    raw = memoryview(data.tobytes())
    digest = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (first + count + length - 1).tolist()))
    return text[cut], first, count, h[at[cut]].view(np.int64), mix(np.frombuffer(digest, np.uint64) + (at[cut] - first).astype(np.uint64)).view(np.int64)


def batch_of(h, c, doc, p, n, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.int64()), "doc": pa.array(doc, pa.int64()), "p": pa.array(p, pa.int64()), "n": pa.array(n, pa.int32()), "kind": pa.array(kind, pa.int32())})


ROWS = "h bigint, c bigint, doc bigint, p bigint, n int, kind int"
#: Kinds of rows: an anchor's context, a repeat (windows p to p + n - 1 of doc), a context that others must be compared with.
CONTEXT, REPEAT, COMPARE = 0, 1, 2


def found(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part in slices(batch):
                off, data = text_bytes(part.column("text"))
                text, first, count, h, c = anchors(off, data, length, gram)
                doc = part.column("doc").to_numpy()
                held.append((h, c, doc[text], first - off[text], count))
            if sum(len(x[0]) for x in held) > 4_000_000:
                yield from settled(held)
                held = []
        if held:
            yield from settled(held)

    return find


def settled(held: list) -> Iterator[pa.RecordBatch]:
    """Contexts that are new here; repeats of them, neighbours put together and dealt out by document."""
    h, c, doc, p, n = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((p, doc, c, h))
    h, c, doc, p, n = (x[order] for x in (h, c, doc, p, n))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else np.zeros(0, np.int64)
    again = ~fresh & ((doc != doc[head]) | (p != p[head]))
    yield batch_of(h[fresh], c[fresh], doc[fresh], p[fresh], n[fresh], np.full(fresh.sum(), CONTEXT))
    doc, p, n = doc[again], p[again], n[again]
    order = np.lexsort((p, doc))
    doc, p, n = doc[order], p[order], n[order]
    gap = np.ones(len(p), bool)
    gap[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + n[:-1])
    begin = np.flatnonzero(gap)
    if len(begin):
        size = np.add.reduceat(n, begin)
        yield batch_of(mix(doc[begin].view(np.uint64)).view(np.int64), np.zeros(len(begin), np.int64), doc[begin], p[begin], size, np.full(len(begin), REPEAT))


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, kind, c, doc, p. Contexts seen before are repeats; first ones are compared if their anchor has others."""
    last = None  # of the rows before: h, c, its first context's place, the pending first row or None if it has been given out
    for batch in batches:
        h, c, doc, p, n, kind = (batch.column(k).to_numpy() for k in ("h", "c", "doc", "p", "n", "kind"))
        done = kind == REPEAT
        if done.any():
            yield batch_of(h[done], c[done], doc[done], p[done], n[done], kind[done])
        h, c, doc, p, n = (x[~done] for x in (h, c, doc, p, n))
        if not len(h):
            continue
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        if last is not None:
            new_h[0] = h[0] != last["h"]
            new_c[0] = new_h[0] or c[0] != last["c"]
        # the first occurrence of each row's context, which may lie in an earlier batch
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        head_doc = np.where(head >= 0, doc[head], last["doc"] if last else 0)
        head_p = np.where(head >= 0, p[head], last["p"] if last else 0)
        again = ~new_c & ((doc != head_doc) | (p != head_p))
        yield batch_of(h[again], c[again], doc[again], p[again], n[again], np.full(again.sum(), REPEAT))
        group = np.cumsum(new_h)  # 0: the group of the row before goes on
        others = np.zeros(group[-1] + 1, np.int64)
        np.add.at(others, group[new_c], 1)
        goes_on = last is not None and not new_h[0]
        if goes_on:
            others[0] += 1
        many = others > 1
        if goes_on and last["multi"]:
            many[0] = True
        give = new_c & many[group]
        out = [x[give] for x in (h, c, doc, p, n)]
        if goes_on and many[0] and not last["multi"]:
            out = [np.append(x, v) for x, v in zip(out, last["row"])]
        if len(out[0]):
            yield batch_of(*out, np.full(len(out[0]), COMPARE))
        k = int(np.flatnonzero(new_h)[-1]) if new_h.any() else -1
        row = (h[k], c[k], doc[k], p[k], n[k]) if k >= 0 else last["row"]
        last = {"h": h[-1], "c": c[-1], "doc": head_doc[-1], "p": head_p[-1], "multi": bool(many[group[-1]]), "row": row}


def cut_out(length: int):
    """The contexts to compare, cut out of a block's texts; of hot anchors, a row for each window."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("h", "w", "doc", "p", "n", "piece")}
        left = left.combine_chunks()
        where: dict[int, list[int]] = {}
        for k, d in enumerate(left.column("doc").to_pylist()):
            where.setdefault(d, []).append(k)
        texts = left.column("text")
        rows = right.sort_by([("doc", "ascending"), ("p", "ascending")])
        now, datas = None, []
        for h, c, d, p, n, hot in zip(*(rows.column(k).to_pylist() for k in ("h", "c", "doc", "p", "n", "hot"))):
            if d != now:
                now, datas = d, [(texts[k].as_py() or "").encode() for k in where.get(d, ())]
            for data in datas[:1] if len(datas) == 1 else (x for x in datas if same(x, p, n, c, h, length)):
                piece = data[p : p + n + length - 1]
                if hot:
                    for k in range(n):
                        a = hashlib.blake2b(piece[k : k + length], digest_size=16).digest()
                        for name, v in zip(out, (int.from_bytes(a[:8], "little", signed=True), int.from_bytes(a[8:], "little", signed=True), d, p + k, 1, None)):
                            out[name].append(v)
                else:
                    for name, v in zip(out, (h, None, d, p, n, piece)):
                        out[name].append(v)
                break
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    return cut


def same(data: bytes, p: int, n: int, c: int, h: int, length: int) -> bool:
    """Whether this text (one of several with its id) has that context at p."""
    if p + n + length - 1 > len(data):
        return False
    _, first, count, hs, cs = anchors(np.array([0, len(data)]), np.frombuffer(data, np.uint8), length, GRAM)
    return bool(((first == p) & (count == n) & (hs == h) & (cs == c)).any())


def ranked(key: np.ndarray, far: int) -> np.ndarray:
    """Ranks of suffixes by their first far + width bytes, from their ranks by `width` bytes, far being at most that width."""
    next_ = np.zeros_like(key)
    next_[: max(0, len(key) - far)] = key[far:] + 1
    return np.unique(key * np.int64(len(key) + 2) + next_, return_inverse=True)[1]


def smaller_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in order, the common prefix with the nearest one before it that has a smaller position (0: there is none).

    common[k] is the common prefix of suffixes k - 1 and k. Suffixes that are known not to be smaller are jumped over
    together with those that they have jumped over, all suffixes at once."""
    to = np.arange(len(position)) - 1
    shared = common.copy()
    open_ = np.flatnonzero((to >= 0) & (position[to] >= position))
    while len(open_):
        over = to[open_]
        shared[open_] = np.minimum(shared[open_], shared[over])
        to[open_] = to[over]
        open_ = open_[(to[open_] >= 0) & (position[to[open_]] >= position[open_])]
    shared[to < 0] = 0
    return shared


def previous_factors(data: np.ndarray, start: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor, up to `length`, of each suffix of data that starts at start[k]: the longest prefix that it
    has in common with a suffix of smaller position (equal positions are no earlier ones)."""
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | wide[k : k + len(data)]
    rank, width, levels = np.unique(eight, return_inverse=True)[1], 8, []
    while 2 * width <= length:
        levels.append((width, rank))
        rank, width = ranked(rank, width), 2 * width
    levels.append((width, rank))
    if width < length:
        rank = ranked(rank, length - width)
    order = np.lexsort((position, rank[start]))
    suffix, position = start[order], position[order]
    # common prefixes of neighbours: by blocks of falling width, then byte by byte
    a, b, common = suffix[:-1], suffix[1:], np.zeros(len(suffix), np.int64)
    shared = common[1:]
    for width, by in reversed(levels):
        i, j = a + shared, b + shared
        inside = np.maximum(i, j) + width <= len(data)
        same = np.zeros(len(a), bool)
        same[inside] = by[i[inside]] == by[j[inside]]
        shared[same] += width
    for _ in range(8):
        i, j = a + shared, b + shared
        inside = np.maximum(i, j) < len(data)
        same = np.zeros(len(a), bool)
        same[inside] = data[i[inside]] == data[j[inside]]
        if not same.any():
            break
        shared[same] += 1
    shared[rank[a] == rank[b]] = length
    np.minimum(common, length, out=common)
    before = smaller_before(position, common)
    after = smaller_before(position[::-1], np.append(common[1:], 0)[::-1].copy() if len(common) else common)
    # read backwards, a suffix's neighbour before it is the next one: its common prefix stands at that neighbour's place
    out = np.zeros(len(start), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def repeats_in(data: np.ndarray, sizes: np.ndarray, n: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Flags for the windows of the pieces, one after the other: whether the longest previous factor there is `length` or more.
    data: the pieces' bytes, of these sizes; n: windows of each; docs, places: its document and where in it the piece starts."""
    start = spread(np.cumsum(sizes) - sizes, n)
    doc, place = np.repeat(docs, n), spread(places, n)
    by = np.lexsort((place, doc))
    step = np.ones(len(by), np.int64)
    step[1:] = (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])
    position = np.empty(len(by), np.int64)
    position[by] = np.cumsum(step)
    return previous_factors(data, start, position, length) >= length


def sorted_out(length: int):
    """Rows sorted by h, doc, p: repeats among the pieces of each anchor."""

    def work(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, doc, p, n, size, data = rows
        flags = repeats_in(data, size, n, doc, p, length)
        # runs of flags, none of them over two pieces
        first = np.zeros(len(flags) + 1, bool)
        first[np.cumsum(n) - n] = True
        first[-1] = True
        before = np.concatenate(([False], flags))
        starts = np.flatnonzero(flags & (first[:-1] | ~before[:-1]))
        ends = np.flatnonzero(flags & (first[1:] | ~np.concatenate((flags[1:], [False])))) + 1
        row = np.searchsorted(np.cumsum(n), starts, side="right")
        return pa.RecordBatch.from_pydict({"doc": pa.array(doc[row]), "p": pa.array(p[row] + starts - (np.cumsum(n) - n)[row]), "n": pa.array((ends - starts).astype(np.int32))})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            off, data = text_bytes(batch.column("piece"))
            rows = [*(batch.column(k).to_numpy().astype(np.int64) for k in ("h", "doc", "p", "n")), np.diff(off), data]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if len(held[-1]) < SORT_BYTES or not len(held[0]):
                continue
            cut = int(np.flatnonzero(held[0] == held[0][-1])[0])  # the last anchor's pieces may go on
            if cut:
                at = int(held[4][:cut].sum())
                yield work([x[:cut] for x in held[:5]] + [held[5][:at]])
                held = [x[cut:] for x in held[:5]] + [held[5][at:]]
        if held is not None and len(held[0]):
            yield work(held)

    return sort


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string, spans array<bigint>"


def cleaned(length: int, with_text: bool):
    """Takes the repeats out of a block's texts."""

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.sort_by([("doc", "ascending"), ("p", "ascending")])
        doc, p, n = (rows.column(k).to_numpy() for k in ("doc", "p", "n"))
        out = []
        for d, id_, text in zip(left.column("doc").to_pylist(), left.column("doc_id").to_pylist(), left.column("text").to_pylist()):
            data = np.frombuffer((text or "").encode(), np.uint8)
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
            edge = np.zeros(len(data) + 1, np.int32)
            end = p[a:b] + n[a:b] + length - 1
            fits = end <= len(data)
            np.add.at(edge, p[a:b][fits], 1)
            np.add.at(edge, end[fits], -1)
            gone = np.cumsum(edge[:-1]) > 0
            starts, ends = runs(gone)
            kept = data[~gone].tobytes()
            spans = np.stack((starts, ends), axis=1).ravel().tolist() if with_text else None
            out.append((id_, len(data), int(gone.sum()), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if with_text else None, spans))
        cols = list(zip(*out)) or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, cols, types)})

    return clean


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds kept (what is left, bytes of broken
    characters replaced) and spans (starts and ends of the removed runs, in bytes of the input).

    Strings are judged on the input; matches never cross documents. A null text is empty; texts shorter than `length` keep all.
    Rows that share an id count as one document given several times: of equal strings in them the one of smaller start is the
    earlier, at equal starts neither. Null ids count as one id before all others. Other columns are ignored."""
    null_id = -(1 << 63)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(null_id)).alias("doc"), text_of(text_col).alias("text"))
    rows = texts.select("doc", "text").mapInArrow(found(length, GRAM), ROWS)
    rows = written(rows.repartition("h").sortWithinPartitions("h", "kind", "c", "doc", "p").mapInArrow(judged, ROWS), "contexts")
    blocks = max(2, BLOCKS * docs.rdd.getNumPartitions())
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")
    dealt = texts.select("doc_id", "doc", "text", block)

    compare = rows.where(F.col("kind") == COMPARE)
    often = compare.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(True).alias("hot"))
    compare = compare.join(small(often), "h", "left").select("h", "c", "doc", "p", "n", F.coalesce("hot", F.lit(False)).alias("hot"), block)
    cut = dealt.groupBy("block").cogroup(compare.groupBy("block")).applyInArrow(cut_out(length), "h bigint, w bigint, doc bigint, p bigint, n int, piece binary")
    cut = written(cut, "pieces")
    near = cut.where("piece IS NOT NULL").drop("w").repartition("h").sortWithinPartitions("h", "doc", "p").mapInArrow(sorted_out(length), "doc bigint, p bigint, n int")
    windows = cut.where("piece IS NULL").select(F.col("h"), "w", "doc", "p")
    first = windows.groupBy("h", "w").agg(F.min(F.struct("doc", "p")).alias("first"), F.count("*").alias("k")).where("k > 1")
    far = windows.join(first, ["h", "w"]).where(F.struct("doc", "p") > F.col("first")).select("doc", "p", F.lit(1).alias("n"))
    repeats = rows.where(F.col("kind") == REPEAT).select("doc", "p", "n").unionByName(near).unionByName(far).select("doc", "p", "n", block)
    out = dealt.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(cleaned(length, with_text), RESULT)
    return out if with_text else out.drop("kept", "spans")
