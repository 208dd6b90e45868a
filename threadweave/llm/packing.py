"""Bounded-space online packing. Each partition keeps a fixed number of windows open. A piece goes into the fullest window
that it fits (best fit); when none takes it, the fullest window is emitted, topped up with the head of the piece if more
than a set number of places would stay free. What is left open at a partition's end is merged in groups of partitions:
windows are filled one after the other, and the last, part-filled one is cut at powers of two, where no padding is due."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import slices, text_bytes, text_of, written
from threadweave.llm.tokens import encoder, with_end

WINDOW, OPEN, SLACK = 4096, 64, 24
#: Partitions whose leftovers are merged by one task: at most MERGED * OPEN windows meet there.
MERGED = 4
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"
#: A document of a partition: which, its number in the partition, ids before the piece, the ids, ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """One partition's open windows, sorted by (filled, number)."""

    def __init__(self, window: int, n_open: int, slack: int) -> None:
        self.window, self.n_open, self.slack = window, n_open, slack
        self.fill: list[tuple[int, int]] = []
        self.pieces: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Places a document; yields the windows that this fills."""
        total, at = len(ids), 0
        while total - at >= self.window:
            yield [(doc, at, ids[at : at + self.window], total)]
            at += self.window
        while at < total:
            rest = total - at
            k = bisect_left(self.fill, (self.window - rest + 1, -1)) - 1
            if k >= 0 and (len(self.fill) >= self.n_open or self.fill[k][0] + rest == self.window):
                take = rest
            elif len(self.fill) < self.n_open:
                self.made += 1
                self.pieces[self.made] = [(doc, at, ids[at:], total)]
                insort(self.fill, (rest, self.made))
                return
            else:
                k = len(self.fill) - 1
                take = self.window - self.fill[k][0]
                if take <= self.slack:
                    yield self.pieces.pop(self.fill.pop(k)[1])
                    continue
            filled, nr = self.fill.pop(k)
            self.pieces[nr].append((doc, at, ids[at : at + take], total))
            at += take
            if filled + take == self.window:
                yield self.pieces.pop(nr)
            else:
                insort(self.fill, (filled + take, nr))


def table(rows: list[tuple], with_ids: bool) -> dict[str, pa.Array]:
    """rows: (piece, sequence, offset)."""
    cols = list(zip(*[(p[0], p[1], len(p[2]), zlib.crc32(np.ascontiguousarray(p[2], "<u4")), p[3], s, o, p[2] if with_ids(s) else None) for p, s, o in rows])) or [[]] * 8
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
    return [pa.array(c, t) for c, t in zip(cols, types)]


def placed(window: list[Piece], sequence: int) -> list[tuple]:
    out, at = [], 0
    for p in window:
        out.append((p, sequence, at))
        at += len(p[2])
    return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def packed(path: str, end_id: int, window: int, n_open: int, slack: int, keep_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, made = Packer(window, n_open, slack), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids, bounds = with_end(*encoder(path).encode(piece.column("text"), *text_bytes(piece.column("text"))), end_id)
                rows: list[tuple] = []
                for doc, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    for full in packer.add(doc, ids[a:b]):
                        rows += placed(full, (part << 33) + made)
                        made += 1
                yield pa.RecordBatch.from_arrays(table(rows, lambda _: keep_ids), NAMES)
        # leftovers: sequence -(partition + 1), with their ids
        left = [(p, -part - 1, 0) for _, nr in packer.fill for p in packer.pieces[nr]]
        yield pa.RecordBatch.from_arrays(table(left, lambda _: True), NAMES)

    return pack


def merged(window: int, keep_ids: bool):
    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("sequence_id", "doc_id", "start", "length", "ids_crc32")]).combine_chunks()
        group, out = rows.column("merge")[0].as_py(), []
        pieces = rows.column("ids").combine_chunks()
        flat, bounds = pieces.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pieces.value_lengths().to_numpy()))).astype(np.int64)
        left = len(flat)
        # the lengths of the sequences: full windows, then the binary digits of what remains
        lengths = [window] * (left // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (left % window) >> b & 1]
        room, at_seq, nr = (lengths[0] if lengths else 0), 0, 0
        for doc, start, total, a, b in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), bounds[:-1], bounds[1:]):
            at, ids = 0, flat[a:b]
            while at < len(ids):
                take = min(room, len(ids) - at)
                out.append(((doc, start + at, ids[at : at + take], total), -(group << 33) - nr - 1, at_seq))
                at, room, at_seq = at + take, room - take, at_seq + take
                if not room:
                    nr, at_seq = nr + 1, 0
                    room = lengths[nr] if nr < len(lengths) else 0
        return pa.Table.from_arrays(table(out, lambda _: keep_ids), NAMES)

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, n_open: int = OPEN, slack: int = SLACK, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if keep_ids.

    window: a power of two. Sequences hold at most `window` ids; one whose length is no power of two lacks at most `slack`
    of a window. sequence_id: 0 or more for windows filled by a partition, below 0 for merged leftovers. A null text is
    empty and has the end id alone; repeated rows and null ids are packed like others; an empty table gives an empty result;
    other columns are ignored."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = written(rows.mapInArrow(packed(tokenizer, end_id, window, n_open, slack, keep_ids), PIECES), "packed")
    full = rows.where("sequence_id >= 0")
    left = rows.where("sequence_id < 0").withColumn("merge", F.expr(f"(-sequence_id - 1) div {MERGED}"))
    out = full.unionByName(left.groupBy("merge").applyInArrow(merged(window, keep_ids), PIECES))
    return out if keep_ids else out.drop("ids")
