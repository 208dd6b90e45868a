"""Quality rules on repetition: how many characters of a text lie inside n-grams and lines that the text has more than once.

Word hashes are rolled into hashes of n-grams, a slice of texts at a time in numpy. Of the shortest length all n-grams of a text are
sorted; a longer one can only be found twice where its head is, so for longer ones just the places that are left are sorted.
Nothing is shuffled: a document's verdict depends on its text alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import SPACES, lookup, mix, slices, text_bytes, text_of, word_hashes, words

# Fixed values of the published repetition rules: percent of characters that may lie inside n-grams equal to an earlier one, by n, and
# inside lines equal to an earlier one.
GRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 20
#: Base rules: words that a text needs, the window of repeated words and the percent of words that such windows may cover.
LEAST_WORDS, WINDOW, WINDOW_PERCENT = 20, 8, 30

SYMBOLS = lookup(b"#*$%&|<>")
_KEY = (0x7A3C94E15D80B62F, 0x1F4D6B8893A7C205)


def repeated_starts(hashes: np.ndarray, text: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places `at`, starts of n words of one text: those whose n words the text has elsewhere too, and those of them that
    have an equal one before. hashes: of each word; text: which text each word is in."""
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    key = mix(gram + mix(text[at].astype(np.uint64) + np.uint64(n << 40)))
    order = np.argsort(key)
    key, at = key[order], at[order]
    same = np.concatenate(([False], key[1:] == key[:-1], [False]))
    several = (same[1:] | same[:-1])[: len(key)]
    key, at = key[several], at[several]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    first = np.minimum.reduceat(at, head) if len(head) else at
    later = at != np.repeat(first, np.diff(np.append(head, len(at))))
    return np.sort(at), at[later]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Flags of `size` places: those inside n places from any of the starts."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measured(lengths: tuple[int, ...], window: int):
    """Arrow batches of doc_id and text to doc_id with the measures of each text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = {"doc_id": part.column("doc_id")} | measures(part.column("text"), lengths, window)
                yield pa.RecordBatch.from_pydict(out)

    return measure


def measures(column: pa.Array, lengths: tuple[int, ...], window: int) -> dict[str, np.ndarray]:
    off, data = text_bytes(column)
    count = len(off) - 1
    start, end, first = words(off, data, ~SPACES)
    text = np.repeat(np.arange(count), np.diff(first))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    chars = points[end] - points[start]
    total = lambda weight: np.bincount(text, weight, minlength=count).astype(np.int64) if len(text) else np.zeros(count, np.int64)
    out = {"n_words": np.diff(first), "word_chars": total(chars), "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}

    n_lines, repeats, repeat_chars = lines(column, off, data, start, chars)
    out |= {"n_lines": n_lines, "n_dup_lines": repeats, "dup_line_chars": repeat_chars}

    hashes = word_hashes(data, start, end, _KEY)
    left, at = first[1:][text] - np.arange(len(text)), np.arange(len(text))  # words from here to the text's end
    for n in sorted({*lengths, window}):
        at, later = repeated_starts(hashes, text, n, at[left[at] >= n])
        if n in lengths:
            out[f"dup_chars_{n}"] = total(chars * covered(later, n, len(text)))
        if n == window:
            out["n_repeat_words"] = total(covered(at, n, len(text)))
    return out


def lines(column: pa.Array, off: np.ndarray, data: np.ndarray, start: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its lines with a word, those of them that equal an earlier one, characters of words in the latter."""
    count = len(off) - 1
    filled = pc.fill_null(column, "")
    parts = pc.split_pattern(filled, "\n")
    code = pc.dictionary_encode(parts.flatten()).indices.to_numpy()
    per = pc.list_value_length(parts).to_numpy()
    text = np.repeat(np.arange(count), per)
    # where each line begins: at its text's start, or after a line feed
    begin = np.empty(len(text), np.int64)
    head = np.cumsum(per) - per
    begin[head] = off[:-1]
    rest = np.ones(len(text), bool)
    rest[head] = False
    begin[rest] = np.flatnonzero(data == 10) + 1
    upto = np.concatenate(([0], np.cumsum(chars)))
    word = np.searchsorted(start, np.append(begin, len(data)))
    has = word[1:] > word[:-1]
    weight = upto[word[1:]] - upto[word[:-1]]
    key = text * np.int64(int(code.max(initial=0)) + 1) + code
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    again &= has
    of = lambda w: np.bincount(text, w, minlength=count).astype(np.int64)
    return of(has), of(again), of(weight * again)


def repetition(docs: DataFrame, grams: dict[int, int] = GRAM_PERCENT, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, dup_line_chars and a
    dup_chars_<n> for each length n of `grams`: a row for each row of docs.

    Words are runs of anything but ASCII white space; a line counts if it has a word. dup_chars_<n> and dup_line_chars are code points of
    words inside n-grams and lines that equal an earlier one; n_repeat_words counts windows found twice, the first one too. A
    document stays if it has LEAST_WORDS words, such windows cover at most WINDOW_PERCENT of them and no share of characters is
    exceeded; a share that is just reached stays. A null or empty text has no words and fails. Rows are judged one by one, repeated ids or not; other columns are ignored. n-grams are told apart by keyed
    64-bit hashes, lines as they are. A single text takes about 60 bytes a byte of memory while it is measured."""
    order = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars"]
    for n in sorted({*grams, window}):
        order += [f"dup_chars_{n}"] * (n in grams) + ["n_repeat_words"] * (n == window)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(measured(tuple(sorted(grams)), window), f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in order))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_PERCENT * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= LINE_PERCENT * F.col("word_chars")
    for n, percent in grams.items():
        fine &= 100 * F.col(f"dup_chars_{n}") <= percent * F.col("word_chars")
    found = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, *[c for c in order if c not in base])
