"""Tokens of texts and pieces of a bounded number of tokens. The tokenizer's file is a parameter; a null text is empty."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are encoded at a time; a longer text goes by itself.
SLICE = 1 << 20


@lru_cache(maxsize=4)
def encoder(path: str):
    """One tokenizer for each file and worker process, without truncation or padding, and with one thread, as tasks share the cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about SLICE characters at most."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(texts: pd.Series, path: str) -> Iterator[tuple[str, object]]:
    """Each text with its encoding."""
    enc = encoder(path)
    for some in slices([t or "" for t in texts]):
        yield from zip(some, enc.encode_batch(some, add_special_tokens=False))


def answer_text(title: Column, body: Column) -> Column:
    """`Q: title`, a line break, `A: body`; null counts as empty."""
    return F.concat(F.lit("Q: "), F.coalesce(title, F.lit("")), F.lit("\nA: "), F.coalesce(body, F.lit("")))


def token_count(col: Column, path: str) -> Column:
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e) for _, e in encoded(texts, path)], dtype="int64")

    return count.asNondeterministic()(col)  # lest a filter on it encodes the texts again


def token_pieces(col: Column, path: str, limit: int) -> Column:
    """The text as an array of structs (text, n_tokens) of `limit` of its tokens each, without overlap; an empty text: one empty piece.

    Cuts are at the tokens' places in the text, so the pieces always make up the whole text. Where several tokens share one
    character, the character goes to the piece that its last token is in."""

    @F.pandas_udf("array<struct<text: string, n_tokens: bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text, e in encoded(texts, path):
            cuts = [0, *(a for a, _ in e.offsets[limit::limit]), len(text)]
            last = len(cuts) - 2
            out.append([{"text": text[a:b], "n_tokens": limit if i < last else len(e) - limit * last} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        return pd.Series(out)

    return cut(col)


def token_chunks(col: Column, path: str, limit: int) -> Column:
    """The texts of token_pieces."""
    return F.transform(token_pieces(col, path, limit), lambda p: p["text"])


def truncated_text(col: Column, path: str, limit: int) -> Column:
    """Struct of text (its first `limit` tokens) and truncated."""
    pieces = token_chunks(col, path, limit)
    return F.struct(pieces[0].alias("text"), (F.size(pieces) > 1).alias("truncated"))
