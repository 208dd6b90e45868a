"""Exact batch tokenization. The text is cut where a pre-token of the given tokenizer must end, each distinct piece is
encoded once per worker with the tokenizers library, and the texts' ids are put together from the pieces' ids.

Cuts lie before a run of ASCII white space and between an ASCII letter and another ASCII character that is no letter,
but not after an apostrophe (contractions). A pre-token of either supported pattern never spans such a cut. Texts for which
that can't be relied on (the strings of special tokens, rare white space with the byte-level pattern) are encoded whole, and
so are all texts if the file has another normalizer, pre-tokenizer or model than those that are known here."""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

from threadweave.llm.common import LOWER, SPACES, spread

#: Pieces in a generation of a worker's memory. A full one becomes the old one, which takes the place of the one before it;
#: what is met again moves into the new one, so memory is bounded and pieces in use are kept.
REMEMBERED = 200_000
#: Pieces that are handed to the library as one text, line by line.
JOINED = 128

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = np.zeros(256, bool)
_OTHER[:128] = True
_OTHER &= ~_LETTER & ~SPACES
_FLAT = LOWER.copy()
_FLAT[[9, 10, 11, 12, 13]] = 32
_RARE_SPACE = "[\x1c-\x1f\u0085   -     　]"
_LATIN_LOWER = "^[a-zß-öø-ÿ]+$"
_LATIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


# The normalizers and pre-tokenizers whose cuts are known, as files state them.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN = [
    (None, BYTE_LEVEL),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, BYTE_LEVEL | {"use_regex": False}]},
    ),
]


def known(whole: Tokenizer) -> bool:
    """Whether this tokenizer's texts can be cut into pieces."""
    stated = lambda part: None if part is None else json.loads(part.__getstate__())
    plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in whole.get_added_tokens_decoder().values())
    return plain and isinstance(whole.model, models.BPE) and whole.model.dropout is None and (stated(whole.normalizer), stated(whole.pre_tokenizer)) in KNOWN


def byte_chars() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: its own where that is printable in Latin-1, else one
    from 256 on, in order."""
    own = np.zeros(256, bool)
    own[33:127] = own[161:173] = own[174:] = True
    return np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")


BYTE_CHARS = byte_chars()


def byte_level(text: str) -> str:
    """The characters that stand for a text's bytes, as the library's byte-level step gives them."""
    return BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


class Encoder:
    """Encodes columns of texts with one tokenizer file: ids as the library gives them, add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.cuts = known(self.whole)
        if not self.cuts:
            return
        self.lowers = self.whole.normalizer is not None
        # the same model for pieces that are one pre-token and that the normalizer leaves alone
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(chr(BYTE_CHARS[10]), "isolated")
        (self.line,) = self.plain.encode(chr(BYTE_CHARS[10]), add_special_tokens=False).ids
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Starts a new generation of the memory, and drops the old one."""
        none: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, np.zeros(1, np.int64), np.zeros(0, np.int32))
        self.old = (self.place, self.ptr, self.ids) if hasattr(self, "place") else none
        self.place, self.ptr, self.ids = none[0], none[1], none[2]

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces that aren't remembered."""
        bare = pc.utf8_trim(pieces, " ") if self.lowers else pieces
        easy = pc.match_substring_regex(bare, _LATIN_LOWER if self.lowers else _LATIN).to_numpy(zero_copy_only=False)
        words = bare.filter(pa.array(easy)).to_pylist()
        # a line break is a token of its own, which no such piece has: the ids of many pieces come back as one list
        lines = [byte_level("\n".join(words[k : k + JOINED]) + "\n") for k in range(0, len(words), JOINED)]
        flat = np.array([i for e in self.plain.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int32)
        stop = np.flatnonzero(flat == self.line)
        rest = [e.ids for e in self.whole.encode_batch_fast(pieces.filter(pa.array(~easy)).to_pylist(), add_special_tokens=False)]
        size = np.zeros(len(pieces), np.int64)
        size[easy] = np.diff(stop, prepend=-1) - 1
        size[~easy] = [len(x) for x in rest]
        ids = np.zeros(size.sum(), np.int32)
        of_easy = np.repeat(easy, size)
        ids[of_easy] = flat[flat != self.line]
        ids[~of_easy] = [i for x in rest for i in x]
        return size, ids

    def _remember(self, pieces: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
        self.ptr = np.concatenate((self.ptr, self.ptr[-1] + np.cumsum(size)))
        self.ids = np.concatenate((self.ids, ids))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is in the memory, after the unknown ones have been encoded."""
        if len(self.place) > REMEMBERED:
            self.forget()
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        at = np.array(list(map(self.place.get, names, repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        at[new] = len(self.place) + np.arange(len(new))
        names = [names[k] for k in new]
        place, ptr, ids = self.old
        was = np.array(list(map(place.get, names, repeat(-1))), np.int64)
        size = np.where(was >= 0, ptr[was + 1] - ptr[was], 0)
        size[was < 0], made = self._fresh(pieces.take(pa.array(new[was < 0])))
        every = np.zeros(size.sum(), np.int32)
        again = np.repeat(was >= 0, size)
        every[again] = ids[spread(ptr[was[was >= 0]], size[was >= 0])]
        every[~again] = made
        self._remember(names, size, every)
        return at

    def _direct(self, column: pa.Array, data: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(column), bool)
        for s in self.specials:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if not self.lowers and (data >= 0xC2).any() | ((data >= 0x1C) & (data <= 0x1F)).any():
            odd |= pc.match_substring_regex(column, _RARE_SPACE).to_numpy(zero_copy_only=False)
        return odd

    def pieces(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Starts of the pieces, and the pieces with equal ones numbered alike."""
        if self.lowers:
            data = _FLAT[data]
        space = SPACES[data]
        start = np.zeros(len(data), bool)
        if len(data):
            start[1:] = space[1:] & ~space[:-1]
            letter, other = _LETTER[data], _OTHER[data]
            start[1:] |= letter[:-1] & other[1:]
            start[1:] |= other[:-1] & letter[1:] & (data[:-1] != 39)
            start[off[:-1][off[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        ends = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        return at, pa.StringArray.from_buffers(len(at), ends, pa.py_buffer(data)).dictionary_encode()

    def encode(self, column: pa.Array, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids begin (one more at the end)."""
        if not self.cuts:
            made = [e.ids for e in self.whole.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in made for i in x], np.int32), np.concatenate(([0], np.cumsum([len(x) for x in made], dtype=np.int64)))
        odd = self._direct(column, data)
        at, coded = self.pieces(off, data)
        nr = self._places(coded.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(self.ptr.astype(np.int32)), pa.array(self.ids)).take(pa.array(nr))
        got = pa.LargeListArray.from_arrays(pa.array(lists.offsets.to_numpy().astype(np.int64)), lists.values).take(coded.indices)
        ids, ends = got.values.to_numpy(), got.offsets.to_numpy()
        bounds = ends[np.searchsorted(at, off)]
        if odd.any():
            parts = [ids[bounds[k] : bounds[k + 1]] for k in range(len(column))]
            for k in np.flatnonzero(odd):
                parts[k] = np.asarray(self.whole.encode(column[int(k)].as_py(), add_special_tokens=False).ids, np.int32)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            ids = np.concatenate(parts) if parts else ids
        return ids, bounds


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    return Encoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], end_id).astype(np.int32), bounds + np.arange(n + 1)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
