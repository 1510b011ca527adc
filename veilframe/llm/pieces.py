"""Encoding of many texts through their distinct pieces.

Texts are cut at safe boundaries: places where a tokenizer of the byte-pair family (split into
runs of letters, digits, other signs and white space before merging) never lets a token reach
across, so that the tokens of the pieces are the tokens of the text. A boundary is taken only
between two characters that are ASCII or Latin letters, namely before white space, and between a
letter or digit run and other signs except the apostrophe (contractions). Text in other scripts
stays whole between white space. Texts that contain the string of a special token are encoded as
a whole, because such strings are matched before splitting.

Pieces are compared by two 64-bit hashes and their length. A worker keeps what it has learnt, in
a table of bounded size, and the library encodes only pieces that are not in the table, in batches
balanced by bytes. A full table forgets the pieces that were not met again since the last time.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd

from veilframe.llm.bytearrays import byte_prefix, separated, span_hash

#: Entries of a worker's table; it forgets when it has more.
TABLE_ENTRIES = 400_000
#: Bytes of pieces that the library gets at once.
BATCH_BYTES = 1 << 16

_BLANK, _LETTER, _DIGIT, _QUOTE, _SIGN, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = _SIGN
_CLASS[:33] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[ord("'")] = _QUOTE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0xC3:0xCA] = _LETTER  # first byte of a Latin letter of two bytes
_CLASS[127] = _OTHER

_CUT = np.zeros((6, 6), bool)
for _left in (_LETTER, _DIGIT, _SIGN, _QUOTE):
    _CUT[_left, _BLANK] = True
for _left, _right in ((_LETTER, _SIGN), (_SIGN, _LETTER), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_SIGN, _DIGIT)):
    _CUT[_left, _right] = True
_CUT = _CUT.reshape(36)


def boundaries(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places (sorted, with each text's begin) where pieces start."""
    kind = _CLASS[raw]
    if (raw >= 0xC3).any():
        lead = kind == _LETTER
        lead &= raw >= 0xC3
        after = np.zeros_like(lead)
        after[1:] = lead[:-1]
        # The multiplication and division signs, and a capital that lower-cases to two characters.
        signs = np.flatnonzero(after & ((raw == 0x97) | (raw == 0xB7) | (raw == 0xB0)))
        signs = signs[raw[signs - 1] == np.where(raw[signs] == 0xB0, 0xC4, 0xC3)]
        kind[after] = _LETTER
        kind[signs] = kind[signs - 1] = _OTHER
    cut = np.empty(len(raw), bool)
    cut[0:1] = True
    cut[1:] = _CUT[kind[:-1] * 6 + kind[1:]]
    cut[begins[begins < len(raw)]] = True
    return np.flatnonzero(cut)


def tokenizer_path(name: str) -> str:
    """A file path as it is, or the place of a public vocabulary file of that name on this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """The library's tokenizer without truncation and padding; one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceTable:
    """Ids (or only their number) of pieces seen before."""

    def __init__(self, tokenizer, with_ids: bool, entries: int = TABLE_ENTRIES):
        self.tokenizer, self.with_ids, self.entries = tokenizer, with_ids, entries
        self.specials = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep only the pieces that were met again, or none if these fill over half the table."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > self.entries:
            self._clear()
            return
        place, length = self.place[keep], self.length[keep]
        self.keys, self.length, self.again = self.keys[keep], length, np.zeros(len(keep), bool)
        self.place = np.zeros(len(keep), np.int64)
        if self.with_ids:
            self.place = np.cumsum(length) - length
            self.ids = self.ids[np.repeat(place - self.place, length) + np.arange(int(length.sum()))]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of texts by the library, in batches balanced by bytes."""
        out: list[list[int]] = []
        batch: list[str] = []
        size = 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_BYTES:
                out += [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        if batch:
            out += [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = self.encode(pieces)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        place = np.zeros(len(ids), np.int64)
        if self.with_ids:
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum()))
            place[1:] = np.cumsum(length)[:-1]
            place += len(self.ids)
            self.ids = np.concatenate([self.ids, flat])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.place = np.insert(self.place, at, place[order])
        self.length = np.insert(self.length, at, length[order])
        self.again = np.insert(self.again, at, False)

    def _find(self, keys: np.ndarray, piece: Callable[[int], str]) -> np.ndarray:
        """Entry of each distinct key; ``piece`` gives the text of the i-th."""
        at, known = self._seek(keys)
        self.again[at[known]] = True
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > self.entries:
                self._forget()
                _, known = self._seek(keys)
            missing = np.flatnonzero(~known)
            self._learn(keys[missing], [piece(i) for i in missing])
            at = np.searchsorted(self.keys, keys)
        return at

    def _seek(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Tokens of each text, offsets of its ids, and all ids (None if only numbers are kept)."""
        text, begins = separated(raw, at, mark=10)
        rows = len(at) - 1
        data = text.tobytes()
        special = [i for i in range(rows) if any(s in data[begins[i] : begins[i + 1] - 1] for s in self.specials)] if any(s in data for s in self.specials) else []
        starts = boundaries(text, begins)
        starts = starts[starts < len(text)]
        ends = np.append(starts[1:], len(text))
        owner_first = np.searchsorted(starts, begins)
        last = owner_first[1:] - 1
        ends[last[last >= 0]] = begins[1:] - 1  # without the separator
        filled = ends > starts
        keys = span_hash(byte_prefix(text), starts, ends) ^ (starts * 0 + (ends - starts)).astype(np.uint64)
        codes, distinct = pd.factorize(keys)
        # One place of each distinct piece.
        place = np.zeros(len(distinct), np.int64)
        place[codes[::-1]] = np.arange(len(codes))[::-1]
        entry = self._find(distinct, lambda i: data[starts[place[i]] : ends[place[i]]].decode())
        length = np.where(filled, self.length[entry][codes], 0)
        owned = np.repeat(np.arange(rows), np.diff(owner_first))
        whole: dict[int, list[int]] = {}
        if special:
            found = self.encode([data[begins[i] : begins[i + 1] - 1].decode() for i in special])
            whole = dict(zip(special, found, strict=True))
            length = np.where(np.isin(owned, special), 0, length)
        counts = np.bincount(owned, weights=length, minlength=rows).astype(np.int64)
        ids = None
        if self.with_ids:
            begin = np.cumsum(length) - length
            index = np.repeat(self.place[entry][codes] - begin, length) + np.arange(int(length.sum()))
            ids = self.ids[index]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if whole:
            if ids is not None:
                runs = [np.asarray(whole[i], np.uint32) if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(rows)]
                ids = np.concatenate(runs) if runs else ids
            for i, x in whole.items():
                counts[i] = len(x)
            offsets = np.concatenate([[0], np.cumsum(counts)])
        return counts, offsets, ids


@lru_cache(maxsize=4)
def piece_table(name: str, with_ids: bool) -> PieceTable:
    """This worker's table for a tokenizer file."""
    return PieceTable(load_tokenizer(name), with_ids)
