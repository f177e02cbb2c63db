"""Ids of `tokenizers` for whole text columns: each distinct piece of text is encoded once while a worker remembers it.

Texts are cut where every tokenizer that splits by letters, digits, white space and other characters cuts them
too, whatever Unicode version it holds, so the ids of the pieces in a row are the ids of the text. Cutting, finding
equal pieces and joining their ids run in numpy and Arrow over the bytes of many texts at once.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from gridspark.llm.store import turn_to

#: Pieces and bytes of pieces that a worker remembers.
KEPT, KEPT_BYTES = 600_000, 32 << 20
LETTER, DIGIT, OTHER, QUOTE, SPACE, WIDE = 1, 2, 3, 4, 5, 6
#: Kinds of bytes; 0 is a byte of a character that may be anything.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = OTHER
KINDS[48:58] = DIGIT
KINDS[65:91] = KINDS[97:123] = LETTER
KINDS[39] = QUOTE
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
_encoders: dict[str, "Encoder"] = {}


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which the pieces of all texts begin; `offsets` holds where texts begin, and the end.

    A cut lies between ASCII letters, digits and others of different kinds (never beside an apostrophe, which
    contractions take along), before white space that follows a character known not to be, and around the last
    character of white space that is followed by such a one: a blank goes with what it precedes.
    """
    n = len(data)
    starts = np.zeros(n + 1, bool)
    if n:
        kind = KINDS[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xDF))
        kind[lead] = kind[lead + 1] = WIDE
        before, after = kind[:-1], kind[1:]
        plain = (kind >= LETTER) & (kind <= OTHER)
        starts[1:n] = plain[:-1] & plain[1:] & (before != after)
        space, known = kind == SPACE, (kind > 0) & (kind != SPACE)
        starts[1:n] |= space[1:] & known[:-1]
        end = np.flatnonzero(space[:-1] & known[1:]) + 1
        end = end[~np.isin(end, offsets)]
        starts[end - 1] = True
        starts[end] = data[end - 1] != 32
    starts[offsets] = True
    starts[n] = False
    return np.flatnonzero(starts)


class Encoder:
    """Texts to the ids of one JSON file, as `encode(text, add_special_tokens=False)` gives them: an added token in a text is its id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        if rules["truncation"] or rules["padding"]:
            raise ValueError(f"{path} cuts or pads its texts")
        self.added = [token["content"].encode() for token in rules["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = self.bytes = 0

    def learn(self, pieces: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, more = len(self.known), int(size.sum())
        while n + len(pieces) > len(self.first):
            self.first, self.size = np.resize(self.first, len(self.first) * 2), np.resize(self.size, len(self.size) * 2)
        while self.used + more > len(self.ids):
            self.ids = np.resize(self.ids, len(self.ids) * 2)
        self.first[n:n + len(found)] = self.used + np.cumsum(size) - size
        self.size[n:n + len(found)] = size
        self.ids[self.used:self.used + more] = np.fromiter(chain.from_iterable(found), np.uint32, more)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.used += more
        self.bytes += sum(map(len, pieces))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin; a text that holds an added token is one piece."""
        starts, raw, whole = piece_starts(data, offsets), memoryview(data).tobytes() if self.added else b"", set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        for text in whole:
            a, b = np.searchsorted(starts, (offsets[text] + 1, offsets[text + 1]))
            starts = np.delete(starts, slice(a, b))
        return starts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids) for texts that lie at `offsets` of the UTF-8 bytes `data`."""
        starts = self.starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        _, where, raw = coded.dictionary.buffers()
        where, raw = np.frombuffer(where, np.int64)[:len(coded.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
        pieces = [raw[a:b] for a, b in zip(where, where[1:])]
        if len(self.known) > KEPT or self.bytes > KEPT_BYTES:
            self.forget()
        row = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.known) + np.arange(len(new))
            self.learn([pieces[i] for i in new.tolist()])
        row = row[coded.indices.to_numpy()]
        size = self.size[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[row] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets)]


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after those of every text, and their bounds."""
    out = np.full(len(ids) + len(bounds) - 1, end_id, np.dtype("<u4"))
    out[np.arange(len(ids)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = ids
    return out, bounds + np.arange(len(bounds))


def encoder(path: str) -> Encoder:
    """One per worker process, until the worker turns to something else."""
    turn_to(path, _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
