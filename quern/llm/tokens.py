"""Exact tokenisation of whole texts with the tokenizers library, at a cost that follows distinct words.

Both public vocabularies split a text before they merge bytes, and no merge crosses a white-space boundary.  A text is
therefore the sequence of its units (white space and the word behind it), and the ids of a text are the ids of its
units one after another.  A task encodes each distinct unit once, through the library, and assembles texts with numpy.
A cut is made only before ASCII white space behind a character that is certainly not white space, so units are safe for
the Unicode white space rules of the split patterns too.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import kernels as K

_WHITE = ~K.SPACED
MARK = "\x01"


class HashIndex:
    """64-bit keys to row numbers in an open-addressing table; look-ups and inserts take whole arrays."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._allocate(bits)

    def _allocate(self, bits: int) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        rows = self.rows[slot]
        same = (self.keys[slot] == keys) & (rows >= 0)
        out[same] = rows[same]
        open_ = np.flatnonzero(~same & (rows >= 0))
        slot, keys = slot[open_], keys[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            rows = self.rows[slot]
            same = (self.keys[slot] == keys) & (rows >= 0)
            out[open_[same]] = rows[same]
            on = ~same & (rows >= 0)
            open_, slot, keys = open_[on], slot[on], keys[on]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give distinct keys that are not held the next row numbers."""
        rows = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if self.n * 10 > len(self.keys) * 6:
            held = self.rows >= 0
            old = self.keys[held], self.rows[held]
            self._allocate(max(12, int(self.n * 2.2).bit_length()))
            self._place(*old)
        self._place(keys, rows)
        return rows

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[free]  # of several for a slot one stays
            done = self.rows[slot] == rows
            self.keys[slot[done]] = keys[done]
            slot, keys, rows = (slot[~done] + 1) & self.mask, keys[~done], rows[~done]


def _table(keep: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(keep.encode(), np.uint8))


LETTER = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
POINT = _table("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # ASCII punctuation but the apostrophe, with which contractions begin


class UnitEncoder:
    """Token ids of texts, with the ids of the units met so far kept up to ``most`` units."""

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        plain = self.tokenizer.encode("a", add_special_tokens=False).ids
        self.lower_words = self.tokenizer.normalizer is not None
        self.mark = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids[len(plain) : -len(plain)]
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)  # each character of a byte-level token stands for one byte
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex(14)
        self.ids = np.zeros(1 << 12, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 12, np.int64)
        self.n_ids = np.zeros(1 << 12, np.int32)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> K.Words:
        """Byte ranges that can be encoded one by one, and that hold all but white space without an id."""
        n = len(data)
        if self.lower_words:
            data = K.LOWER[data]
        cut = np.zeros(n + 1, bool)
        if n:
            letter, point, white = LETTER[data], POINT[data], _WHITE[data]
            cut[1:n] = (letter[1:] & point[:-1]) | (point[1:] & letter[:-1])
            if not self.lower_words:
                here = white[1:] & ~white[:-1]
                high = np.flatnonzero(here & (data[:-1] >= 0x80)) + 1  # the character before may be wide white space
                two, three = data[high - 2], data[high - 3]
                risky = ((high >= 2) & (two == 0xC2)) | ((high >= 3) & (three >= 0xE1) & (three <= 0xE3))
                here[high[risky] - 1] = False
                cut[1:n] |= here
        cut[offsets] = True
        if self.lower_words:  # white space has no ids: units are what lies between
            solid = ~white if n else np.zeros(0, bool)
            start = np.flatnonzero(solid & (cut[:n] | np.concatenate([[True], ~solid[:-1]])[:n]))
            end = np.flatnonzero(solid & (cut[1:] | np.concatenate([~solid[1:], [True]])[:n])) + 1
        else:
            start = np.flatnonzero(cut[:n])
            end = np.append(start[1:], n)[: len(start)]
        return K.Words(data, start, end, np.searchsorted(start, offsets))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the n + 1 offsets of each text's ids."""
        units = self.units(data, offsets)
        keys = units.hashes()
        rows = self.index.find(keys)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            if self.index.n + len(fresh) > self.most:
                self._reset()
                fresh = np.arange(len(keys))
            new, first = np.unique(keys[fresh], return_index=True)
            self._learn(units, new, fresh[first])
            rows = self.index.find(keys)
        counts = self.n_ids[rows].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.at[rows] - (ends - counts), counts) + np.arange(total)
        return self.ids[where], np.concatenate([np.zeros(1, np.int64), ends])[units.first]

    def _learn(self, units: K.Words, keys: np.ndarray, at: np.ndarray) -> None:
        rows = self.index.add(keys)
        start, end, data = units.start[at], units.end[at], units.data
        if self.lower_words:
            marks = np.concatenate([[0], np.cumsum(data == ord(MARK))])
            fits = marks[end] == marks[start]
        else:
            last, two = data[end - 1], data[np.maximum(end - 2, 0)]
            fits = _WHITE[data[start]] & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (two >= 0xC3) & (two <= 0xDF) & (end - start > 2)))
        while self.index.n > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
            self.n_ids = np.concatenate([self.n_ids, np.zeros(len(self.n_ids), np.int32)])
        left = [np.flatnonzero(~fits)]
        fits = np.flatnonzero(fits)
        for k in range(0, len(fits), 512):
            part = fits[k : k + 512]
            if (got := self._encode_joined(data, start[part], end[part])) is None:
                left.append(part)
            else:
                self._keep(rows[part], *got)
        rest = np.concatenate(left)
        if len(rest):
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(rows[rest], np.concatenate(each), np.array([len(e) for e in each], np.int64))

    def _keep(self, rows: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[rows] = self.used + np.cumsum(counts) - counts
        self.n_ids[rows] = counts
        self.used += len(flat)

    def _encode_joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units encoded as one text, since a call for each costs more than its merges; None if borders are lost.

        Where white space has no ids, a mark between units gives their borders.  Else each unit begins with white
        space behind what is none, which is a border anyway, and the byte lengths of the ids tell where it lies.
        """
        sizes = end - start
        gap = len(f" {MARK} ") if self.lower_words else 0
        ends = np.cumsum(sizes + gap)
        raw = np.empty(int(ends[-1]), np.uint8)
        if gap:
            raw[:] = np.resize(np.frombuffer(f" {MARK} ".encode(), np.uint8), len(raw))
            for j, byte in enumerate(f" {MARK} ".encode()):
                raw[ends - gap + j] = byte
        into = np.repeat(ends - gap - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
        raw[into] = data[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        ids = np.array(self.tokenizer.encode_batch_fast([raw.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        if gap:
            border = ids == self.mark[0]
            stops = np.flatnonzero(border)
            if len(self.mark) != 1 or len(stops) != len(start):
                return None
            return ids[~border], np.diff(np.concatenate([[-1], stops])) - 1
        reach = np.cumsum(self.width[ids])
        upto = np.searchsorted(reach, ends)
        if not len(reach) or upto[-1] >= len(reach) or not np.array_equal(reach[upto], ends):
            return None
        return ids, np.diff(np.concatenate([[-1], upto]))


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file; it serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def encode_batch(path: str, part: pa.RecordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts, each with ``end_id`` behind it, and their offsets."""
    ids, offsets = encoder(path).encode(*K.text_bytes(part.column("text")))
    n = part.num_rows
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ends = offsets + np.arange(n + 1)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    return out, ends
