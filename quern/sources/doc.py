"""Texts of .doc files: a compound file's streams, and the piece table that says where the text lies in them."""

from __future__ import annotations

import re

import numpy as np

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR = 0xFFFFFFFA  # numbers from here on end a chain
_SHOWN = {"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-", "\xa0": " "}


def _number(data: bytes, at: int, size: int = 4) -> int:
    if at + size > len(data):
        raise ValueError("the file is cut off")
    return int.from_bytes(data[at : at + size], "little")


def _chain(table: np.ndarray, first: int) -> list[int]:
    """Sectors from the first on; a chain that comes back to itself or leaves the file is an error."""
    out: list[int] = []
    while first < LAST_SECTOR:
        if first >= len(table) or len(out) > len(table):
            raise ValueError("a broken chain of sectors")
        out.append(first)
        first = int(table[first])
    return out


class CompoundFile:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no compound file")
        self.data, self.size = data, 1 << _number(data, 30, 2)
        if self.size not in (512, 4096):
            raise ValueError("unknown size of sectors")
        _number(data, 76 + 4 * 108)  # else cut off
        places = np.frombuffer(data, "<u4", 109, 76).tolist()
        more, seen = _number(data, 68), 0
        while more < LAST_SECTOR and seen <= len(data) // self.size:
            held = np.frombuffer(self.sector(more), "<u4")
            places += held[:-1].tolist()
            more, seen = int(held[-1]), seen + 1
        self.table = np.frombuffer(b"".join(self.sector(p) for p in places if p < LAST_SECTOR), "<u4")
        small = self.joined(_number(data, 60))
        self.small_table = np.frombuffer(small[: len(small) // 4 * 4], "<u4")
        self.cutoff, entries = _number(data, 56), self.joined(_number(data, 48))
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            entry, width = entries[at : at + 128], _number(entries, at + 64, 2)
            if entry[66] in (2, 5) and 2 <= width <= 64:
                self.entries[entry[: width - 2].decode("utf-16-le", "replace") if entry[66] == 2 else ""] = (_number(entry, 116), _number(entry, 120))
        start, length = self.entries.get("", (LAST_SECTOR, 0))
        self.small = self.joined(start)[:length]

    def sector(self, number: int) -> bytes:
        found = self.data[(number + 1) * self.size : (number + 2) * self.size]
        if not found:
            raise ValueError("a sector outside of the file")
        return found.ljust(self.size, b"\0")

    def joined(self, first: int) -> bytes:
        return b"".join(self.sector(s) for s in _chain(self.table, first))

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ValueError(f"no stream {name}")
        first, length = self.entries[name]
        if length >= self.cutoff:
            return self.joined(first)[:length]
        return b"".join(self.small[s * 64 : s * 64 + 64] for s in _chain(self.small_table, first))[:length]


def document_text(raw: bytes) -> str:
    """The main text of a .doc file: a line for each paragraph that is not blank; of fields, what they show."""
    held = CompoundFile(raw)
    head = held.stream("WordDocument")
    if _number(head, 0, 2) != 0xA5EC:
        raise ValueError("no document")
    flags = _number(head, 10, 2)
    if flags & 0x100:
        raise ValueError("the file is encrypted")
    table = held.stream("1Table" if flags & 0x200 else "0Table")
    at, size, wanted = _number(head, 0x1A2), _number(head, 0x1A6), _number(head, 0x4C)
    end = at + size
    while at < end and _number(table, at, 1) == 1:  # formats come before the piece table
        at += 3 + _number(table, at + 1, 2)
    if at >= end or _number(table, at, 1) != 2:
        raise ValueError("no piece table")
    n = (_number(table, at + 1) - 4) // 12
    borders = [_number(table, at + 5 + 4 * i) for i in range(n + 1)]
    parts = []
    for i in range(n):
        place = _number(table, at + 5 + 4 * (n + 1) + 8 * i + 2)
        count = min(borders[i + 1], wanted) - borders[i]
        if count <= 0:
            break
        start, narrow = place & 0x3FFFFFFF, place & 0x40000000
        piece = head[start // 2 : start // 2 + count] if narrow else head[start : start + 2 * count]
        if len(piece) < (count if narrow else 2 * count):
            raise ValueError("a piece outside of the file")
        parts.append(piece.decode("cp1252" if narrow else "utf-16-le", "replace"))
    text = "".join(parts)
    while (shorter := re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)) != text:
        text = shorter
    text = re.sub("[\x00-\x06\x08\x0e-\x1d\x1f]", "", text)
    for mark, shown in _SHOWN.items():
        text = text.replace(mark, shown)
    return "\n".join(line.strip() for line in text.split("\n") if line.strip())


def made_doc(paragraphs: list[str], wide: bool = False, pieces: int = 3) -> bytes:
    """A small .doc file of paragraphs, by which the reader is tried; the text is cut into pieces, and every second one is
    narrow where its characters allow it, unless all are ``wide``."""
    text = "".join(p + "\r" for p in paragraphs)
    step = max(1, -(-len(text) // pieces))
    head, places = bytearray(0x600), []
    borders = list(range(0, len(text), step)) + [len(text)] if text else [0]
    for i, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
        try:
            if wide or i % 2:
                raise UnicodeEncodeError("cp1252", "", 0, 1, "wide")
            raw, place = text[a:b].encode("cp1252"), len(head) * 2 | 0x40000000
        except UnicodeEncodeError:
            raw, place = text[a:b].encode("utf-16-le"), len(head)
        places.append(place)
        head += raw
    # A character beyond 16 bits takes two places; borders count those.
    table = b"\x01\x02\x00xx\x02" + (4 * len(borders) + 8 * len(places)).to_bytes(4, "little") + b"".join(b.to_bytes(4, "little") for b in borders)
    table += b"".join(b"\0\0" + p.to_bytes(4, "little") + b"\0\0" for p in places)
    for at, value, size in ((0, 0xA5EC, 2), (10, 0x200, 2), (0x4C, len(text), 4), (0x1A2, 0, 4), (0x1A6, len(table), 4)):
        head[at : at + size] = value.to_bytes(size, "little")
    head = bytes(head).ljust(4096, b"\0")
    sectors: list[bytes] = []
    links: list[int] = []

    def put(raw: bytes) -> int:
        first = len(sectors)
        for k in range(0, len(raw), 512):
            sectors.append(raw[k : k + 512].ljust(512, b"\0"))
            links.append(len(sectors))
        links[-1] = 0xFFFFFFFE
        return first

    small = len(table) < 4096
    main = put(head)
    other = put(table)
    blocks = -(-len(table) // 64)
    small_links = put(b"".join((i + 1 if i < blocks - 1 else 0xFFFFFFFE).to_bytes(4, "little") for i in range(blocks))) if small else 0xFFFFFFFE

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + len(raw).to_bytes(2, "little") + bytes([kind, 1]) + b"\xff" * 12 + bytes(36) + first.to_bytes(4, "little") + size.to_bytes(8, "little")

    root = entry("Root Entry", 5, other if small else 0xFFFFFFFE, len(table) if small else 0)
    listed = put(root + entry("WordDocument", 2, main, len(head)) + entry("1Table", 2, 0 if small else other, len(table)) + bytes(128))
    n_table = 1
    while (len(sectors) + n_table) * 4 > n_table * 512:
        n_table += 1
    first_table = len(sectors)
    links += [0xFFFFFFFD] * n_table
    links += [0xFFFFFFFF] * (n_table * 128 - len(links))
    raw = b"".join(x.to_bytes(4, "little") for x in links)
    sectors += [raw[k : k + 512] for k in range(0, len(raw), 512)]
    out = bytearray(512)
    out[:8] = MAGIC
    fields = [(24, 0x3E, 2), (26, 3, 2), (28, 0xFFFE, 2), (30, 9, 2), (32, 6, 2), (44, n_table, 4), (48, listed, 4), (56, 4096, 4), (60, small_links, 4), (64, int(small), 4), (68, 0xFFFFFFFE, 4)]
    for at, value, size in fields + [(76 + 4 * i, first_table + i if i < n_table else 0xFFFFFFFF, 4) for i in range(109)]:
        out[at : at + size] = value.to_bytes(size, "little")
    return bytes(out) + b"".join(sectors)
