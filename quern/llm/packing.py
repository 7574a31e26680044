"""Packing token sequences into windows by multiway differencing.

Each task packs the documents of its own partition, so nothing is shuffled.  Documents wait in small groups until their
ids fill ``k`` windows; what is more stays for the next group.  A group is packed by the method of Karmarkar and Karp:
every piece begins as a partial partition of ``k`` windows, the two partial partitions with the largest spread are merged
so that the fullest window of one meets the emptiest of the other, until one is left with near-equal windows.

A window of more than the capacity is not cut short there: what is over is cut off its largest piece, the cut becomes a
piece of its own, and the group is differenced again, so that small pieces settle what large ones left unequal.  If that
does not end, the number of windows rises.  Windows are written as differencing gives them.  The last ids of a partition,
fewer than a window, become windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from .tokens import encode_batch

ROUNDS = 24  # tries before the number of windows rises
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` groups of near-equal sums of the positions of ``sizes``, by the largest differencing method."""
    # A partial partition is k pairs (sum, members) in descending order; members are nested pairs until the end.
    idle: list[tuple[int, tuple | int | None]] = [(0, None)] * (k - 1)
    heap = [(-size, i, [(size, i), *idle]) for i, size in enumerate(sizes)]
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    tick = len(sizes)
    total = itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        # Both are in descending order, so opposing imbalances meet.
        met = [(x + y, n if m is None else m if n is None else (m, n)) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        met.sort(key=total, reverse=True)
        heapq.heapreplace(heap, (met[-1][0] - met[0][0], tick, met))
        tick += 1
    groups = []
    for _, tree in heap[0][2]:
        leaves, todo = [], [] if tree is None else [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                leaves.append(x)
        groups.append(leaves)
    return groups


Piece = tuple[int, int, int]  # document's place in the batch list, first id, number of ids


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of positions none of which exceeds ``capacity``; the number of windows rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity or k >= len(sizes):
            return [g for g in groups if g]
        k += 1


def filled_windows(pieces: list[Piece], k: int, capacity: int, rounds: int = ROUNDS) -> list[list[Piece]]:
    """``k`` windows of ``pieces`` as differencing gives them, none above ``capacity``, or more windows if that takes more.

    After each try, what a window has above the capacity is cut off its largest piece.  Every ``rounds`` tries the number
    of windows rises by one, so that this ends: cuts only make pieces smaller.
    """
    pieces, tries = list(pieces), 0
    while True:
        groups = differencing([p[2] for p in pieces], k)
        over = [(g, n) for g in groups if (n := sum(pieces[i][2] for i in g) - capacity) > 0]
        if not over:
            return [[pieces[i] for i in g] for g in groups if g]
        for group, n in over:
            i = max(group, key=lambda j: pieces[j][2])
            doc, first, length = pieces[i]
            n = min(n, length - 1) or 1
            pieces[i] = (doc, first, length - n)
            pieces.append((doc, first + length - n, n))
        pieces = [p for p in pieces if p[2]]
        tries += 1
        k += tries % rounds == 0


def in_order(window: list[Piece]) -> list[Piece]:
    """Pieces by document and place; those that lie next to each other in one document are one piece."""
    out: list[Piece] = []
    for doc, first, n in sorted(window):
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == first:
            out[-1] = (doc, out[-1][1], out[-1][2] + n)
        else:
            out.append((doc, first, n))
    return out


def take_ids(pieces: list[Piece], wanted: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``wanted`` ids of ``pieces``, and the rest; a piece is cut where the border falls."""
    taken, rest = [], []
    for doc, first, n in pieces:
        here = min(n, wanted)
        taken += [(doc, first, here)] * (here > 0)
        rest += [(doc, first + here, n - here)] * (n > here)
        wanted -= here
    return taken, rest


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_windows: int = 16, whole: bool = False) -> DataFrame:
    """Pack every text of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row for each piece of a document: where it begins in the document, its length, a checksum of its ids, the ids
    of the whole document, its sequence, and where in that sequence it lies.  A sequence of fewer than ``capacity`` ids
    that is no power of two long is to be padded; it only occurs where the number of windows of a group had to rise.  A
    null text is empty, so its end id alone is packed.  Rows that share a doc_id (or have none) are packed as documents
    of their own.  A text of any length is one document, cut into pieces of at most ``capacity``.  No rows: no pieces.
    Sequence ids are unique, not dense: the task is in their upper half.

    With ``whole``, documents are cut at multiples of ``capacity`` only, and the number of windows of a group rises
    instead, so sequences have gaps at their ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 32
        docs_held: list[tuple[int | None, np.ndarray]] = []
        open_pieces: list[Piece] = []
        out: list[tuple] = []
        waiting = 0

        def emit(windows: list[list[Piece]]) -> None:
            nonlocal next_id
            for w in windows:
                offset = 0
                for doc, first, n in in_order(w):
                    doc_id, ids = docs_held[doc]
                    out.append((doc_id, first, n, zlib.crc32(ids[first : first + n].tobytes()), len(ids), next_id, offset))
                    offset += n
                next_id += 1

        def close_group(k: int) -> None:
            nonlocal open_pieces, docs_held, waiting
            if whole:
                now, rest = open_pieces, []
                emit([[now[i] for i in g] for g in balanced_windows([p[2] for p in now], capacity)])
            else:
                now, rest = take_ids(open_pieces, k * capacity)
                emit(filled_windows(now, k, capacity))
            kept = sorted({p[0] for p in rest})
            place = {d: i for i, d in enumerate(kept)}
            docs_held = [docs_held[d] for d in kept]
            open_pieces = [(place[d], first, n) for d, first, n in rest]
            waiting = sum(p[2] for p in open_pieces)

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

        for batch in batches:
            for part in K.text_slices(batch):
                ids, offsets = encode_batch(tokenizer, part, end_id)
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    docs_held.append((doc_id, ids[a:b].astype("<u4")))
                    doc, n = len(docs_held) - 1, b - a
                    open_pieces += [(doc, first, min(capacity, n - first)) for first in range(0, n, capacity)]
                    waiting += n
                    while waiting >= group_windows * capacity:
                        close_group(group_windows)
                if out:
                    yield rows()
        if waiting >= capacity or (whole and waiting):
            close_group(waiting // capacity)
        while open_pieces:  # less than one window is left
            window, open_pieces = take_ids(open_pieces, 1 << (sum(p[2] for p in open_pieces).bit_length() - 1))
            emit([window])
        if out:
            yield rows()

    return K.documents_of(docs).mapInArrow(run, PIECE_SCHEMA)
