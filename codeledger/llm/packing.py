"""Packing by sum of squares: documents go into windows so that few windows stay partly filled."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import encoder, ship_package, steps

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: A partition's index stands above this bit of a sequence id, the sequence's number in it below.
PARTITION_BIT = 40

# A piece: the document, its ids before the piece, the piece's ids, all ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Open windows by fill level; a new piece goes where the sum of squared counts grows least.

    ``count[h]`` is the number of open windows with ``h`` ids. Moving a window from level h to
    level h + n changes the sum of squares by 2 * (count[h + n] - count[h] + 1); a window that
    becomes full leaves the sum, one that is opened enters it. Of equal levels the fullest counts.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level(self, n: int) -> int:
        """The fill level that takes a piece of n ids; 0: a new window."""
        count, top = self.count, self.window - n
        cost = 2 * (count[n:] - count[: top + 1] + 1)
        cost[top] = 1 - 2 * count[top]
        cost[count[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * count[n] + 1 if n < self.window else 0
        return top - int(cost[::-1].argmin())

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put the piece, shorter than a window, into one; returns the window if that fills it."""
        n = len(piece[2])
        at = self.level(n)
        if at:
            pieces = self.open[at].pop()
            self.count[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + n == self.window:
            return pieces
        self.open[at + n].append(pieces)
        self.count[at + n] += 1
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """What is left at the end: the emptiest windows are cut up to fill the fullest ones.

        The last ids, fewer than a window, become sequences of a power of two each, so nothing is padded.
        """
        left = [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]
        whole = [piece for pieces in left for piece in pieces]
        total = sum(len(piece[2]) for piece in whole)
        if not total:
            return
        take, fills = [], [sum(len(piece[2]) for piece in pieces) for pieces in left]
        first, last = 0, len(left) - 1
        source: list[Piece] = []
        while first <= last:
            pieces, need = left[first], self.window - fills[first]
            first += 1
            while need and (source or first <= last):
                if not source:
                    source, last = left[last][::-1], last - 1
                doc, start, ids, n = source.pop()
                pieces.append((doc, start, ids[:need], n))
                if len(ids) > need:
                    source.append((doc, start + need, ids[need:], n))
                need -= min(need, len(ids))
            if need:
                take = pieces
            else:
                yield pieces
        take = [*take, *source[::-1]]
        for bit in range(self.window.bit_length(), -1, -1):
            if sum(len(piece[2]) for piece in take) & (1 << bit):
                now, need = [], 1 << bit
                while need:
                    doc, start, ids, n = take.pop(0)
                    now.append((doc, start, ids[:need], n))
                    if len(ids) > need:
                        take.insert(0, (doc, start + need, ids[need:], n))
                    need -= min(need, len(ids))
                yield now


def windows(documents: Iterable[tuple[int | None, np.ndarray]], window: int) -> Iterator[list[Piece]]:
    """The sequences of a stream of (document, ids): full windows of long documents, the rest by sum of squares."""
    levels = SumOfSquares(window)
    for doc, ids in documents:
        full = len(ids) // window * window
        for start in range(0, full, window):
            yield [(doc, start, ids[start : start + window], len(ids))]
        if full < len(ids):
            # A copy, as a view would keep the whole document while its tail waits.
            filled = levels.place((doc, full, ids[full:].copy(), len(ids)))
            if filled:
                yield filled
    yield from levels.rest()


def _packed(batches: Iterable[pa.RecordBatch], tokenizer: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known, end = encoder(tokenizer), np.array([end_id], "<u4")
    sequence = TaskContext.get().partitionId() << PARTITION_BIT

    def documents():
        for batch in steps(batches, "text"):
            yield from zip(batch.column("doc_id").to_pylist(), (np.concatenate([ids, end]) for ids in known.encode(batch.column("text").to_pylist())), strict=True)

    rows: list[tuple] = []
    for pieces in windows(documents(), window):
        offset = 0
        for doc, start, ids, n in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))
            offset += len(ids)
        sequence += 1
        if len(rows) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_ARROW)


def pack(documents: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Documents packed into sequences of at most ``window`` ids, one row per piece.

    A document's ids are those of its text by ``tokenizer`` (null or empty text: none) and then
    ``end_id``. Documents of a window or more are cut into full windows; what remains goes where
    the sum of squared counts of partly filled windows is least. Each task packs the rows of its
    own partition in their order, without a shuffle, and keeps only partly filled windows in
    memory. At its end it cuts the emptiest of them to fill the others; its last ids, fewer than
    a window, make sequences of a power of two each. So no sequence needs padding.

    Only the columns doc_id and text are read. Repeated rows and null ids are packed like any
    other; an empty table gives no row. Sequence ids are unique, not dense.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_packed, tokenizer=tokenizer, window=window, end_id=end_id), SCHEMA)
