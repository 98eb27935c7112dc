"""Packing of documents into fixed windows by the online sum-of-squares rule.

A document longer than a window first fills whole windows of its own; its rest
is an item. Each item goes, in order of arrival, to the fill level for which
the sum over levels of (number of windows at that level) squared gets smallest;
level 0 is a new window. The numbers are kept in one array by level. The rule
keeps the levels evenly used, so that windows close exactly full. An item may
also be cut, which closes a window and leaves a smaller item; that counts as
the sum of squares it leads to and CUT more. Where sizes fit each other no item
is cut; where they don't (all of them just over half a window) levels fill up
until cutting is the lesser sum, so the open windows stay few for any sizes.

Each task packs the documents of its own partition: nothing is shuffled. At
its end the pieces of the emptiest windows go, by the same rule, to the others,
cut only where none of them takes the whole, until a task has no more windows
than its ids need. Tasks have LEAST_ROWS documents or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.llm.common import slices, tokenizer_file, word_encoder

WINDOW = 2048
END = 1
#: Documents of a task at least, while there are as many; the windows open at its end are a smaller share of a larger task.
LEAST_ROWS = 4096
#: What cutting a piece adds to the sum of squares, so that levels with some CUT / 4 windows are emptied by cutting.
CUT = 16
#: The same at the end, when a piece is cut only if nothing else is possible; and the sum of what cannot be.
FIT, NONE = 1 << 30, 1 << 40
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: A piece: doc_id, position of its first id, its ids (little-endian, 4 bytes each), tokens of its document.
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Windows of one task. `closed` takes the rows of the windows that are done, `cuts` counts pieces that were cut."""

    def __init__(self, window: int, first_sequence: int, cut: int = CUT) -> None:
        self.window, self.cut = window, cut
        self.count = np.zeros(window + 1, np.int64)  # open windows by level; levels 0 and `window` stay 0
        self.at_level: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.sequence = first_sequence
        self.cuts = 0
        self.closed: list[tuple] = []

    def place_for(self, size: int, anew: bool = True, cut: int | None = None) -> int:
        """The level whose window takes `size` more ids at the least sum of squares; level 0 is a new window (if
        `anew`). Beyond `window - size` the piece is cut: the window closes and the rest counts as a new window."""
        top = self.window - size
        taken = np.where(self.count > 0, 1 - 2 * self.count, NONE)  # that level loses a window
        taken[0] = 0 if anew else NONE
        whole = taken[: top + 1] + 2 * self.count[size:] + 1  # the level reached gets one
        whole[top] -= 2 * self.count[self.window] + 1  # a full window is closed
        parted = taken[top + 1 : self.window] + 2 * self.count[1:size] + 1 + (self.cut if cut is None else cut)
        gain = np.concatenate([whole, parted])[::-1]
        return self.window - 1 - int(gain.argmin())  # on a tie the fuller window

    def close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            self.closed.append((doc_id, start, length, crc32(ids), doc_tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // (4 * self.window) * self.window
        for at in range(0, whole, self.window):
            self.close([(doc_id, at, ids[4 * at : 4 * (at + self.window)], total)])
        if whole < total:
            self.place((doc_id, whole, ids[4 * whole :], total))

    def place(self, piece: Piece, last: bool = False) -> None:
        while True:
            doc_id, start, ids, total = piece
            size = len(ids) // 4
            level = self.place_for(size, False, FIT) if last and self.count.any() else self.place_for(size)
            pieces = self.at_level[level].pop() if level else []
            self.count[level] -= level > 0
            room = self.window - level
            if size < room:
                self.at_level[level + size].append([*pieces, piece])
                self.count[level + size] += 1
                return
            self.close([*pieces, (doc_id, start, ids[: 4 * room], total)])
            if size == room:
                return
            self.cuts += 1
            piece = (doc_id, start + room, ids[4 * room :], total)

    def finish(self) -> None:
        """Place the pieces of the emptiest window into the others by the same rule, cut only where none of them
        takes the whole, until there are no more windows than their ids need."""
        levels = np.arange(self.window + 1)
        while self.count.sum() > -(-int(levels @ self.count) // self.window):
            level = int(np.argmax(self.count > 0))
            self.count[level] -= 1
            for piece in sorted(self.at_level[level].pop(), key=lambda p: -len(p[2])):
                self.place(piece, last=True)
        for pieces in (w for level in self.at_level for w in level):
            self.close(pieces)
        self.count[:] = 0

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.closed, strict=True)) or [()] * 7
        self.closed = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece of a document: its place in the document and in its window (`sequence_id`, `offset`).

    A document is its ids and `end`; a null text counts as empty and is one id.
    Every row of `docs` is packed by itself, equal ones too; a null doc_id stays
    null; other columns are not read; an empty table gives no rows. Texts of
    any length are cut into as many windows as they need. `sequence_id` is
    unique over the table and carries the partition in its upper bits, so a task that
    is run again gives the same rows. Tables of fewer than twice LEAST_ROWS documents are one task.
    """
    file = tokenizer_file(docs.sparkSession, tokenizer)
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(file.value)
        windows = SumOfSquares(window, TaskContext.get().partitionId() << 36)
        for rows in slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                windows.add(doc_id, encode(text) + tail)
            yield windows.rows()
        windows.finish()
        yield windows.rows()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.coalesce(max(1, docs.count() // LEAST_ROWS)).mapInArrow(run, SCHEMA)
