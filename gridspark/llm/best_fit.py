"""Best-fit packing (12): bounded-space online best fit.

A task reads its documents a few megabytes at a time, offers the pieces of each such run longest first, and
keeps a fixed number of bins open. The free spaces of the open bins are
a bitset: bit f is set if a bin has f tokens left, so the tightest bin that holds a piece is the lowest set bit
at or above its length. When no bin holds a piece and all may be open, the fullest closes first. Only the free
space of an open bin is kept, never its pieces, so a task's memory does not grow with its input; no document
leaves its task, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import prepare
from gridspark.llm.token_ids import encoder, ended
from gridspark.llm.words import text_chunks

CAPACITY = 2048
#: Bins that a task keeps open.
OPEN = 4096
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """Numbered bins, of which at most `limit` are open."""

    def __init__(self, capacity: int, limit: int, first: int = 0):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free, self.n = 0, 0
        self.bins: dict[int, list[int]] = {}

    def _open(self, bin: int, free: int) -> None:
        self.bins.setdefault(free, []).append(bin)
        self.free |= 1 << free
        self.n += 1

    def _take(self, free: int) -> int:
        """One of the bins with so much free space; it counts as open no more."""
        bin = self.bins[free].pop()
        if not self.bins[free]:
            del self.bins[free]
            self.free ^= 1 << free
        self.n -= 1
        return bin

    def place(self, length: int) -> tuple[int, int]:
        """(bin, place in it) for a piece of 1 to `capacity` tokens: the fullest open bin that holds it, else a new one."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin = self._take(free)
        else:
            if self.n == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            bin, free, self.next = self.next, self.capacity, self.next + 1
        if free > length:
            self._open(bin, free - length)
        return bin, self.capacity - free


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, limit: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document is the ids of `tokenizers` with the JSON file at `path`, without special tokens around them, and
    `end_id`; a null or empty text is that id alone. Only documents of more than `capacity` ids are cut, into
    pieces of `capacity`; the last may be shorter, and all its pieces but that fill a sequence each. Rows repeated
    are packed as often as they occur, pieces of equal length of a run in the order in which they are read, and a null doc_id
    stays null. Other columns are not read. Sequence numbers are unique, not consecutive. No rows give no pieces.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins = encoder(path), OpenBins(capacity, limit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids, bounds = ended(*encode(data, offsets), end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(first, last), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(np.repeat(sizes, pieces) - start, capacity)
                longest = np.argsort(-length, kind="stable")
                placed = np.empty((len(length), 2), np.int64)
                placed[longest] = np.array([bins.place(n) for n in length[longest].tolist()], np.int64).reshape(-1, 2)
                cut = np.append(np.repeat(bounds[:-1], pieces) + start, bounds[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cut.astype(np.int64) * 4), pa.py_buffer(ids)]).cast(pa.binary()),
                     pa.array(placed[:, 0]), pa.array(placed[:, 1])], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES_DDL)
