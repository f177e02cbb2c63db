"""Packing (10): minimum bin slack.

Every document is cut into full windows and one remainder. Each task packs the remainders of its
own documents: a subset-sum programme over bitsets picks the multiset of remaining lengths that
fills the next window closest to its capacity, and its counts are traced back. A window that cannot
be filled exactly waits for more documents until the pool of remainders is full; then, and at a task's
end, a piece is cut to close it. No document leaves its task, so nothing is shuffled, and a task holds
no more than its pool and the texts that it reads at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import prepare
from gridspark.llm.token_ids import encoder, ended
from gridspark.llm.words import text_chunks

CAPACITY = 1024
#: Remainders that a task holds at most; windows are closed by cuts until a quarter of them is left.
POOL = 4096
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """(counts used by length, their sum): the multiset, holding one of the longest, whose sum is closest to `capacity`.

    Bit s of a row is set if sum s can be reached with the lengths so far; equal lengths are added one
    by one until nothing new is reached. The search ends as soon as the capacity itself is reached.
    """
    longest = max(counts)
    room = capacity - longest
    mask, rows, reach = (1 << room + 1) - 1, [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n = min(counts[length] - (length == longest), room // length)
        before = reach
        for _ in range(n):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            reach = more
        rows.append((length, before))
        if reach >> room & 1:
            break
    total = left = reach.bit_length() - 1
    used = {longest: 1}
    for length, before in reversed(rows):
        n = 0
        while not before >> left & 1:
            left, n = left - length, n + 1
        if n:
            used[length] = used.get(length, 0) + n
    return used, longest + total


class Packer:
    """Places (document, start, ids) pieces into numbered sequences."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next = capacity, task << 40
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.n = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            self.place([(doc, at, ids[at:at + self.capacity], len(ids))])
        if whole < len(ids):
            self.waiting[len(ids) - whole].append((doc, whole, ids[whole:].copy(), len(ids)))
            self.n += 1

    def take(self, used: dict[int, int]) -> list[tuple]:
        out = []
        for length in sorted(used, reverse=True):
            queue = self.waiting[length]
            out += [queue.popleft() for _ in range(used[length])]
            if not queue:
                del self.waiting[length]
        self.n -= len(out)
        return out

    def pack(self, left: int = 0) -> None:
        """Closes windows that fill exactly; while more than `left` remainders wait, others are closed by cutting a piece.

        Only when nothing is left to cut from does a window stay short: it is cut at powers of two.
        """
        while self.waiting:
            used, total = best_fill({k: len(v) for k, v in self.waiting.items()}, self.capacity)
            room = self.capacity - total
            if room and self.n <= left:
                return
            chosen = self.take(used)
            if room and self.waiting:
                doc, start, ids, n = self.take({max(self.waiting): 1})[0]
                chosen.append((doc, start, ids[:room], n))
                if room < len(ids):
                    self.waiting[len(ids) - room].append((doc, start + room, ids[room:], n))
                    self.n += 1
            self.place_exact(chosen)

    def place_exact(self, pieces: list[tuple]) -> None:
        """One sequence if the pieces fill a power of two, else one for each power of two in their sum."""
        total = sum(len(p[2]) for p in pieces)
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        queue = deque(pieces)
        for size in [total] if total == self.capacity else sizes:
            part = []
            while size:
                doc, start, ids, n = queue.popleft()
                part.append((doc, start, ids[:size], n))
                if len(ids) > size:
                    queue.appendleft((doc, start + size, ids[size:], n))
                size -= len(part[-1][2])
            self.place(part)

    def flush(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)) or [()] * len(PIECES), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types)], schema=PIECES)


def pack(docs: DataFrame, path: str, pattern: str | None = None, end_id: int = 0, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    `path` is the JSON of `tokenizers`, or a file of ranks with that JSON beside it; the JSON has its own split rule,
    so `pattern` is not read. A document is its ids followed by `end_id`; a null or empty text is that id alone. Rows repeated are
    packed as often as they occur, and a null doc_id stays null. Other columns are not read. Sequence
    numbers are unique, not consecutive.
    """
    prepare(docs.sparkSession)
    path = re.sub(r"\.tiktoken$", ".json", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(path), Packer(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids, bounds = ended(*encode(data, offsets), end_id)
                for doc, a, b in zip(batch.column(0).slice(first, last - first).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    packer.add(doc, ids[a:b])
                    if packer.n >= pool:
                        packer.pack(pool // 4)
                    if len(packer.rows) >= 2048:
                        yield packer.flush()
        packer.pack()
        yield packer.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES_DDL)
