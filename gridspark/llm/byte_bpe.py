"""Byte-level BPE (2): recursive DuckDB queries inside each partition.

A word (one match of the split pattern) is a set of rows, one per token position. Each turn of the
recursive query joins neighbouring rows with the merge table and contracts the leftmost pair of
least rank in every word, until no word has a pair left. Words that a worker has seen lately are
not asked again. Decoding takes the vocabulary's pieces by their ids, in order, in Arrow.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import prepare, turn_to
from gridspark.llm.words import cuts

#: Words per recursive query and their bytes, and words kept in each of the two halves of a worker's memory.
BATCH, BYTES, KEPT = 60_000, 1 << 20, 400_000
#: The recursive query takes a turn per merge over all of a word, so longer words (in bytes) are merged in a heap.
LONG = 256
#: Characters that are split at a time (one text at least), and tokens that are decoded at a time, whatever texts they are of.
CHARS, TOKENS = 1 << 21, 1 << 19

# A pair is one number: rank, then its position, then the position of its right half (each below 1024).
ENCODE = """
WITH RECURSIVE step(word, pos, token, done) AS (
    SELECT word, pos, token, false FROM start
    UNION ALL
    SELECT word, pos, CASE WHEN pos = ((best >> 10) & 1023) THEN (best >> 20)::INT ELSE token END, best IS NULL
    FROM (SELECT p.word, p.pos, p.token, min((m.rank::BIGINT << 20) | (p.pos << 10) | p.next_pos) OVER (PARTITION BY p.word) AS best
          FROM (SELECT word, pos, token, lead(token) OVER w AS next, lead(pos) OVER w AS next_pos FROM step WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON m.a = p.token AND m.b = p.next)
    WHERE best IS NULL OR pos <> (best & 1023)
)
SELECT word, pos, token FROM step WHERE done ORDER BY word, pos
"""

_loaded: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Ranks of a file, its merges in DuckDB's memory; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(left, right, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                  if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, rank = (pa.array(c, pa.int32()) for c in zip(*merges))
        self._store("merges", pa.table({"a": a, "b": b, "rank": rank}))
        # the last piece is that of ids outside the vocabulary
        pieces = [b""] * (max(self.ranks.values()) + 2)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())
        self.cost = 1 + np.array([len(t) // 32 for t in pieces])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _store(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers, by the recursive query."""
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        start = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": (np.arange(size.sum()) - np.repeat(first, size)).astype(np.int32),
                          "token": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        self.db.register("start", start)
        out = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start")
        word, token = np.asarray(out["word"]), np.asarray(out["token"]).astype("<i4").tobytes()
        ends = np.searchsorted(word, np.arange(len(words)), "right") * 4
        return [token[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]

    def merge_long(self, word: bytes) -> bytes:
        """The same contraction for one long word: a heap of (rank, position) over linked positions."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n

        def pair(i: int):
            j = end[i]
            return ranks.get(word[i:end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or pair(i) != rank:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        return np.array([ranks[word[i:end[i]]] for i in range(n) if alive[i]], "<i4").tobytes()

    def known(self, words: set[str]) -> dict[str, bytes]:
        """Makes sure that every word is in the young half of the memory, and returns that half."""
        if len(self.young) + len(words) > KEPT:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for word in words - young.keys():
            ids = old.get(word)
            if ids is not None:
                young[word] = ids
                continue
            raw = word.encode()
            if raw in self.ranks:
                young[word] = int(self.ranks[raw]).to_bytes(4, "little")
            elif len(raw) > LONG:
                young[word] = self.merge_long(raw)
            else:
                new.append((word, raw))
        # a word costs its share of either limit, whichever is more
        cost = np.array([max(BYTES // BATCH, len(raw)) for _, raw in new], np.int64)
        for a, b in cuts(cost, BYTES):
            part = new[a:b]
            young.update(zip((w for w, _ in part), self.merge([r for _, r in part])))
        return young

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        ids = self.known(set().union(*split))
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list. About TOKENS positions are taken at a time, so a long list is joined from several."""
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, len(self.pieces) - 1)
        out: list[list[bytes]] = [[] for _ in range(len(lists))]
        # long tokens count more than once, which bounds the bytes that are taken at a time as well
        for a, b in cuts(self.cost[ids], TOKENS):
            _, where, data = self.pieces.take(pa.array(ids[a:b])).buffers()
            where, data = np.frombuffer(where, np.int64), memoryview(data)
            first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b)
            at = where[np.clip(ends[first:last + 1], a, b) - a].tolist()
            for i, x, y in zip(range(first, last), at, at[1:]):
                out[i].append(bytes(data[x:y]))
        return [b"".join(parts) for parts in out]


def vocabulary(path: str, pattern: str) -> Vocabulary:
    turn_to(path, _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Vocabulary(path, pattern)
    return _loaded[path]


def _lists(ids: list[bytes]) -> pa.ListArray:
    where = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(where), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, special tokens read as text; a null text is empty.

    Of pairs with the least rank in a word the leftmost is merged first. A very long text is a query's words of its own,
    asked in bounded batches. Rows repeated and null doc_ids stay as they are; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for a, b in cuts(pc.utf8_length(batch.column(1)).to_numpy(), CHARS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(words.encode(part.column(1).to_pylist()))], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; a null list is empty. An id outside the vocabulary has none."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for a, b in cuts(np.diff(batch.column(1).offsets.to_numpy()), TOKENS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.decode(part.column(1)), pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
