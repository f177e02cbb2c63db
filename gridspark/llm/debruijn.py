"""Substring dedup (5): compaction of the de Bruijn graph of the words.

An edge is a window of `k` words, a k-mer. Consecutive edges that share the least run of about k/3
words, the seed, lie on one path without leaving its neighbourhood, and are compacted into one row: its seed,
a cryptographic digest of all its words, its source document and position. Paths that occur at least twice
repeat as a whole. Paths that share a seed with another but differ branch somewhere; only those
are unfolded, at their source coordinates, into edges, which are counted one by one. Every edge
belongs to the path of one seed, so equal edges always meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import Scratch
from gridspark.llm.words import Words, mix, text_chunks, windows

#: Words in a window.
K = 35
PATHS_DDL = "id long, tag binary, start int, edges int, seed long, path long"
EDGES_DDL = "seed long, edge long, n long, id long, tag binary, start int"
_KEY = ["id", "tag"]
_NO_ID = -(1 << 63)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least key among each `width` consecutive ones."""
    at, have = np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(keys[right] < keys[left], right, left)
        have += step
    return at


def digests(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cryptographic digest of the words themselves in each start:end, joined by one space."""
    raw, begins, ends = words.data.tobytes(), words.start[start].tolist(), words.end[end - 1].tolist()
    found = b"".join(blake2b(b" ".join(raw[a:b].split()), digest_size=8).digest() for a, b in zip(begins, ends))
    return np.frombuffer(found, "<u8").astype(np.uint64)


def paths_of(words: Words, k: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, edges, seed, path hash) of every compacted path."""
    short = k - k // 3 * 2
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(words) < k:
        return none
    hashes = words.hashes()
    keys = windows(hashes, short)
    at = _least(keys, k - short + 1)
    valid = words.left()[: len(at)] >= k
    begin = valid.copy()
    begin[1:] &= ~(valid[:-1] & (at[1:] == at[:-1]) & (words.doc[1:len(at)] == words.doc[: len(at) - 1]))
    start = np.flatnonzero(begin)
    if not len(start):
        return none
    edges = np.add.reduceat(valid.astype(np.int64), start)
    # a stretch without edges between two paths belongs to none: reduceat adds zeros there
    seed = keys[at[start]]
    path = digests(words, start, start + edges + k - 1) ^ mix((at[start] - start).astype(np.uint64), 2)
    text = words.doc[start]
    return text, start - words.first[text], edges, seed, path


def _paths(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1)
            for row, end, data, offsets in text_chunks(batch.column(2)):
                text, start, edges, seed, path = paths_of(Words(data, offsets), k)
                text = text + row
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[text]), "tag": tags.take(pa.array(text)), "start": pa.array(start.astype(np.int32)),
                    "edges": pa.array(edges.astype(np.int32)), "seed": pa.array(seed.view(np.int64)), "path": pa.array(path.view(np.int64))})

    return run


def _unfold(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1)
            lists = batch.column(3)
            flat, where = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            starts, edges, seeds, counts = (flat.field(n).to_numpy() for n in ("start", "edges", "seed", "n"))
            for row, end, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                a, b = where[row], where[end]
                text = np.repeat(np.arange(end - row), np.diff(where[row:end + 1]))
                n = edges[a:b].astype(np.int64)
                which = np.repeat(np.arange(b - a), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = starts[a:b][which] + step
                begin = words.first[text[which]] + at
                edge = digests(words, begin, begin + k)
                own = text[which] + row
                yield pa.RecordBatch.from_pydict({
                    "seed": pa.array(seeds[a:b][which]), "edge": pa.array(edge.view(np.int64)), "n": pa.array(counts[a:b][which]),
                    "id": pa.array(ids[own]), "tag": tags.take(pa.array(own)), "start": pa.array(at.astype(np.int32))})

    return run


def _cut(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for doc, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    words = (text.as_py() or "").encode().split()
                    if found.is_valid and len(found):
                        flat = found.values
                        begin = flat.field("start").to_numpy()
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + flat.field("edges").to_numpy() + k - 1, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        kept = b" ".join(compress(words, ~gone))
                        rows.append((doc, len(words), int(gone.sum()), kept, [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]))
                    else:
                        rows.append((doc, len(words), 0, b" ".join(words), []))
                columns = list(zip(*rows)) or [()] * 5
                columns[3] = [x.decode() for x in columns[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, removed (word spans).

    A word goes if a window of `k` consecutive words that covers it starts anywhere else as well, in
    the same or another document. Null and empty texts have no words. Rows repeated are places of
    their own, so both copies of a long text go. Texts are known by doc_id and the first
    128 bits of the text's SHA-256: a null or repeated doc_id does no harm. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("tag"), "text")
    paths = scratch.keep(keyed.select("id", "tag", "text").mapInArrow(_paths(k), PATHS_DDL), "paths")
    # lists of keys are stored before they are joined, so that the join reads two plain shuffles and Spark can split a hot key
    shared = scratch.keep(paths.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed"), "shared")
    # only paths whose seed occurs again can repeat, in whole or in part
    places = scratch.keep(paths.join(shared.hint("merge"), "seed", "left_semi"), "places")
    scratch.drop("paths")
    kinds = scratch.keep(places.groupBy("seed", "path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "start", "edges")).alias("source")), "kinds")
    whole = places.join(kinds.filter("n > 1").select("seed", "path").hint("merge"), ["seed", "path"], "left_semi").select("id", "tag", "start", "edges")
    branching = scratch.keep(kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1").select("seed"), "branching")
    sources = (kinds.join(branching.hint("merge"), "seed", "left_semi").select("source.*", "seed", "n")
               .groupBy(*_KEY).agg(F.collect_list(F.struct("start", "edges", "seed", "n")).alias("found")))
    edges = scratch.keep(keyed.select("id", "tag", "text").join(sources.hint("merge"), _KEY).select("id", "tag", "text", "found").mapInArrow(_unfold(k), EDGES_DDL), "edges")
    again = scratch.keep(edges.groupBy("seed", "edge").agg(F.sum("n").alias("total")).filter("total > 1").select("seed", "edge"), "again")
    single = edges.filter("n = 1").join(again.hint("merge"), ["seed", "edge"], "left_semi").select("id", "tag", "start", F.lit(1).alias("edges"))
    found = whole.unionByName(single).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "edges")).alias("found"))
    return keyed.join(found.hint("merge"), _KEY, "left").select("doc_id", "text", "found").mapInArrow(
        _cut(k), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
