"""LM scoring (9): masked pseudo-likelihood of a bidirectional window network.

Every word is predicted from two words on each side. The network sums hashed embeddings of the neighbours, one table
for each side, and gives the class of the word in between; a word's probability is that of its class times its share
of the class. The most frequent words are a class each, all others fall into classes by their hash, so words of equal
frequency differ in context. Shares are exact for every word of the corpus: all words are counted in Spark into a
stored table, frequent ones are broadcast in a bounded number, and the counts of all others are joined to the documents
that hold them. The network is fitted to every window of the corpus: a start, fitted to windows drawn evenly from all
texts, goes to every partition, which goes on with it over all windows of its own; Spark takes the mean of what they
learnt, weight by weight, by how often each partition used it.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.store import Scratch
from gridspark.llm.words import Words, mix, text_chunks

#: Classes in all, and classes of one word each.
CLASSES, OWN = 128, 64
#: Most words whose counts are broadcast; the others are joined.
VOCABULARY = 1 << 17
#: Neighbours on each side, rows of an embedding table (row 0 is the edge of a text), and its width.
SIDE, BUCKETS, WIDTH = 2, 1 << 15, 32
#: Windows that the start is fitted to, about; each window of the corpus is drawn with the same probability.
SAMPLE, EPOCHS, BATCH, RATE = 200_000, 3, 256, 0.05
#: Windows of a step over the whole corpus and its rate, and rows of a table whose means are taken together.
STEP, STEP_RATE, ROWS = 2048, 0.1, 64
#: Words that are scored at a time: their logits stay in a core's cache.
BLOCK = 1 << 10
_U = np.uint64


def hash_class(word: np.ndarray) -> np.ndarray:
    """The class of a word that is none of its own."""
    return (OWN + (word.view(np.uint64) >> _U(40)) % _U(CLASSES - OWN)).astype(np.int64)


def _hash_class(word: str) -> Column:
    return F.lit(OWN) + F.pmod(F.shiftrightunsigned(word, 40), F.lit(CLASSES - OWN))


@dataclass
class Vocabulary:
    """Frequent words in ascending order with their counts and classes, the mass of every class, and the total."""

    words: np.ndarray
    counts: np.ndarray
    kind: np.ndarray
    mass: np.ndarray

    def __post_init__(self):
        # hashes spread evenly, so their upper bits lead to within a word or two of their place
        bits = len(self.words).bit_length() + 1
        self.shift, self.slots = 64 - bits, 1 << bits
        self.first = np.searchsorted(self.words, np.arange(-self.slots // 2, self.slots // 2) << self.shift).astype(np.int32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the first word that is not below each hash; of the last word, if all are."""
        last = len(self.words) - 1
        at = np.minimum(self.first[(hashes >> self.shift) + self.slots // 2], last)
        below = np.flatnonzero((self.words[at] < hashes) & (at < last))
        while len(below):
            at[below] += 1
            below = below[(self.words[at[below]] < hashes[below]) & (at[below] < last)]
        return at

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of each word; the count is 0 for a word that is not in the vocabulary."""
        hashes = hashes.view(np.int64)
        kind, count = hash_class(hashes), np.zeros(len(hashes), np.int64)
        if len(self.words):
            at = self.place(hashes)
            known = self.words[at] == hashes
            kind[known], count[known] = self.kind[at[known]], self.counts[at[known]]
        return kind, count


def vocabulary_of(words: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> Vocabulary:
    """The vocabulary of frequent words, given the mass of all words by the classes of their hashes."""
    kind, mass = hash_class(words), mass.astype(np.int64).copy()
    for k, at in enumerate(np.lexsort((words, -counts))[:OWN]):
        mass[kind[at]] -= counts[at]
        kind[at], mass[k] = k, counts[at]
    order = np.argsort(words)
    return Vocabulary(words[order], counts[order], kind[order], mass)


def windows(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Rows of the embedding tables for the neighbours of each word: SIDE before it, nearest first, then SIDE after it."""
    row = (1 + (hashes >> _U(20)) % _U(BUCKETS - 1)).astype(np.int32)
    out = np.zeros((len(row), 2 * SIDE), np.int32)
    for d in range(1, min(SIDE, max(len(row) - 1, 0)) + 1):
        same = words.doc[d:] == words.doc[:-d]
        out[d:, d - 1] = np.where(same, row[:-d], 0)
        out[:-d, SIDE + d - 1] = np.where(same, row[d:], 0)
    return out


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place; half as dear as numpy's."""
    x += x
    if x.size and not x.max() < 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of a table together: the distinct ones in ascending order, the place of each row among them, and which
    rows come first and which later in their group; 16 bits are sorted by radix."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    ordered = rows[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place, order[first], order[~first]


def _sums(values: np.ndarray, place: np.ndarray, first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Sums of the float32 rows of each group in their order; most groups have one row. Numbers are added in pairs, as complex ones."""
    out = values.take(first, axis=0)
    pairs = np.arange(values.shape[1] // 2)
    np.add.at(out.view(np.complex64).reshape(-1), (place[later, None] * len(pairs) + pairs).ravel(), values.take(later, axis=0).view(np.complex64).ravel())
    return out


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row as one item."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    np.put(table.view(item), at, rows.view(item))


class Network:
    """Embeddings of the words before and after, gains by distance, and the output layer over classes."""

    def __init__(self, prior: np.ndarray, seed: int = 0):
        random = np.random.default_rng(seed)
        self.tables = [random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32) for _ in range(2)]
        self.gains = np.ones((2 * SIDE, WIDTH), np.float32) / np.tile(np.arange(1, SIDE + 1), 2)[:, None].astype(np.float32)
        self.out = random.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32)
        self.bias = prior.astype(np.float32)
        self.seen: list[np.ndarray] = [np.full(w.shape, 1e-6, np.float32) for w in (*self.tables, self.gains, self.out, self.bias)]

    @property
    def weights(self) -> tuple[np.ndarray, ...]:
        return (*self.tables, self.gains, self.out, self.bias)

    def neighbours(self, window: np.ndarray) -> list[np.ndarray]:
        return [self.tables[k // SIDE].take(window[:, k], axis=0) for k in range(2 * SIDE)]

    def hidden(self, neighbours: list[np.ndarray]) -> np.ndarray:
        out = neighbours[0] * self.gains[0]
        more = np.empty_like(out)
        for b, g in zip(neighbours[1:], self.gains[1:]):
            out += np.multiply(b, g, out=more)
        return _tanh(out)

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """Of all classes, up to a number that is the same for a row: their exponentials neither overflow nor vanish."""
        out = hidden @ self.out
        out += self.bias
        # no hidden number is beyond 1, so mostly the weights alone rule out large logits
        most = (np.abs(self.out).sum(axis=0) + np.abs(self.bias)).max()
        if out.size and not most < 59 and not (out.max() < 60 and out.min() > -60):
            out -= out.max(axis=1, keepdims=True)
        return out

    def log_probabilities(self, window: np.ndarray) -> np.ndarray:
        logits = self.logits(self.hidden(self.neighbours(window)))
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def score(self, window: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The log-probability of one class each."""
        logits = self.logits(self.hidden(self.neighbours(window)))
        own = logits[np.arange(len(kind)), kind]
        return own - np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, logits.dtype))

    def gradients(self, window: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean negative log-probability: per neighbour for the tables' rows, then of gains, output and bias."""
        return self._gradients(self.neighbours(window), kind)

    def _gradients(self, neighbours: list[np.ndarray], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hidden = self.hidden(neighbours)
        error = self.logits(hidden)
        np.exp(error, out=error)
        n = error.dtype.type(len(kind))
        error /= (error @ np.full(CLASSES, n, error.dtype))[:, None]
        error[np.arange(len(kind)), kind] -= 1 / n
        inner = error @ self.out.T
        slope = hidden * hidden
        inner *= np.subtract(1, slope, out=slope)
        rows = np.empty((2 * SIDE, *inner.shape), inner.dtype)
        for r, g in zip(rows, self.gains):
            np.multiply(inner, g, out=r)
        return rows, np.stack([np.einsum("ij,ij->j", inner, b) for b in neighbours]), (error.T @ hidden).T, error.sum(axis=0)

    def learn(self, window: np.ndarray, kind: np.ndarray, rate: float = RATE) -> None:
        """One step with a learning rate per weight; only the rows of the tables that occur are touched, and each is read and written once."""
        n, sides, neighbours = len(kind), [], []
        for side in range(2):
            at, place, first, later = _grouped(window[:, side * SIDE:(side + 1) * SIDE].T.ravel())
            held = self.tables[side].take(at, axis=0)
            neighbours += [held.take(place[k * n:(k + 1) * n], axis=0) for k in range(SIDE)]
            sides.append((at, held, place, first, later))
        rows, *dense = self._gradients(neighbours, kind)
        for side, (at, held, *groups) in enumerate(sides):
            g = _sums(rows[side * SIDE:(side + 1) * SIDE].reshape(-1, WIDTH), *groups)
            seen = self.seen[side].take(at, axis=0)
            root = g * g
            seen += root
            _put(self.seen[side], at, seen)
            g *= rate
            g /= np.sqrt(seen, out=root)
            held -= g
            _put(self.tables[side], at, held)
        for w, g, seen in zip((self.gains, self.out, self.bias), dense, self.seen[2:]):
            seen += g * g
            w -= rate * g / np.sqrt(seen)


def fit(window: np.ndarray, kind: np.ndarray, mass: np.ndarray, epochs: int = EPOCHS) -> Network:
    """A network fitted to windows and the classes between them, in the order given; without windows it knows the classes' shares only."""
    network = Network(np.log((mass + 1) / (mass.sum() + len(mass))))
    for _ in range(epochs):
        for a in range(0, len(kind), BATCH):
            network.learn(window[a:a + BATCH], kind[a:a + BATCH])
    return network


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            word, n = np.unique(Words(data, offsets).hashes(), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n)})


def _level(n: str) -> Column:
    """Counts in steps of about a hundredth: at most a few thousand levels, whatever the corpus."""
    return F.floor(F.log2(n) * 64)


def count_words(texts: DataFrame, scratch: Scratch, most: int = VOCABULARY) -> tuple[DataFrame, Vocabulary]:
    """(word, n, frequent) of every word of the corpus as a stored table, and its vocabulary.

    Frequent are the words from the least level of counts on that leaves at most `most` of them. The driver gets a
    number per level, a number per class, and the frequent words.
    """
    counted = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted.withColumn("level", _level("n")), "words")
    levels = sorted((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect())
    least, held = float("inf"), 0
    for level, n in reversed(levels):
        held += n
        if held > most:
            break
        least = level
    frequent = F.col("level") >= F.lit(float(least))
    mass = np.zeros(CLASSES, np.int64)
    for r in counted.groupBy(_hash_class("word").alias("kind")).agg(F.sum("n").alias("n")).collect():
        mass[r["kind"]] = r["n"]
    top = counted.filter(frequent).select("word", "n").toArrow()
    return counted.withColumn("frequent", frequent), vocabulary_of(top.column("word").to_numpy(), top.column("n").to_numpy(), mass)


def _windows(vocabulary: Vocabulary, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets)
                hashes = words.hashes()
                # a place in a text is drawn by the words there and where it is
                place = (words.start - offsets[words.doc]).astype(np.uint64)
                key = mix(hashes + np.roll(hashes, 1) * _U(3) + mix(place, 21), 22)
                drawn = np.flatnonzero(key <= _U(min(int(share * 2.0**64), (1 << 64) - 1)))
                window = windows(words, hashes)[drawn]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[drawn].view(np.int64)), "kind": pa.array(vocabulary.of(hashes[drawn])[0]),
                                                  "window": pa.FixedSizeListArray.from_arrays(pa.array(window.ravel()), 2 * SIDE).cast(pa.list_(pa.int32()))})

    return run


def _fit(mass: np.ndarray, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows = [np.empty(0, np.int64)], [np.empty((0, 2 * SIDE), np.int32)]
        for batch in batches:
            kinds.append(batch.column(0).to_numpy())
            rows.append(batch.column(1).flatten().to_numpy().reshape(-1, 2 * SIDE))
        network = fit(np.concatenate(rows), np.concatenate(kinds), mass, epochs)
        state = (*network.weights, *network.seen)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(state))), "weights": pa.array([w.astype("<f4").tobytes() for w in state])})

    return run


def _start(texts: DataFrame, vocabulary: Vocabulary, sample: int, epochs: int) -> Network:
    """The network that every partition starts from, fitted in one task to about `sample` windows of all texts."""
    share = sample / max(int(vocabulary.mass.sum()), 1)
    drawn = texts.mapInArrow(_windows(vocabulary, share), "key long, kind long, window array<int>")
    ordered = drawn.repartition(1).sortWithinPartitions("key", "kind", "window").select("kind", "window")
    found = {r["part"]: bytes(r["weights"]) for r in ordered.mapInArrow(_fit(vocabulary.mass, epochs), "part long, weights binary").collect()}
    network = Network(np.log((vocabulary.mass + 1) / (vocabulary.mass.sum() + CLASSES)))
    for k, w in enumerate((*network.weights, *network.seen)):
        if found:
            w[...] = np.frombuffer(found[k], "<f4").reshape(w.shape)
    return network


def _go_on(vocabulary: Vocabulary, start: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network, times = copy.deepcopy(start), np.zeros((2, BUCKETS), np.int64)
        n = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words = Words(data, offsets)
                hashes = words.hashes()
                # neighbouring windows are alike, so those of a chunk are mixed
                order = np.random.default_rng(len(hashes)).permutation(len(hashes))
                window, kind = windows(words, hashes).take(order, axis=0), vocabulary.of(hashes)[0].take(order)
                for a in range(0, len(kind), STEP):
                    network.learn(window[a:a + STEP], kind[a:a + STEP], STEP_RATE)
                for side in range(2):
                    times[side] += np.bincount(window[:, side * SIDE:(side + 1) * SIDE].ravel(), minlength=BUCKETS)
                n += len(kind)
        if not n:
            return
        for part, w in enumerate(network.weights):
            w = np.atleast_2d(w)
            used = times[part] if part < 2 else np.full(len(w), n)
            at = np.flatnonzero(used)
            values = np.ascontiguousarray(w[at], "<f4")
            bounds = np.arange(len(at) + 1, dtype=np.int32) * values.itemsize * values.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), part, np.int32)), pa.array((at // ROWS).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)),
                pa.array(used[at]), pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(values)])],
                names=["part", "block", "at", "replica", "times", "weights"])

    return run


def means(learnt: pa.Table) -> pa.Table:
    """(part, at, weights): the mean of each row of weights by its `times`, whatever the order of the rows."""
    at, times = learnt.column("at").to_numpy(), learnt.column("times").to_numpy()
    order = np.lexsort((learnt.column("replica").to_numpy(), at))
    values = np.frombuffer(b"".join(learnt.column("weights").to_pylist()), "<f4").reshape(len(at), -1)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    total = np.add.reduceat(values[order] * times[order, None].astype(np.float64), first)
    mean = (total / np.add.reduceat(times[order], first)[:, None]).astype("<f4")
    return pa.table({"part": learnt.column("part").slice(0, len(first)), "at": pa.array(at[order][first]), "weights": pa.array([m.tobytes() for m in mean], pa.binary())})


def train(texts: DataFrame, vocabulary: Vocabulary, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network:
    """The network fitted to every window of all texts.

    A start is fitted to about `sample` windows. Each partition goes on from it in one pass over all of its own
    windows; the result is the mean of the partitions' networks, each row of a table weighted by how often a partition
    used it, all else by the partitions' numbers of words. A row that no text uses stays as it was. The driver gets
    two networks; what the partitions learnt is averaged in Spark.
    """
    network = _start(texts, vocabulary, sample, epochs)
    learnt = texts.mapInArrow(_go_on(vocabulary, network), "part int, block int, at int, replica int, times long, weights binary")
    mean = learnt.groupBy("part", "block").applyInArrow(means, "part int, at int, weights binary").toArrow()
    part, at = mean.column("part").to_numpy(), mean.column("at").to_numpy()
    for k, w in enumerate(network.weights):
        rows = np.flatnonzero(part == k)
        if len(rows):
            np.atleast_2d(w)[at[rows]] = np.frombuffer(b"".join(mean.column("weights").take(pa.array(rows)).to_pylist()), "<f4").reshape(len(rows), -1)
    network.seen = []
    return network


_SCORED_DDL = "doc_id long, n_tokens long, sum double, rare array<struct<word:long,times:int>>"


def _scores(vocabulary: Vocabulary, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.log(np.maximum(vocabulary.mass, 1))
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets)
                hashes = words.hashes()
                kind, count = vocabulary.of(hashes)
                window, total = windows(words, hashes), np.zeros(end - row)
                for a in range(0, len(hashes), BLOCK):
                    part = slice(a, a + BLOCK)
                    score = network.score(window[part], kind[part]) - mass[kind[part]] + np.log(np.maximum(count[part], 1))
                    total += np.bincount(words.doc[part], score, end - row)
                rare = np.flatnonzero(count == 0)
                order = rare[np.lexsort((hashes[rare], words.doc[rare]))]
                doc, word = words.doc[order], hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(order) else order
                times = np.diff(np.append(first, len(order)))
                held = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "times"])
                bounds = np.searchsorted(doc[first], np.arange(end - row + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(words.first)), pa.array(total), pa.ListArray.from_arrays(pa.array(bounds), held)],
                                                 names=["doc_id", "n_tokens", "sum", "rare"])

    return run


def pseudo_likelihood(docs: DataFrame, vocabulary: int = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (sum over all its words), mean_log_likelihood.

    A text without words (null, empty) has sum 0 and a null mean. Rows repeated count as often in training as they
    occur and get equal scores; a null doc_id stays null. Texts are scored whole, a few megabytes at a time, one text
    at least. Words of equal counts are ordered by their hash. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted, known = count_words(texts.select("text"), scratch, vocabulary)
    network = train(texts.select("text"), known, sample)
    scored = scratch.keep(texts.mapInArrow(_scores(known, network), _SCORED_DDL).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    shares = rare.join(counted.filter(~F.col("frequent")).select("word", "n").hint("merge"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    whole = scored.select("row", "doc_id", "n_tokens", "sum").join(shares.hint("merge"), "row", "left")
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    return whole.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
