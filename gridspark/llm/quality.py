"""Quality classifier (8): logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters, digits or other characters. Each text gives the n-grams (n = 1, 2) of its
words and of their shapes (a pair of shapes also says if its words are equal), as shares of its n-grams. The model is fitted in one task on a bounded
sample of labelled rows; every text is scored whole by sparse dot products inside the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.store import prepare
from gridspark.llm.words import FINE, Words, mix, text_chunks

_U = np.uint64
#: log2 of the number of weights.
BITS = 18
#: Most labelled rows that are fitted: those whose hashed doc_id comes first.
SAMPLE = 16_000
#: Bytes of texts whose features are held at a time; one text at least.
CHUNK_BYTES = 1 << 20
EPOCHS = 3
#: What a share is multiplied with, so that weights stay of the order of one.
SCALE = 32.0
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _shapes(words: Words) -> np.ndarray:
    """A small code per word: letters by case and length, digits by length, other characters by what they are."""
    upper = np.concatenate([[0], np.cumsum((words.data >= 65) & (words.data <= 90))])
    size, n_upper, kind = words.end - words.start, upper[words.end] - upper[words.start], FINE[words.data[words.start]]
    title = upper[words.start + 1] - upper[words.start]
    case = np.select([n_upper == 0, (n_upper == size) & (size > 1), (n_upper == 1) & (title == 1)], [0, 1, 2], 3)
    return (kind.astype(np.uint64) << _U(40)) + (case.astype(np.uint64) << _U(20)) + np.minimum(size, 12).astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight index) of every n-gram of every text, and the n-grams per text."""
    words = Words(data, offsets, FINE)
    hashes, kind = words.hashes(), FINE[data[words.start]] if len(words) else np.empty(0, np.uint8)
    shapes = mix(np.where(kind == 3, hashes, _shapes(words)), 1) if len(words) else hashes
    pair = np.flatnonzero(words.left() >= 2)
    again = (hashes[pair] == hashes[pair + 1]).astype(np.uint64)
    grams = [mix(hashes, 2), mix(hashes[pair] * _U(0xD6E8FEB86659FD93) + mix(hashes[pair + 1], 3), 3),
             mix(shapes, 4), mix(shapes[pair] * _U(0xD6E8FEB86659FD93) + mix(shapes[pair + 1], 5) + again, 5)]
    text = np.concatenate([words.doc, words.doc[pair]] * 2)
    return text, (np.concatenate(grams) >> _U(64 - bits)).astype(np.int64), np.bincount(text, minlength=len(offsets) - 1)


class Ftrl:
    """Follow-the-regularised-leader with a learning rate per weight; weight 0 .. 2^bits - 1, the last one is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _examples(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bounds, weight indices, values) of a run of texts: example k lies between bounds k and k + 1. Few large arrays of
    short types, since the training task holds all of the sample and its worker lives on."""
    for _, _, data, offsets in text_chunks(column, CHUNK_BYTES):
        text, index, count = features(data, offsets, bits)
        order = np.argsort(text, kind="stable")
        index, bounds = index[order], np.concatenate([[0], np.cumsum(count)])
        ats, values = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            at, n = np.unique(index[a:b], return_counts=True)
            ats.append(np.append(at, 1 << bits).astype(np.int32))
            values.append(np.append(n * (SCALE / max(b - a, 1)), 1.0).astype(np.float32))
        yield np.concatenate([[0], np.cumsum([len(x) for x in ats])]), np.concatenate(ats), np.concatenate(values)


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, labels = [], []
        for batch in batches:
            runs += _examples(batch.column(1), bits)
            labels += batch.column(0).to_pylist()
        model = Ftrl(bits)
        for _ in range(epochs):
            label = iter(labels)
            for bounds, at, value in runs:
                for a, b in zip(bounds[:-1], bounds[1:]):
                    model.learn(at[a:b], value[a:b], next(label))
        yield pa.RecordBatch.from_pydict({"model": [model.weights(slice(None)).astype("<f4").tobytes()]})

    return run


def train(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> bytes:
    """The weights fitted on (doc_id, text, label); at most `sample` rows, drawn by the hash of doc_id. One row without labels gives zeros."""
    prepare(labelled.sparkSession)
    drawn = labelled.select(F.xxhash64("doc_id").alias("_at"), "doc_id", "text", F.col("label").cast("int").alias("label")).orderBy("_at", "doc_id", "label").limit(sample)
    ordered = drawn.repartition(1).sortWithinPartitions("_at", "doc_id", "label").select("label", F.coalesce("text", F.lit("")).alias("text"))
    models = ordered.mapInArrow(_train(bits, epochs), "model binary").collect()
    return models[0]["model"] if models else bytes(4 * ((1 << bits) + 1))


def score(text: Column, model: bytes, bits: int = BITS) -> Column:
    """The probability of label 1 of a text. A null text, or one without words, gets the score of the bias alone.

    Only the text goes through Arrow, a few megabytes of features at a time; the rows stay where they are.
    """
    def run(texts: pa.Array) -> pa.Array:
        weights, out = np.frombuffer(model, "<f4").astype(np.float64), [np.empty(0)]
        for _, _, data, offsets in text_chunks(texts, CHUNK_BYTES):
            text, index, count = features(data, offsets, bits)
            raw = np.bincount(text, weights[index], len(count)) * (SCALE / np.maximum(count, 1)) + weights[-1]
            out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
        return pa.array(np.concatenate(out))

    return F.arrow_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `sample` labelled documents that are not held out.

    The ids are drawn by their hash and broadcast, so no other text is moved. Labels that contradict each
    other or are null count for nothing.
    """
    one = (labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
           .filter("label = _most").drop("_most"))
    drawn = one.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every row.

    Null and empty texts have no n-grams: they get the same score as each other. A null doc_id is scored like any
    other; its held_out is null. Rows repeated get equal scores. Columns other than doc_id and text are not read.
    """
    scored = docs.select("doc_id", score(F.col("text"), train_on(docs, labels, sample)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The weights fitted on the labels of `docs`; of a doc_id that many rows share, what comes first by the hash counts."""
    return train(labelled(docs, labels, sample), sample)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they came with."""
    return docs.filter(score(F.col("text"), train_on(docs, labels, sample)) >= threshold)
