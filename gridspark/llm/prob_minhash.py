"""MinHash near-dedup (3) by ProbMinHash.

Every shingle of a text is a Poisson process whose rate is the shingle's weight. Its arrivals fall
on random registers; a register keeps the shingle that arrives first, so two texts agree in a
register with the probability Jaccard similarity of their weighted shingles. Arrivals later than
the latest register are never drawn, so most shingles cost one draw.

A text with repeated shingles has a second set of registers, with unit weights: two texts agree in
these with the plain Jaccard similarity that links are made of. Without repeats both sets are equal,
so the second is left out, and the bands of both lie in the same buckets.

Registers are grouped in bands. Texts that share a band are compared with one head of their bucket
by the exact similarity of their texts, with another head in the next round. What the stars leave
apart is compared where prefix filtering, which loses nothing, still allows a link. Texts that crowd
around a shared shingle are filtered by what sets them apart from one of them, the pivot: what the
crowd has in common makes no pairs. No bucket is turned into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.llm.components import components
from gridspark.llm.store import Scratch, turn_to
from gridspark.llm.words import Words, mix, spans, text_chunks, windows

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band of unit weights with probability (1 - 0.8^6)^40 < 1e-5, however often shingles repeat.
BANDS, ROWS = 40, 6
#: Stars drawn in every bucket before what is still apart is compared by shared shingles.
STARS = 1
#: Counters that order shingles by how common they are.
COUNTERS = 1 << 20
#: Texts that share a shingle of their prefixes and are compared with each other directly; of more, a pivot is taken.
CROWD = 64
_U = np.uint64


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle of every text; a shorter text is one shingle."""
    hashes = words.hashes()
    full = np.flatnonzero(words.left() >= k)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    value = np.concatenate([windows(hashes, k)[full] if len(full) else np.empty(0, np.uint64), spans(hashes, words.first[short], words.first[short + 1])])
    text = np.concatenate([words.doc[full], short])
    _, at, count = np.unique(mix(value + text.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
    return text[at], value[at], count


def registers(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The winning shingle of each of k registers of n texts; zeros for a text without shingles."""
    first, winner = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    t, draw = np.zeros(len(text)), 0
    while len(text):
        random = mix(value + _U(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 5)
        t = t - np.log(((random >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        where = text * k + ((mix(random, 6) >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
        np.minimum.at(first, where, t)
        won = t == first[where]
        winner[where[won]] = value[won]
        go = t < first.reshape(n, k).max(axis=1)[text]
        text, value, weight, t, draw = text[go], value[go], weight[go], t[go], draw + 1
    return winner.reshape(n, k)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near")
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                n = end - row
                text, value, count = shingles(Words(data, offsets), k)
                sums = np.zeros((2, n), np.uint64)
                for s in (0, 1):
                    np.add.at(sums[s], text, mix(value, 7 + s))
                size = np.bincount(text, minlength=n)
                repeated = np.bincount(text[count > 1], minlength=n) > 0
                again = repeated[text]
                found = np.concatenate([registers(text, value, 1 + np.log(count), n, bands * rows).reshape(n, bands, rows), np.zeros((n, bands, rows), np.uint64)], axis=1)
                found[repeated, bands:] = registers((np.cumsum(repeated) - 1)[text[again]], value[again], np.ones(int(again.sum())), int(repeated.sum()), bands * rows).reshape(-1, bands, rows)
                band = np.tile(np.arange(bands, dtype=np.uint64), (n, 2))
                for j in range(rows):
                    band = mix(band * _U(0xA0761D6478BD642F) + found[:, :, j], 9)
                held = np.repeat(np.stack([size > 0, repeated], axis=1), bands, axis=1)
                where = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(size.astype(np.int32)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(where), pa.array(band[held].view(np.int64)))], names=["doc_id", "tag", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _keys(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    text, value, _ = shingles(words, k)
    return text, mix(value + text.astype(np.uint64) * _U(0xA0761D6478BD642F), 3)


def _similarity(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near")
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                n, sides = part.num_rows, []
                for column in (part.column(2), part.column(3)):
                    _, _, data, offsets = next(text_chunks(column, 1 << 62))
                    sides.append(_keys(Words(data, offsets), k))
                (ta, ka), (tb, kb) = sides
                common = np.bincount(ta[np.isin(ka, kb)], minlength=n)
                total = np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n) - common
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common / np.maximum(total, 1))], names=["a", "b", "similarity"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")


def similarities(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity): exact Jaccard similarity of the shingle sets of pairs (a, b) of ids in `texts` (id, text)."""
    return _with_texts(pairs, texts).mapInArrow(_similarity(k), "a long, b long, similarity double")


def tag(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256: with the doc_id it tells the texts of one doc_id apart."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def near_dedup(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id reachable through links), kept (doc_id = class_id), n_shingles.

    Two texts are linked if the Jaccard similarity of their sets of k-word shingles is at least `threshold`; equal
    sets are one class from the start. A text shorter than k words is one shingle. Texts without words (null, empty,
    white space) link with nothing: class_id is their own doc_id. A null doc_id takes the class of an equal set that
    has an id, else class_id is null and it stays. Rows repeated share their class and `kept`; different texts of one
    doc_id are documents of their own, each with its own links. Other columns are not read.
    """
    return _near_dedup(docs, k, threshold, bands, rows).drop("tag")


def _near_dedup(docs: DataFrame, k: int, threshold: float, bands: int, rows: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tag", tag(F.col("text")))
    sketches = scratch.keep(texts.mapInArrow(_sketches(k, bands, rows), "doc_id long, tag binary, n_shingles int, set_a long, set_b long, bands array<long>"), "sketches")
    worded = sketches.filter("n_shingles > 0")
    # a class is a set of shingles: it has a number of its own, the text of one of its rows, and the least doc_id
    source = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag")))
    classes = scratch.keep(worded.groupBy("set_a", "set_b").agg(source.alias("source")).select(
        "set_a", "set_b", "source.*", F.monotonically_increasing_id().alias("id")), "classes")
    numbered = classes.filter("doc_id is not null").select("doc_id", "tag", "id")
    heads = worded.select("doc_id", "tag", "bands").join(numbered.hint("merge"), ["doc_id", "tag"])
    banded = heads.select("id", F.explode("bands").alias("band")).distinct()
    buckets = scratch.keep(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "buckets")
    roster = scratch.keep(banded.join(buckets.hint("merge"), "band", "left_semi"), "roster")
    wanted = numbered.join(roster.select("id").distinct().hint("merge"), "id", "left_semi")
    compared = scratch.keep(texts.join(wanted.hint("merge"), ["doc_id", "tag"]).groupBy("id").agg(F.min("text").alias("text")), "texts")

    links = found = None
    for turn in range(STARS):
        placed = _placed(roster, found)
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        head = scratch.keep(placed.groupBy("band").agg(F.min_by(F.struct("id", "component"), order).alias("head")).select("band", "head.*")
                            .toDF("band", "head", "head_component"), f"heads-{turn}")
        apart = placed.join(head.hint("merge"), "band").filter("component <> head_component")
        pairs = scratch.keep(apart.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct(), f"stars-{turn}")
        new = similarities(pairs, compared, k).filter(F.col("similarity") >= threshold).select("a", "b")
        links = scratch.keep(new if links is None else links.unionByName(new), f"links-{turn}")
        found = components(links, scratch, f"components-{turn}")

    shared = _shared_prefixes(scratch, roster, found, compared, k, threshold)
    candidates = _prefix_pairs(shared.filter(F.col("crowd") <= CROWD), threshold)
    crowds = scratch.keep(shared.filter(F.col("crowd") > CROWD), "crowds")
    if not crowds.isEmpty():
        around = _around_pivots(scratch, crowds, compared, k, threshold)
        links = scratch.keep(links.unionByName(around.filter("linked").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))), "links-pivots")
        found = components(links, scratch, "components-pivots")
        candidates = candidates.unionByName(_crowd_pairs(scratch, around, found, threshold)).distinct()
    candidates = scratch.keep(candidates, "candidates")
    more = scratch.keep(similarities(candidates, compared, k).filter(F.col("similarity") >= threshold).select("a", "b"), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more), scratch, "components-all")

    member = scratch.keep(numbered.select("doc_id", "id").join(found.hint("merge"), "id"), "members")
    # stored before it is joined, so that the join reads two plain shuffles and Spark can split a large class
    least = scratch.keep(member.groupBy("component").agg(F.min("doc_id").alias("class_id")), "least")
    linked = member.select("id", "component").join(least.hint("merge"), "component").select(F.col("id").alias("_id"), "class_id")
    own = classes.select("set_a", "set_b", "id", "doc_id").join(linked.hint("merge"), F.col("id") == F.col("_id"), "left").select(
        "set_a", "set_b", F.coalesce("class_id", "doc_id").alias("class_id"))
    known = worded.select("doc_id", "tag", "n_shingles", "set_a", "set_b").join(own.hint("merge"), ["set_a", "set_b"]).select("doc_id", "tag", "class_id", "n_shingles")
    out = known.unionByName(sketches.filter("n_shingles = 0").select("doc_id", "tag", F.col("doc_id").alias("class_id"), "n_shingles"))
    return out.select("doc_id", "tag", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_shingles")


def _placed(roster: DataFrame, found: DataFrame | None) -> DataFrame:
    """(band, id, component): who is in each bucket, and with whom a text is linked so far."""
    if found is None:
        return roster.select("band", "id", F.col("id").alias("component"))
    return roster.join(found.hint("merge"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))


def _counters(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                _, value, _ = shingles(Words(data, offsets), k)
                slot, n = np.unique(value & _U(COUNTERS - 1), return_counts=True)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot.astype(np.int32)), "n": pa.array(n)})

    return run


def _prefixes(k: int, threshold: float, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                text, value, _ = shingles(Words(data, offsets), k)
                order = np.lexsort((value, counts[value & _U(COUNTERS - 1)], text))
                text, value = text[order], value[order]
                n = np.bincount(text, minlength=end - row)
                place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
                first = np.flatnonzero(place < (n - np.ceil(threshold * n - 1e-9) + 1)[text])
                yield pa.RecordBatch.from_arrays([
                    pa.array(value[first].view(np.int64)), batch.column(0).slice(row, end - row).take(pa.array(text[first])),
                    pa.array(place[first].astype(np.int32)), pa.array(n[text[first]].astype(np.int32))], names=["shingle", "id", "place", "n"])

    return run


def _shared_prefixes(scratch: Scratch, roster: DataFrame, found: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(shingle, id, place, n, component, outside, crowd): prefixes of texts that share a bucket's company with another component.

    Shingles are put in one order, rare ones first. Two sets with similarity t share one of the first
    n - ceil(t n) + 1 of theirs, whatever the order: no pair is lost. The order comes from counts in a
    fixed number of counters, the only thing that is brought to the driver. Shingles that cannot make a
    pair are left out; `crowd` is the number of texts that have the shingle in their prefix.
    """
    placed = _placed(roster, found)
    mixed = scratch.keep(placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("band", "least"), "mixed")
    who = scratch.keep(placed.join(mixed.hint("merge"), "band").groupBy("id", "component").agg(F.max(F.col("component") != F.col("least")).alias("outside")), "apart")
    own = scratch.keep(texts.join(who.select("id").hint("merge"), "id", "left_semi"), "apart-texts")
    counted = own.select("text").mapInArrow(_counters(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    prefix = scratch.keep(own.select("id", "text").mapInArrow(_prefixes(k, threshold, counts), "shingle long, id long, place int, n int")
                          .join(who.hint("merge"), "id"), "prefixes")
    able = scratch.keep(_able(prefix.groupBy("shingle"), F.count(F.lit(1)).alias("crowd")), "able")
    return scratch.keep(prefix.join(able.hint("merge"), "shingle"), "shared")


def _able(groups, *more: Column) -> DataFrame:
    """Groups that hold two components and a text outside: no others can make a pair."""
    found = groups.agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("outside").alias("any"), *more)
    return found.filter("least <> most and any").drop("least", "most", "any")


def _sizes(x: str, y: str, threshold: float) -> Column:
    return (F.col(x) >= threshold * F.col(y) - 1e-6) & (F.col(y) >= threshold * F.col(x) - 1e-6)


def _prefix_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked, of texts that share a shingle of their prefixes."""
    x = shared.filter("outside").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("id", "place", "n", "component")))
    y = shared.select(F.col("shingle").alias("_shingle"), *(F.col(c).alias(f"y_{c}") for c in ("id", "place", "n", "component", "outside")))
    # an overlap of t / (1 + t) of both sizes must still be possible behind the shared place
    behind = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    near = ((F.col("x_component") != F.col("y_component")) & (~F.col("y_outside") | (F.col("x_id") < F.col("y_id"))) & _sizes("x_n", "y_n", threshold)
            & (behind >= threshold / (1 + threshold) * (F.col("x_n") + F.col("y_n")) - 1e-6))
    return x.join(y.hint("merge"), (F.col("shingle") == F.col("_shingle")) & near).select(
        F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _differences(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("near")
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                n, sides = part.num_rows, []
                for column in (part.column(2), part.column(3)):
                    _, _, data, offsets = next(text_chunks(column, 1 << 62))
                    text, value, _ = shingles(Words(data, offsets), k)
                    sides.append((text, value, mix(value + text.astype(np.uint64) * _U(0xA0761D6478BD642F), 3)))
                (ta, va, ka), (tb, vb, kb) = sides
                a, b = ~np.isin(ka, kb), ~np.isin(kb, ka)
                text, value = np.concatenate([ta[a], tb[b]]), np.concatenate([va[a], vb[b]])
                order = np.argsort(text, kind="stable")
                bounds = np.searchsorted(text[order], np.arange(n + 1)).astype(np.int32)
                size_a, size_b = np.bincount(ta, minlength=n), np.bincount(tb, minlength=n)
                total = size_a + np.bincount(tb[b], minlength=n)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.bincount(ta[~a], minlength=n) / np.maximum(total, 1)), pa.array(size_a.astype(np.int32)), pa.array(size_b.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[order].view(np.int64)))], names=["id", "pivot", "similarity", "n", "pivot_n", "apart"])

    return run


def _around_pivots(scratch: Scratch, crowds: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, pivot, n, pivot_n, outside, linked, apart) of the texts of crowds: `apart` holds the shingles that only one of both has.

    The pivot of a shingle is the text that has the fewest rarer ones. A crowd is cut by sizes, each text into its own
    class and the next, so that two texts whose sizes allow a link have a pivot in common.
    """
    step = 1e-6 - math.log(threshold)
    size = F.floor(F.log("n") / step)
    sized = crowds.drop("crowd").withColumn("size", F.explode(F.array(size, size + 1)))
    pivots = scratch.keep(_able(sized.groupBy("shingle", "size"), F.min_by("id", F.struct("place", "id")).alias("pivot")), "pivots")
    pairs = scratch.keep(sized.join(pivots.hint("merge"), ["shingle", "size"]).filter("id <> pivot").select("id", "pivot", "outside").distinct(), "around")
    both = _with_texts(pairs.select(F.col("id").alias("a"), F.col("pivot").alias("b")), texts)
    measured = scratch.keep(both.mapInArrow(_differences(k), "id long, pivot long, similarity double, n int, pivot_n int, apart array<long>"), "measured")
    return measured.join(pairs.hint("merge"), ["id", "pivot"]).withColumn("linked", F.col("similarity") >= threshold).drop("similarity")


def _crowd_pairs(scratch: Scratch, around: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) around one pivot that may still be linked, by prefix filtering of what sets them apart from it.

    Let X and Y be the shingles that set two texts apart from the pivot. The texts differ in |X| + |Y| - 2 |X & Y|
    shingles, and are linked if these are at most c = (1 - t) / (1 + t) of both sizes. If one of them is not linked to
    the pivot, X and Y must therefore have shingles in common, by at least (|X| + |Y| - c (n + m)) / 2: the first one they
    share, whatever the order, has that many of X and of Y from it on. If both are linked to the pivot, they are one
    component already. Shingles that set few apart come first.
    """
    c = (1 - threshold) / (1 + threshold)
    known = around.join(found.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = known.select("id", "pivot", "n", "pivot_n", "outside", "linked", "component", F.size("apart").alias("size"), F.explode("apart").alias("shingle"))
    one = scratch.keep(one, "differences")
    often = scratch.keep(one.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "differences-often")
    counted = scratch.keep(one.join(often.hint("merge"), ["pivot", "shingle"]), "differences-counted")
    # shingles that set a single text apart come first and meet no other: they are counted in `size` only
    order = F.row_number().over(Window.partitionBy("id", "pivot").orderBy(F.col("times").desc(), F.col("shingle").desc()))
    least = F.when(F.col("linked"), F.col("size") - c * (F.col("n") - F.col("pivot_n"))).otherwise(F.col("size") - c * (F.col("n") + F.col("pivot_n"))) / 2
    # `left`: how many shingles of the text are not before this one
    prefix = scratch.keep(counted.withColumn("left", order).filter(F.col("left") >= least - 1e-6).drop("times", "pivot_n"), "differences-prefixes")
    columns = ("id", "n", "outside", "linked", "component", "size", "left")
    x = prefix.filter("not linked").select("pivot", "shingle", *(F.col(a).alias(f"x_{a}") for a in columns))
    y = prefix.select(F.col("pivot").alias("_pivot"), F.col("shingle").alias("_shingle"), *(F.col(a).alias(f"y_{a}") for a in columns))
    near = ((F.col("x_component") != F.col("y_component")) & (F.col("x_outside") | F.col("y_outside")) & (F.col("y_linked") | (F.col("x_id") < F.col("y_id"))) & _sizes("x_n", "y_n", threshold)
            & (2 * F.least("x_left", "y_left") >= F.col("x_size") + F.col("y_size") - c * (F.col("x_n") + F.col("y_n")) - 1e-6))
    return x.join(y.hint("merge"), (F.col("pivot") == F.col("_pivot")) & (F.col("shingle") == F.col("_shingle")) & near).select(
        F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one of each class, with all their columns.

    Of a class the rows with its least doc_id stay; a doc_id's texts of other classes are judged by theirs. Rows
    without a doc_id stay.
    """
    stays = _near_dedup(docs, k, threshold, BANDS, ROWS).filter("kept").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    mine = (F.col("doc_id") == F.col("_id")) & (tag(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_tag"))
    return docs.filter("doc_id is not null").join(stays.hint("merge"), mine, "left_semi").unionByName(docs.filter("doc_id is null"))
