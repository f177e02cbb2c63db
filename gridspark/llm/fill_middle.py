"""Fill-in-middle transformation (11): cut points found in a boundary set of Roaring containers.

The positions at which tokens of a text begin, and its end, are a compressed set of integers. Each 65,536 code
points are a container of its own: an array of positions, a bitmap, or runs of consecutive positions, whichever
is the smallest. Cumulative cardinalities of the containers lead to the one that holds the k-th boundary, and a
select inside it (an index, a count of bits, or a search of run lengths) gives the offset after k tokens. Choices
between forms, and the output itself, are expressions on the text, which stays on Spark's side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.store import prepare

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred of these so many with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SPAN = 1 << 16
#: Most positions of an array container, and bytes of a bitmap.
ARRAY_MOST, BITMAP_BYTES = 4096, SPAN // 8
_CUTS_DDL = "n long, first long, second long"


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(count) - count

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    def __init__(self, low: np.ndarray, at: np.ndarray):
        self.start, self.before = low[at].astype(np.uint16), at

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of ascending positions below 65,536."""
    runs = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(runs) + 2 < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low, runs)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


def spans(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions inside) of the boundaries of each 65,536 code points: where tokens begin, and the end of the text.

    A token is a run of letters A to Z of either case, or any other single code point.
    """
    inside = False
    for key in range(len(text) // SPAN + 1):
        part = text[key * SPAN:(key + 1) * SPAN]
        code = np.frombuffer(part.encode("utf-32-le"), "<u4")
        letter = ((code | 32) - np.uint32(97)) < 26
        begins = ~(letter & np.concatenate([[inside], letter[:-1]])) if len(part) else np.empty(0, bool)
        inside = bool(letter[-1]) if len(part) else inside
        low = np.flatnonzero(begins)
        if len(part) < SPAN:
            low = np.append(low, len(part))
        if len(low):
            yield key, low


class BoundarySet:
    """The token boundaries of a text, in ascending order from 0; a text of n tokens has n + 1, an empty one has 1."""

    def __init__(self, text: str):
        self.keys, self.containers, sizes = [], [], []
        for key, low in spans(text):
            self.keys.append(key)
            self.containers.append(container(low))
            sizes.append(len(low))
        self.before = np.concatenate([[0], np.cumsum(sizes)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th boundary: the code points of the first k tokens."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.keys[at] * SPAN + self.containers[at].select(k - int(self.before[at]))


def _cuts(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(texts, one, two):
        bounds = BoundarySet(text)
        n = len(bounds)
        a, b = sorted((a % n, b % n))
        rows.append((n - 1, bounds.select(a), bounds.select(b)))
    return pd.DataFrame(rows, columns=["n", "first", "second"], dtype="int64")


def draws(doc_id: Column, seed: int, n: int) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of the SHA-256 of `seed:doc_id`, as integers; a null doc_id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points; null if plain), output.

    Cuts and forms follow from the hash of `seed:doc_id` alone, so rows with the same doc_id are cut at the same draws,
    and rows repeated give equal rows. A null text is empty. An empty text, and one that holds one of the three
    marks, stays plain. A text is read whole, 65,536 code points at a time. Other columns are not read.
    """
    prepare(docs.sparkSession)
    h = draws(F.col("doc_id"), seed, 4)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *(x.alias(f"h{k + 1}") for k, x in enumerate(h)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = read.select("doc_id", "text", form.alias("form"), F.pandas_udf(_cuts, _CUTS_DDL)("text", "h1", "h2").alias("cut")).select("doc_id", "text", "form", "cut.*")
    part = {PREFIX: F.expr("substring(text, 1, cast(first as int))"), MIDDLE: F.expr("substring(text, cast(first as int) + 1, cast(second - first as int))"),
            SUFFIX: F.expr("substring(text, cast(second as int) + 1)")}
    ordered = lambda *marks: F.concat(*(x for m in marks for x in (F.lit(m), part[m])))
    whole = F.col("form") == "plain"
    output = F.when(whole, F.col("text")).when(F.col("form") == "spm", ordered(SUFFIX, PREFIX, MIDDLE)).otherwise(ordered(PREFIX, SUFFIX, MIDDLE))
    return cut.select("doc_id", "n", "form", F.when(~whole, F.col("first")).alias("prefix_chars"),
                      F.when(~whole, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text held no mark, so the marks found are those put there."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
