"""Exact dedup (1): a heavy-hitter split.

Misra-Gries summaries of the digests are built per partition and merged; what they name is
counted exactly. Digests that really are frequent get their winner by a broadcast of at most
`counters` rows, so their copies never meet in a shuffle. All other groups have fewer than
rows / counters members and are grouped and joined by ordinary shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.store import Scratch

#: Counters of a summary, and the bound of the broadcast.
COUNTERS = 2048
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def digest(text: str | Column) -> Column:
    """SHA-256 of a text with each run of white space as one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def reduce_counts(counts: dict, counters: int) -> dict:
    """Misra-Gries step for any number of weighted keys: what the key after the last kept one has is taken from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for x in batch.column(0).value_counts().tolist():
                if x["values"] is not None:
                    kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            kept = reduce_counts(kept, counters)
        # a count of 1 in a partition can still be one of many elsewhere: everything kept goes on
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.binary()), "n": pa.array(list(kept.values()), pa.int64())})

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of every digest with more than 1 / counters of the rows; at most `counters` rows.

    Merged summaries undercount by at most rows / counters, so a digest above that share is always named.
    """
    named = (digests.select("digest").mapInArrow(summaries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "digest").limit(counters).select("digest"))
    counted = digests.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.filter(F.col("group_size") > 1)


def winners(digests: DataFrame, scratch: Scratch, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(heavy, rest): per digest the id that stays and the size of its group."""
    heavy = scratch.keep(frequent(digests, counters).coalesce(1), "heavy")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return heavy, rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays. Null and empty texts are equal. A null doc_id stays only
    where its group has no other. Rows repeated with the same doc_id and text are one document: each of
    them counts in group_size and all carry the same `kept`. Other columns of `docs` are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(docs.select("doc_id", F.unhex(digest("text")).alias("digest")), "digests")
    heavy, light = winners(digests, scratch, counters)
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest")
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns; a document repeated whole (same doc_id and text) stays once."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(docs.select("doc_id", F.unhex(digest("text")).alias("digest")), "digests")
    heavy, light = winners(digests, scratch, counters)
    stays = heavy.select("digest", "keep_id").unionByName(light.select("digest", "keep_id"))
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("_id"), F.unhex(digest("text")).alias("_digest"))
    on = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_digest") == F.col("digest"))
    joined = tagged.join(stays.hint("merge"), on, "left_semi")
    again = digests.groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias("again_id"), "digest")
    marked = joined.join(again, F.col("_id").eqNullSafe(F.col("again_id")) & (F.col("_digest") == F.col("digest")), "left")
    once = marked.filter("digest is null").select("row.*")
    return once.unionByName(marked.filter("digest is not null").dropDuplicates(["_id", "_digest"]).select("row.*"))
