"""Merkle dataset manifest (13): cogrouped subtree exchange.

Every row of a table is a leaf, every 16 consecutive nodes of a source have one parent, and the sources' subroots
form one more tree. The rows' digests are ranked by one range sort. Superblocks of 256 consecutive nodes are reduced
to one node each, level by level, until a node is left; what a superblock needs from outside, the runs of nodes on
the way from it to the root, is one short row. From the root downwards, the nodes of a superblock and its outer
nodes are cogrouped: the group finishes the reduction inside, joins the proofs of its nodes and folds them. Groups
hold 256 nodes at most whatever a source's size, and texts are hashed where they are read; only digests are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.llm.store import Scratch

FANOUT = 16
#: Nodes of a superblock: two levels of the tree.
BLOCK = FANOUT * FANOUT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = (1 << 33) - 1

#: The manifest in DuckDB, over a table `documents` without repeated doc_ids: all levels of all trees by recursion (tree -1 holds
#: the subroots), the way of every leaf as (slot, run) rows, and the folds along it. `crc` is CRC-32 bit by bit.
MANIFEST_SQL = """
    WITH RECURSIVE fields AS (
        SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS a, source AS b, lang AS c, CAST(n_chars AS VARCHAR) AS d, text AS e,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM documents),
    crc(doc_id, k, left_over) AS (
        SELECT doc_id, 0, CAST(4294967295 AS BIGINT) FROM fields WHERE doc_id IS NOT NULL
        UNION ALL
        SELECT doc_id, k + 1, CASE WHEN bit & 1 = 1 THEN xor(bit >> 1, CAST(3988292384 AS BIGINT)) ELSE bit >> 1 END
        FROM (SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(left_over, CAST(ascii(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE left_over END AS bit
              FROM crc WHERE k < 8 * length(CAST(doc_id AS VARCHAR)))),
    chosen AS (SELECT doc_id FROM crc WHERE k = 8 * length(CAST(doc_id AS VARCHAR)) AND xor(left_over, CAST(4294967295 AS BIGINT)) % 5 = 0),
    written AS (
        SELECT doc_id, source, coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-')
               || coalesce(strlen(d) || ':' || d, '-') AS head, coalesce(strlen(e) || ':' || e, '-') AS tail, coalesce(strlen(f) || ':' || f, '-') AS changed FROM fields),
    leaves AS (
        SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n, sha256(head || tail) AS leaf, sha256(head || CASE WHEN doc_id IN (SELECT doc_id FROM chosen) THEN changed ELSE tail END) AS tried
        FROM written),
    low(tree, level, pos, n, digest) AS (
        SELECT tree, 0, pos, n, leaf FROM leaves
        UNION ALL
        SELECT tree, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 16),
    high(tree, level, pos, n, digest) AS (
        SELECT -1, 0, tree, count(*) OVER (), digest FROM low WHERE n = 1
        UNION ALL
        SELECT tree, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY tree, level, pos // 16),
    runs AS (
        SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS digests
        FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY tree, level, pos // 16),
    ways AS (
        SELECT l.doc_id, r.level AS step, (l.pos // CAST(16 ** r.level AS BIGINT)) % 16 AS slot, r.digests
        FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = l.pos // CAST(16 ** (r.level + 1) AS BIGINT)
        UNION ALL
        SELECT l.doc_id, 1000 + r.level, (l.tree // CAST(16 ** r.level AS BIGINT)) % 16, r.digests
        FROM leaves l JOIN runs r ON r.tree = -1 AND r.run = l.tree // CAST(16 ** (r.level + 1) AS BIGINT)),
    steps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step, slot, digests FROM ways),
    proofs AS (SELECT doc_id, sha256(string_agg(array_to_string(digests[1:slot] || digests[slot + 2:16], ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id),
    folds(doc_id, step, digest) AS (
        SELECT doc_id, 0, tried FROM leaves
        UNION ALL
        SELECT f.doc_id, f.step + 1, sha256(array_to_string(s.digests[1:s.slot], '') || f.digest || array_to_string(s.digests[s.slot + 2:16], ''))
        FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
    ends AS (SELECT doc_id, max_by(digest, step) AS folded_root FROM folds GROUP BY doc_id)
    SELECT l.doc_id, l.leaf, sub.digest AS subroot, top.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.digest AS verified
    FROM leaves l JOIN low sub ON sub.tree = l.tree AND sub.n = 1 JOIN high top ON top.n = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN ends e ON e.doc_id = l.doc_id"""


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order, each `-` if null, else its bytes in UTF-8, a colon and itself."""
    written = (columns[c].cast("string") for c in FIELDS)
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in written)), 256))


def lowered(text: Column) -> Column:
    """Only the letters A to Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def every_fifth(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _ranked(scratch: Scratch, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all sources' trees, one row per source): `tree` is the rank of a source, `pos` that of a row in it, `n` its rows.

    Rows are sorted by range and stored with their place, so a rank is the place in a partition plus what earlier
    partitions hold of the source; that table has a row per source and partition that meet. Equal rows are told
    apart by their place in the stored digests, so they never have to be in one partition.
    """
    order = ["source", "doc_id", "digest", "row"]
    rows = digests.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    rows = scratch.keep(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))}), "sorted")
    own = Window.partitionBy("source")
    runs = rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n_here")).withColumns({
        "before": F.coalesce(F.sum("n_here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("n_here").over(own), "opens": F.col("part") == F.min("part").over(own)})
    runs = scratch.keep(runs, "runs")
    opened = runs.filter("opens")
    # a row per partition
    opened_before = opened.groupBy("part").count().withColumn("base", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    rank = (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1).alias("tree")
    sources = scratch.keep(opened.join(opened_before, "part").select("source", rank, "n"), "sources")
    place = runs.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        F.col("r.part").alias("r_part"), F.col("r.source").alias("r_source"), "tree", "r.n", (F.col("before") - F.col("first")).alias("shift"))
    placed = rows.join(place, (F.col("part") == F.col("r_part")) & F.col("source").eqNullSafe(F.col("r_source")))
    return placed.select("tree", (F.col("at") + F.col("shift")).alias("pos"), "n", "doc_id", "digest", "changed"), sources


def _parent(digest: str, n: str) -> Column:
    """The node above a run, which is the node itself in a tree that has one node."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("pos", digest))), lambda x: F.lower(F.hex(x[digest])))
    return F.when(F.first(n) > 1, F.unhex(F.sha2(F.concat_ws("", run), 256))).otherwise(F.first(digest))


def _above(n: Column) -> Column:
    return F.when(n > 1, F.ceil(n / FANOUT)).otherwise(n).cast("long")


def reduced(nodes: DataFrame) -> DataFrame:
    """The nodes two levels up, one per superblock. One shuffle, by superblock; no list is longer than a run."""
    block = nodes.select("tree", "n", "digest", "pos", F.expr(f"pos div {BLOCK}").alias("block")).repartition("tree", "block")
    once = block.groupBy("tree", "block", F.expr(f"pos div {FANOUT}").alias("above")).agg(_parent("digest", "n").alias("digest"), _above(F.first("n")).alias("n"))
    twice = once.withColumnRenamed("above", "pos").groupBy("tree", "block").agg(_parent("digest", "n").alias("digest"), _above(F.first("n")).alias("n"))
    return twice.select("tree", F.col("block").alias("pos"), "n", "digest")


def climb(scratch: Scratch, nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """The nodes given, those two levels up, and so on until every tree has one node; largest: nodes of the largest tree."""
    levels = [nodes]
    while largest > 1:
        levels.append(scratch.keep(reduced(levels[-1]), f"{name}{len(levels)}"))
        largest = -(-largest // BLOCK)
    return levels


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def inside(digests: list[str], n: int) -> list[list[tuple[int, list[str]]]]:
    """For each node of a superblock in order, the (slot, run) of the levels that the superblock spans; n: nodes of the whole tree."""
    paths: list[list] = [[] for _ in digests]
    nodes, width = digests, 1
    while n > 1 and width < BLOCK:
        runs = [nodes[a:a + FANOUT] for a in range(0, len(nodes), FANOUT)]
        for i, path in enumerate(paths):
            path.append((i // width % FANOUT, runs[i // width // FANOUT]))
        nodes, width, n = [_hash(run) for run in runs], width * FANOUT, -(-n // FANOUT)
    return paths


def folded(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a node and the runs on its way, of which only the siblings are read."""
    for slot, run in path:
        digest = _hash([*run[:slot], digest, *run[slot + 1:]])
    return digest


def siblings(path: list[tuple[int, list[str]]]) -> list[str]:
    return [x for slot, run in path for x in (*run[:slot], *run[slot + 1:])]


def _written(path: list[tuple[int, list[str]]]) -> str:
    return " ".join(f"{slot}:{''.join(run)}" for slot, run in path)


def _read(written: str) -> list[tuple[int, list[str]]]:
    parts = (x.split(":") for x in written.split())
    return [(int(slot), [run[a:a + 64] for a in range(0, len(run), 64)]) for slot, run in parts]


_PATHS_DDL = "tree long, pos long, path string, digest binary, subroot string, root string"
_PROOFS_DDL = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _group(finish: Callable[[pd.DataFrame, list, pd.Series], pd.DataFrame]):
    """A function of the nodes and the outer nodes of one superblock."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, above = nodes.sort_values("pos", kind="stable"), outer.iloc[0]
        hexes = [x.hex() for x in nodes["digest"]]
        beyond = _read(above["path"])
        return finish(nodes, [[*path, *beyond] for path in inside(hexes, int(nodes["n"].iloc[0]))], above)

    return run


def _paths(nodes: pd.DataFrame, paths: list, above: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": [_written(p) for p in paths], "digest": nodes["digest"],
                         "subroot": above["subroot"], "root": above["root"]})


def _proofs(nodes: pd.DataFrame, paths: list, above: pd.Series) -> pd.DataFrame:
    leaves, tried = [x.hex() for x in nodes["digest"]], [(b or a).hex() for a, b in zip(nodes["digest"], nodes["changed"])]
    roots = [folded(x, path) for x, path in zip(tried, paths)]
    return pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": leaves, "subroot": above["subroot"], "root": above["root"],
                         "proof_sha256": [_hash(siblings(path)) for path in paths], "folded_root": roots, "verified": [x == above["root"] for x in roots]})


def exchange(nodes: DataFrame, outer: DataFrame, finish: Callable, ddl: str) -> DataFrame:
    """Cogroups nodes with the outer nodes of their superblocks, a row per superblock."""
    left = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block")
    return left.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(_group(finish), ddl)


def manifest(docs: DataFrame, tampered: Callable[[Column], Column] = lowered, chosen: Callable[[Column], Column] = every_fifth) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Leaves of a source ascend by doc_id, nulls first, rows of one doc_id by digest; equal rows are leaves of their own.
    A null source is a source, before all others; a null in another field is written `-`. The folded root is that of
    the row with `tampered(text)` where `chosen(doc_id)` holds, else of the row itself. An empty table has no rows.
    Columns other than the five fields are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    own = {c: F.col(c) for c in FIELDS}
    changed = F.when(chosen(own["doc_id"]), leaf(own | {"text": tampered(own["text"])}))
    digests = scratch.keep(docs.select("source", "doc_id", leaf(own).alias("digest"), changed.alias("changed")), "digests")
    nodes, sources = _ranked(scratch, digests)
    n_sources, largest = sources.agg(F.count("*"), F.max("n")).first()
    levels = climb(scratch, nodes, largest or 0, "nodes")
    subroots = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest")
    tops = climb(scratch, subroots, n_sources, "tops")
    root = F.lower(F.hex("digest"))
    outer = scratch.keep(tops[-1].select("tree", "pos", F.lit("").alias("path"), "digest", root.alias("subroot"), root.alias("root")), "root")
    for k, level in enumerate(reversed(tops[:-1])):
        outer = scratch.keep(exchange(level, outer, _paths, _PATHS_DDL), f"upper{k}")
    outer = outer.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "digest", F.lower(F.hex("digest")).alias("subroot"), "root")
    for k, level in enumerate(reversed(levels[1:-1])):
        outer = scratch.keep(exchange(level, outer, _paths, _PATHS_DDL), f"lower{k}")
    leaves = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))
    proofs = exchange(leaves, outer, _proofs, _PROOFS_DDL)
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))
