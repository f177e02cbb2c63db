"""Embedding near-dedup (4): a subspace pigeonhole join.

For unit vectors, a cosine of at least c is a squared distance of at most 2 - 2c. The vectors are
rotated and cut into blocks of few dimensions; every block gets a part of the squared distance in
proportion to the variance it holds. If a pair is within the whole distance, it is within the part
of one block at least. Each block is joined by range: vectors fall into cells of their first
coordinate as wide as the block's distance, cells are cut into chunks of bounded size, and chunks
of the same or the next cell are compared strip by strip. Pairs within a block's distance are verified
where they meet, with the whole vectors in double precision, and belong to the first block that finds
them. Pairs are never written down: a task gives each vector's number of links in a pair of chunks, and
a forest that connects what it found linked there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.components import components
from gridspark.llm.store import Scratch

COSINE = 0.9
#: Dimensions of a block, and vectors of a chunk, about.
BLOCK, CHUNK = 16, 8192
#: Rows of a chunk that are compared at a time, and pairs that are verified at a time.
STRIP, PAIRS = 512, 1 << 16
#: Taken on top of a block's distance, far above what rounding can add to it.
SLACK = 1e-9
#: Least distance of a block, far above the slack; it bounds the cells of a block by 2 / LEAST + 1.
LEAST = 1e-3
_BLOCKS_DDL = "block int, cell int, id long, copies long, embedding array<float>"


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int, block: int) -> list[tuple[int, int]]:
    """Block bounds, as equal as can be."""
    edges = np.linspace(0, dim, max(1, round(dim / block)) + 1).round().astype(int)
    return list(zip(edges[:-1], edges[1:]))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each dimension in a batch of (id, vector)."""
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    flat, first = lists.flatten().to_numpy().astype(np.float64), np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        v = flat[first[rows][:, None] + np.arange(dim)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        yield rows, v / np.linalg.norm(v, axis=1, keepdims=True)


def turned(v: np.ndarray) -> np.ndarray:
    """Rotated vectors, with the same rounding whatever other rows there are."""
    return np.einsum("ij,jk->ik", v, rotation(v.shape[1]))


def _energy(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _matrices(batch):
                dim = v.shape[1]
                parts = [float(((v @ rotation(dim)[:, a:b]) ** 2).sum()) for a, b in cuts(dim, block)]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "energy": parts})

    return run


def _blocks(block: int, radii: dict[tuple[int, int], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _matrices(batch):
                dim, own = v.shape[1], batch.take(pa.array(rows))
                at = turned(v)
                for part, (a, _) in enumerate(cuts(dim, block)):
                    # a little wider than the distance with its slack, so that no pair is two cells apart
                    cell = np.floor(at[:, a] / (1.001 * radii[dim, part])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim << 12 | part, np.int32)), pa.array(cell), own.column(0), own.column(2), own.column(1)],
                                                     names=["block", "cell", "id", "copies", "embedding"])

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with by links (a, b)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


class _Side:
    """The vectors of a chunk: ids, copies, as they are, of unit length, and rotated."""

    def __init__(self, side: pa.StructArray):
        self.ids, self.copies = side.field("id").to_numpy(), side.field("copies").to_numpy()
        lists = side.field("embedding")
        self.raw = lists.flatten().to_numpy().astype(np.float64).reshape(len(side), -1)
        scaled = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        self.at = turned(self.unit)


def _linked(x: _Side, y: _Side, first: int, r: np.ndarray, s: np.ndarray, part: int, bounds: list[tuple[int, int]], limits: list[float], cosine: float) -> np.ndarray:
    """Which of the pairs (first + r, s) are links that the blocks before `part` do not find. Every block decides alike."""
    r = r + first
    found = np.einsum("ij,ij->i", x.unit[r], y.unit[s])
    good = found >= cosine - 1e-9
    close = np.flatnonzero(good & (found < cosine + 1e-9))
    if len(close):
        p, q = x.raw[r[close]], y.raw[s[close]]
        good[close] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= cosine
    at = np.flatnonzero(good)
    gap = (x.at[r[at]] - y.at[s[at]]) ** 2
    near = [gap[:, a:b].sum(axis=1) <= limit for (a, b), limit in zip(bounds[:part + 1], limits)]
    good[at] = near[part] & ~np.logical_or.reduce(near[:part], axis=0) if part else near[0]
    return good


def _compare(radii: dict[tuple[int, int], float], cosine: float, block: int):
    """For each pair of chunks (vector, its links there, the least vector that it is connected with there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                dim, part = key >> 12, key & 4095
                bounds = cuts(dim, block)
                limits = [radii[dim, k] ** 2 + SLACK for k in range(len(bounds))]
                x = _Side(batch.column(2)[i].values)
                y = x if same else _Side(batch.column(3)[i].values)
                a, b = bounds[part]
                squares, one, two = (y.at[:, a:b] ** 2).sum(axis=1), [], []
                for first in range(0, len(x.ids), STRIP):
                    own = x.at[first:first + STRIP, a:b]
                    square = (own * own).sum(axis=1)[:, None] + squares - 2 * (own @ y.at[:, a:b].T)
                    meets = square <= limits[part] + SLACK
                    if same:
                        meets &= np.arange(len(y.ids)) > (first + np.arange(len(own)))[:, None]
                    r, s = np.nonzero(meets)
                    for c in range(0, len(r), PAIRS):
                        good = _linked(x, y, first, r[c:c + PAIRS], s[c:c + PAIRS], part, bounds, limits, cosine)
                        one.append(r[c:c + PAIRS][good] + first)
                        two.append(s[c:c + PAIRS][good])
                if not any(map(len, one)):
                    continue
                one, two = np.concatenate(one), np.concatenate(two)
                n = len(x.ids)
                ids, shift = (x.ids, 0) if same else (np.concatenate([x.ids, y.ids]), n)
                others = np.zeros(len(ids), np.int64)
                np.add.at(others, one, y.copies[two])
                np.add.at(others, two + shift, x.copies[one])
                label = forest(one, two + shift, len(ids))
                met = np.flatnonzero(others)
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(others[met]), pa.array(ids[label[met]])], names=["id", "others", "with"])

    return run


def usable(vector: str) -> Column:
    """Not null, not zero, without null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= `cosine`), component_id, kept (vec_id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing, and so do vectors of different
    lengths with each other. Equal vectors are compared once and count as often as they occur; rows repeated whole are
    vectors of their own for n_links, and so are different vectors of one vec_id, each with its own links. A null vec_id takes the component of its equals; it is compared with others only
    through one of them that has an id. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "pigeonhole")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    good = rows.filter(usable("embedding"))
    # distinct vectors have numbers of their own: a vec_id may stand on several
    heads = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    heads = scratch.keep(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    points = heads.filter("least is not null").select("id", "embedding", "copies")

    energy = points.mapInArrow(_energy(block), "dim int, part int, energy double").groupBy("dim", "part").agg(F.sum("energy").alias("energy")).collect()
    whole: dict[int, float] = {}
    for r in energy:
        whole[r["dim"]] = whole.get(r["dim"], 0.0) + r["energy"]
    budget = 2 - 2 * cosine
    radii = {(r["dim"], r["part"]): max(float(np.sqrt(budget * r["energy"] / whole[r["dim"]])), LEAST) for r in energy}
    met = scratch.keep(_links(scratch, points, radii, cosine, block, chunk), "met")
    found = components(met.select(F.col("id").alias("a"), F.col("with").alias("b")), scratch, "components")

    degree = met.groupBy("id").agg(F.sum("others").alias("others"))
    member = scratch.keep(heads.filter("least is not null").select("id", "least").join(found.hint("merge"), "id"), "members")
    # stored before they are joined, so that the join reads two plain shuffles and Spark can split a large component
    names = scratch.keep(member.groupBy("component").agg(F.min("least").alias("name")), "names")
    named = member.select("id", "component").join(names.hint("merge"), "component").select("id", "name")
    classes = scratch.keep(heads.join(degree.hint("merge"), "id", "left").join(named.hint("merge"), "id", "left").select(
        "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("name", "least").alias("component_id")), "classes")
    known = good.join(classes.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(scratch: Scratch, points: DataFrame, radii: dict[tuple[int, int], float], cosine: float, block: int, chunk: int) -> DataFrame:
    """(id, others, with): for each pair of chunks a vector's links there, copies counted, and the least vector it is connected with."""
    if not radii:
        return points.select("id", F.col("id").alias("others"), F.col("id").alias("with")).limit(0)
    cut = scratch.keep(points.mapInArrow(_blocks(block, radii), _BLOCKS_DDL), "blocks")
    # unit vectors: a block has at most 2 / radius + 1 cells
    sizes = scratch.keep(cut.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "sizes")
    dealt = cut.join(F.broadcast(sizes), ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunks = scratch.keep(dealt.groupBy("block", "cell", "chunk", "chunks").agg(F.collect_list(F.struct("id", "copies", "embedding")).alias("points")), "chunks")
    scratch.drop("blocks")
    following = sizes.select("block", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next_chunks"))
    partners = F.concat(F.transform(F.sequence("chunk", F.col("chunks") - 1), lambda q: F.struct(F.col("cell").alias("cell"), q.alias("chunk"))),
                        F.when(F.col("next_chunks") > 0, F.transform(F.sequence(F.lit(0), F.col("next_chunks") - 1), lambda q: F.struct((F.col("cell") + 1).alias("cell"), q.alias("chunk"))))
                        .otherwise(F.array().cast("array<struct<cell:int,chunk:int>>")))
    sought = chunks.join(F.broadcast(following), ["block", "cell"], "left").select("block", "cell", "chunk", F.col("points").alias("left"), F.explode(partners).alias("to"))
    right = chunks.select("block", F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk"), F.col("points").alias("right"))
    met = sought.select("block", F.col("to.cell").alias("to_cell"), F.col("to.chunk").alias("to_chunk"), ((F.col("to.cell") == F.col("cell")) & (F.col("to.chunk") == F.col("chunk"))).alias("same"), "left")
    pairs = met.join(right.hint("merge"), ["block", "to_cell", "to_chunk"]).select("block", "same", "left", F.when(~F.col("same"), F.col("right")).alias("right"))
    return pairs.mapInArrow(_compare(radii, cosine, block), "id long, others long, with long")
