"""Embedding near-dedup against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from gridspark.llm import pigeonhole


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for n, (i, x) in enumerate(good):
        for j, y in good[n + 1:]:
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, links[i], root(i), i == root(i)) for i, _ in rows)


def collected(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{entry.SMOKE_DIR}/embeddings.parquet").collect()]
    assert collected(entry.queries()["op4_embedding_dedup"](spark, entry.SMOKE_DIR)) == brute(rows)


@pytest.mark.parametrize("dim,block,chunk", [(1, 16, 2048), (3, 2, 5), (24, 8, 40), (40, 16, 64)])
def test_all_pairs(spark, dim, block, chunk):
    """Clusters around the threshold, scaled copies, and a few vectors that cannot be compared."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=dim) * 0.22 * np.sqrt(1 / 1)) * rng.choice([1e-20, 1.0, 1e15])]) for i in range(240)]
    rows += [(300, [0.0] * dim), (301, None), (302, []), (303, [float("nan")] * dim), (304, [float("inf")] + [1.0] * (dim - 1)), (305, [None] * dim), (306, rows[0][1]), (307, rows[0][1]), (308, [1.0] * (dim + 1))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, id int, copies double").repartition(3)
    assert collected(pigeonhole.near_vectors(df, block=block, chunk=chunk)) == brute(rows)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (2, [0.95, 0.1]), (2, [0.95, 0.1])], "vec_id long, embedding array<float>")
    got = Counter(map(tuple, pigeonhole.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == Counter({(1, 3, 1, True): 1, (None, 3, 1, False): 1, (None, 0, None, True): 1, (2, 3, 1, False): 2})
    assert pigeonhole.near_vectors(df.limit(0)).count() == 0
    assert pigeonhole.near_vectors(df.filter("embedding is null")).count() == 1


def test_several_vectors_of_one_id(spark):
    """1 is next to one vector of 7, 9 next to the other: they do not meet."""
    rows = [(1, [1.0, 0.0, 0.0]), (7, [1.0, 0.01, 0.0]), (7, [0.0, 0.0, 1.0]), (9, [0.0, 0.01, 1.0])]
    got = sorted(map(tuple, pigeonhole.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == [(1, 1, 1, True), (7, 1, 1, False), (7, 1, 7, True), (9, 1, 7, False)]


def test_every_rotation_keeps_distances():
    for dim in (1, 2, 64):
        r = pigeonhole.rotation(dim)
        assert np.allclose(r @ r.T, np.eye(dim))
    assert pigeonhole.cuts(64, 16) == [(0, 16), (16, 32), (32, 48), (48, 64)] and pigeonhole.cuts(3, 16) == [(0, 3)]
