import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stforecast.llm import exact_topk
from stforecast.llm.exact_topk import LOWEST, TopK, exact_top_k, padded
from stforecast.llm.exact_topk import Block as VerticalBlock


def brute(rows, k, every):
    vectors = [
        (i, [math.floor(1024 * x) for x in e]) for i, e in rows
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    queries = {}
    for i, e in vectors:
        if i % every == 0:
            queries[i] = min(e, queries.get(i, e))
    out = []
    for q, e in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(e, v, strict=False)), i) for i, v in vectors if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(df, k, every):
    return sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % every == 0, k).collect())


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROWS", 64)
    monkeypatch.setattr(exact_topk, "QUERIES", 8)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(20, 24))
    rows = [(i, (base[i % 20] + 0.2 * draw.normal(size=24) * (i % 3)).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert found(df, 5, 20) == brute(rows, 5, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0]),
            (7, [1.0, 2.0]), (8, [-1.0, 0.0009]), (None, [1.0, 1.0]), (10, [5.0]), (10, [5.0]), (20, [0.5, 0.5, 9.0]),
            (30, [1e6, -1e6])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    assert found(df, 10, 10) == brute(rows, 10, 10)
    assert found(df, 2, 10) == brute(rows, 2, 10)


def test_large_components_are_exact(spark):
    rows = [(i, [float(1e5 + i * 7), -1e5 * i, 3.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 4, 5) == brute(rows, 4, 5)


def test_no_rows_or_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert found(df, 3, 100) == [] and found(df.where("false"), 3, 1) == []


@pytest.mark.parametrize("size", [100, 10**5, 10**8])
@pytest.mark.parametrize("dims", [(24, 24), (21, 13)])
def test_pairs_together_and_alone_find_the_best(size, dims):
    """Close and far vectors, copies of one, repeated ids; the sizes need three types of numbers."""
    draw = np.random.default_rng(size)
    near = draw.integers(-size, size, (30, dims[0]))
    queries = near + draw.integers(-size // 9, size // 9 + 1, near.shape)
    width = min(dims)
    close = near[draw.integers(0, 30, 3000), :width] + draw.integers(-size // 5, size // 5 + 1, (3000, width))
    far = draw.integers(-size, size, (3000, width))
    block = np.concatenate([close, far, np.tile(far[:1], (900, 1)), near[:, :width]])
    block = np.pad(block, ((0, 0), (0, dims[1] - width)))
    ids = np.concatenate([draw.permutation(len(block) - 30) + 100, np.arange(30)])
    ids[:40] = ids[0]
    best = TopK(VerticalBlock(np.arange(30), queries.T), 10)
    for part in np.array_split(draw.permutation(len(block)), 3):
        best.add(VerticalBlock(ids[part], block[part].T))
    rows = best.rows().to_pylist()
    for q in range(30):
        scored = sorted((-s, i) for s, i in zip((block[:, :width] @ queries[q, :width]).tolist(), ids.tolist(), strict=True) if i != q)
        got = sorted((-r["score"], r["vec_id"]) for r in rows if r["query_id"] == q)
        assert got == scored[:10]


def test_dimensions_are_left_out_once_it_is_known_what_it_takes():
    """All dimensions of all pairs before anything is known; later the bounds are met on the way."""
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(5000, 64))
    vectors = np.floor(1024 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int64)
    best, block = TopK(VerticalBlock(np.arange(40), vectors[:40].T), 5), VerticalBlock(np.arange(5000), vectors.T)
    known = []
    for floor in (np.full(40, LOWEST), np.full(40, 400_000), np.full(40, 900_000)):
        known.append(best._first_test(64, floor.astype(float), block.rest))
    assert known == [64, 40, 16]
    # no bound excludes a pair that reaches the score, in single precision either
    scores = vectors[:40] @ vectors.T
    for step in range(1, 8):
        sums = (vectors[:40, : 8 * step] @ vectors[:, : 8 * step].T).astype(np.float32)
        for floor in (scores.min(axis=1), np.median(scores, axis=1), scores.max(axis=1)):
            met = sums >= best._bounds(floor - 1e-6 * (1 + np.abs(floor)), step, block.rest, sums.dtype)
            assert met[scores >= floor[:, None]].all()


def test_lists_become_one_matrix():
    lists = pa.array([[9, 9], [1, 2, 3], [], [4]], pa.list_(pa.int64()))
    assert padded(lists[1:]).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]
    assert padded(lists[2:3]).shape == (1, 0)
