import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.llm import hard_negatives as hn
from stforecast.llm.hard_negatives import Block, Miner, mine_hard_negatives, spanning_tree

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string, code string, wanted int"


def brute(rows, every, n_positives=5, k=10):
    known = [(i, [math.floor(256 * x) for x in e], g) for i, e, g in rows
             if None not in (i, e, g) and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for i, e, g in known:
        if i % every == 0 and (i not in anchors or (str(g), e) < anchors[i]):
            anchors[i] = (str(g), e)
    out = []
    for a, (label, e) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(e, v, strict=False)), i, str(g) == label) for i, v, g in known if i != a)
        positives = [(i, -s) for s, i, same in scored if same][:n_positives]
        for p, high in sorted(set(positives)):
            inside = [(i, -s) for s, i, same in scored if not same and 30 * high <= -100 * s <= 90 * high][:k]
            out += [(a, p, rank, i, high, s) for rank, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def found(df, every, **how):
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % every == 0, **how).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("labels", [1, 2, 7])
def test_many_blocks_equal_brute_force(spark, monkeypatch, labels):
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 8)
    monkeypatch.setattr(hn, "SLICE", 40)
    draw = np.random.default_rng(labels)
    base = draw.normal(size=(12, 16)) / 2 + 0.4
    rows = [(i, (base[i % 12] + 0.3 * draw.normal(size=16) * (i % 4)).tolist(), int(i * 7919 % labels)) for i in range(600)]
    assert found(frame(spark, rows), 12) == brute(rows, 12)
    assert found(frame(spark, rows), 30, n_positives=2, k=3) == brute(rows, 30, 2, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 2), (4, [inf, 0.0], 1), (5, [], 1),
            (6, [1.0, 2.0], 1), (7, [0.5, 1.0], 2), (8, [0.4, 0.9], 2), (8, [0.4, 0.9], 2), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], None),
            (10, [5.0], 3), (10, [5.0], 3), (11, [2.0], 2), (12, [3.0], 3), (20, [0.5, 0.5, 9.0], 3), (30, [-1.0, -2.0], 1),
            (40, [0.0, 0.0], 2)]
    assert found(frame(spark, rows), 10) == brute(rows, 10)


def test_no_rows_or_no_anchors(spark):
    df = frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])
    assert found(df, 100) == [] and found(df.where("false"), 1) == []


def test_tree_spans_and_bounds_spare_work():
    draw = np.random.default_rng(3)
    centres = draw.integers(-200, 200, (4, 32))
    anchors = np.concatenate([c + draw.integers(-6, 6, (20, 32)) for c in centres])
    order, parent, edge = spanning_tree(anchors)
    assert sorted(order) == list(range(80)) and (parent >= 0).sum() == 79
    placed = {int(order[0])}
    for q in order[1:]:
        assert int(parent[q]) in placed
        assert edge[q] >= np.linalg.norm(anchors[q] - anchors[parent[q]])
        placed.add(int(q))
    wanted = np.tile(np.array([[[3 * 10**5, 2**62]]]), (80, 1, 1))
    block = np.concatenate([c + draw.integers(-6, 6, (300, 32)) for c in centres])
    miner = Miner(Block(np.arange(80), np.zeros(80, int), anchors, wanted), 10, False)
    miner.add(Block(np.arange(1000, 2200), np.ones(1200, int), block, wanted[:0]))
    assert miner.rescored < 0.6 * 80 * 1200  # most candidates never meet most anchors
    for q in range(80):
        scores = block @ anchors[q]
        best = sorted(((-s, i + 1000) for i, s in enumerate(scores) if s >= 3 * 10**5))[:10]
        assert [(-s, i) for s, i in best] == list(zip(*(x.tolist() for x in miner.best[q][0][::-1]), strict=True))


def best_of(block, ids, anchor, windows, k):
    scored = sorted((-s, i) for s, i in zip((block @ anchor).tolist(), ids, strict=True))
    return [[(i, -s) for s, i in scored if low <= -s <= high][:k] for low, high in windows]


@pytest.mark.parametrize("size", [100, 10**5, 10**8])
def test_anchors_that_bounds_do_not_help_are_scored_whole(size):
    """Vectors in all directions lie too far apart for bounds; the sizes need three types of numbers."""
    draw = np.random.default_rng(size)
    anchors, block = (draw.integers(-size, size, (n, 24)) for n in (30, 9000))
    wanted = np.array([[(3, 9), (-(2**40), 8), (1, 0)]] * 30) * np.array([size**2 // 3, size**2 // 3])
    miner = Miner(Block(np.arange(30), np.zeros(30, int), anchors, wanted), 10, False)
    for a in range(0, 9000, 4500):
        part = slice(a, a + 4500)
        miner.add(Block(np.arange(100, 9100)[part], np.ones(4500, int), block[part], wanted[:0]))
    assert miner.whole.all()
    got = [[list(zip(*(x.tolist() for x in pair), strict=True)) for pair in windows] for windows in miner.best]
    assert got == [best_of(block, range(100, 9100), a, w, 10) for a, w in zip(anchors, wanted.tolist(), strict=True)]


def test_bounds_are_taken_again_when_they_leave_few():
    """Everything can enter an empty window, little a full one: then a close parent's bounds tell enough."""
    draw = np.random.default_rng(5)
    anchors = 100 + draw.integers(-2, 3, (40, 32))
    block = draw.integers(-100, 101, (30_000, 32))
    wanted = np.tile(np.array([[[-(2**62), 2**62]]]), (40, 1, 1))
    miner = Miner(Block(np.arange(40), np.zeros(40, int), anchors, wanted), 10, False)
    whole = []
    for a in range(0, 30_000, 6000):
        part = slice(a, a + 6000)
        miner.add(Block(np.arange(100, 30_100)[part], np.ones(6000, int), block[part], wanted[:0]))
        whole.append(int(miner.whole.sum()))
    assert whole[0] == 40 and whole[-1] == 1 and miner.rescored < 0.5 * 40 * 30_000
    got = [list(zip(*(x.tolist() for x in windows[0]), strict=True)) for windows in miner.best]
    assert got == [best_of(block, range(100, 30_100), a, w, 10)[0] for a, w in zip(anchors, wanted.tolist(), strict=True)]


def test_blocks_do_not_shrink_with_more_partitions(spark):
    """Every block of anchors gets candidates of its own: small blocks would multiply what is shuffled."""
    spark_parts = spark.conf.get("spark.sql.shuffle.partitions")
    vectors = spark.range(2000).selectExpr("id", "CAST(id % 3 AS string) AS label")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 100)
        assert hn.by_label(vectors, 2000, 512).rdd.getNumPartitions() == 4
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        assert hn.by_label(vectors, 2000, 512).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", spark_parts)
