"""Hard negatives of anchors, with score bounds carried along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.exact_topk import Best, exact_type, narrow, padded
from stforecast.llm.shared import query, table, written

SCALE = 256
ROWS = 8192  # candidates of a block
ANCHORS = 512  # anchors of a block, one tree
SLICE = 2048  # candidates whose bounds a task holds for all anchors of a tree
BLOCKS = 64  # candidate blocks that one task goes through for one anchor block
SAMPLE = 256  # candidates that tell what bounds would leave
FEW, MOST = 1 / 16, 1 / 2  # shares of candidates left by the bounds: bounds are taken again, are left out
PACKED = "first string, last string, ids binary, codes binary, matrix binary, wanted binary"
FOUND = "anchor_id long, wanted_at int, vec_id long, score long"


@dataclass
class Block:
    """Vectors by row, with the label and number of each; labels are hashes, equal for equal labels."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    wanted: np.ndarray  # of anchors: low and high score of each window, int64 (anchors, windows, 2)

    @classmethod
    def unpacked(cls, ids: bytes, codes: bytes, matrix: bytes, wanted: bytes | None) -> Block:
        names = np.frombuffer(ids, np.int64)
        values = np.frombuffer(matrix[1:], f"<i{matrix[0]}").reshape(len(names), -1)
        windows = np.frombuffer(wanted or b"", np.int64)
        windows = windows.reshape(len(names), -1, 2) if len(windows) else np.zeros((len(names), 0, 2), np.int64)
        return cls(names, np.frombuffer(codes, np.int64), values, windows)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Length of each vector, a little above rounding."""
    return np.linalg.norm(vectors.astype(float), axis=1) * (1 + 1e-9)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree by distance: the anchors from the root on, each one's parent, the
    length of the edge between them (a little above rounding)."""
    points = vectors.astype(float)
    n, square = len(points), (points**2).sum(1)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    near, by, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    for k in range(n):
        order[k], out[at] = at, False
        parent[at] = by[at]
        if by[at] >= 0:
            edge[at] = np.sqrt(((points[at] - points[by[at]]) ** 2).sum()) * (1 + 1e-9)
        away = square + square[at] - 2 * (points @ points[at])
        closer = out & (away < near)
        near[closer], by[closer] = away[closer], at
        at = int(np.where(out, near, np.inf).argmin())
    return order, parent, edge


class Miner:
    """The best candidates in each window of each anchor of one block, over the candidates seen.

    The root of the tree meets every candidate. A child's score differs from its parent's by at
    most the edge times the candidate's length; only candidates whose bounds reach a window (and
    what it still takes to enter it) are scored again, for the others the bounds go on down.
    Anchors whose bounds leave most candidates are scored against whole slices, in one product,
    until a sample of their scores tells that bounds would leave few.
    """

    def __init__(self, anchors: Block, k: int, same_label: bool):
        self.anchors, self.k, self.same = anchors, k, same_label
        self.order, self.parent, self.edge = spanning_tree(anchors.vectors)
        self.longest = lengths_of(anchors.vectors).max(initial=0)
        self.windows = anchors.wanted.shape[1]
        self.found = Best(anchors.wanted[:, :, 0].ravel(), k)  # by anchor and window
        self.ceiling = anchors.wanted[:, :, 1]
        self.whole = self.parent < 0
        self.rescored = 0

    def add(self, block: Block) -> None:
        dims = min(self.anchors.vectors.shape[1], block.vectors.shape[1])  # a shorter vector ends in zeros
        lengths = lengths_of(block.vectors)
        kind = exact_type(self.longest * lengths.max(initial=0))
        anchors, vectors = self.anchors.vectors[:, :dims].astype(kind), block.vectors[:, :dims].astype(kind)
        cuts = {*range(0, len(block.ids), SLICE), len(block.ids)}
        if not len(self.found.ids):  # a few candidates first: they tell what it takes to enter
            cuts.add(min(SAMPLE, len(block.ids)))
        for a, b in pairwise(sorted(cuts)):
            part = slice(a, b)
            self._slice(anchors, block.ids[part], block.labels[part], vectors[part], lengths[part], again=a == 0)

    def _slice(self, anchors, ids, labels, vectors, lengths, again: bool) -> None:
        low, high, asks = self._spans(labels)
        whole = np.flatnonzero(self.whole)
        scores = anchors[whole] @ vectors.T
        self.rescored += scores.size - len(ids)  # the root's are no second scores
        least, most = low[whole, None].astype(scores.dtype), high[whole, None].astype(scores.dtype)
        hit = (scores >= least) & (scores <= most)
        i, rows = np.divmod(np.flatnonzero(hit), len(ids))  # much faster than the nonzero of a matrix
        wanted = self._wanted(whole[i], rows, ids, labels)
        i, rows = i[wanted], rows[wanted]
        self._offer(whole[i], ids[rows], scores[i, rows])
        if len(whole) < len(self.order):
            self._by_bounds(anchors, ids, labels, vectors, lengths, low, high, dict(zip(whole.tolist(), scores, strict=True)))
        if again:
            seen, reach = scores[:, :SAMPLE], (self.edge[whole] * lengths.mean())[:, None]
            left = ((seen >= low[whole, None] - reach) & (seen <= high[whole, None] + reach)).mean(axis=1)
            self.whole[whole[asks[whole] & (self.parent[whole] >= 0) & (left <= FEW)]] = False

    def _by_bounds(self, anchors, ids, labels, vectors, lengths, low, high, scores) -> None:
        """Bounds from the parents for all anchors without ``scores``, and the scores they ask for."""
        bounds = {q: (row, row) for q, row in scores.items()}
        found = []
        for q in self.order:
            if q in bounds:
                continue
            reach = self.edge[q] * lengths
            below, above = bounds[self.parent[q]]
            below, above = below - reach, above + reach
            below -= 1e-9 * np.abs(below)  # rounding along the path
            above += 1e-9 * np.abs(above)
            near = np.flatnonzero((above >= low[q]) & (below <= high[q]))
            rows = near[self._wanted(q, near, ids, labels)]
            most = len(near) > MOST * len(ids)
            score = (vectors @ anchors[q])[rows] if most else vectors[rows] @ anchors[q]
            self.rescored += len(rows)
            below[rows] = above[rows] = score
            found.append((np.full(len(rows), q), ids[rows], score))
            bounds[q] = below, above
            self.whole[q] = most
        self._offer(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _wanted(self, q: int | np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether anchor q may take a row: of its label or of the others, and not its own."""
        return ((labels[rows] == self.anchors.labels[q]) == self.same) & (ids[rows] != self.anchors.ids[q])

    def _spans(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor the lowest and highest score that can still enter one of its windows, and
        whether it may take any of these labels at all (nothing enters if not)."""
        present = np.unique(labels)
        asks = np.isin(self.anchors.labels, present)
        if not self.same:
            asks = ~asks | (len(present) > 1)
        floor = self.found.floor.reshape(self.ceiling.shape)
        free = (floor <= self.ceiling) & asks[:, None]
        low, high = np.where(free, floor, 2**62).min(axis=1), np.where(free, self.ceiling, -(2**62)).max(axis=1)
        return low, high, asks

    def _offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of anchors q, to every window that they lie in."""
        scores = scores.astype(np.int64)
        floor = self.found.floor.reshape(self.ceiling.shape)
        i, w = np.nonzero((scores[:, None] >= floor[q]) & (scores[:, None] <= self.ceiling[q]))
        self.found.offer(q[i] * self.windows + w, ids[i], scores[i])

    @property
    def best(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Ids and scores found, the best first, by anchor and window."""
        places = [np.flatnonzero(self.found.at == at) for at in range(self.ceiling.size)]
        pairs = [(self.found.ids[rows], self.found.scores[rows]) for rows in places]
        return [pairs[a : a + self.windows] for a in range(0, len(pairs), self.windows)]

    def rows(self) -> pa.RecordBatch:
        anchor, window = np.divmod(self.found.at, self.windows)
        columns = self.anchors.ids[anchor], window.astype(np.int32), self.found.ids, self.found.scores
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in FOUND.split(", ")])


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (id, label, code, e, wanted) of each partition, in their order, as blocks of at most
    ``rows`` with the smallest and largest label of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            lists, wanted = (part.column(c).combine_chunks() for c in ("e", "wanted"))
            ends = pc.min_max(part.column("label"))
            cells = [ends["min"].as_py(), ends["max"].as_py(), part.column("id").to_numpy().tobytes(),
                     part.column("code").to_numpy().tobytes(), narrow(padded(lists)).tobytes(),
                     wanted.flatten().to_numpy().astype(np.int64).tobytes()]
            kinds = [pa.string()] * 2 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            whole = pa.concat_tables(held)
            while len(whole) >= rows:
                yield block(whole.slice(0, rows))
                whole = whole.slice(rows)
            held = [whole]
        if held and len(held[0]):
            yield block(held[0])

    columns = vectors.select("id", "label", "code", "e", "wanted")
    return columns.mapInArrow(run, PACKED)


def by_label(vectors: DataFrame, count: int, rows: int) -> DataFrame:
    """At most ``count`` vectors in order of label, in no more partitions than it takes blocks of
    ``rows``: every block of anchors is sent candidates of its own, so small blocks cost a shuffle."""
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a common label is spread by the second key
    placed = vectors.repartitionByRange(max(1, min(tasks, -(-count // rows))), "label", F.xxhash64("id"))
    return placed.sortWithinPartitions("label")


def best_in_windows(anchors: DataFrame, candidates: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``(anchor_id, wanted_at, vec_id, score)``: the best k candidates of each task for each window
    of each anchor, of its own label or of the others. Both tables are blocks that lie in order of
    label, so that most pairs of blocks without a common label are never formed for the first,
    and those with one and the same label only never for the second."""
    spark = anchors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = written(anchors.withColumn("part", F.monotonically_increasing_id()))
    parts, many = asked.count(), candidates.count()
    # tasks enough for the cluster, and no task with more than BLOCKS blocks of candidates
    chunks = max(1, min(many, max(-(-2 * tasks // max(parts, 1)), -(-many // BLOCKS))))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    left, right = asked.select("part", "first", "last"), candidates.select("block", "first", "last")
    overlap = (left["first"] <= right["last"]) & (right["first"] <= left["last"])
    only = (left["first"] == left["last"]) & (right["first"] == right["last"]) & (left["first"] == right["first"])
    # blocks meet blocks: a stated query set against all rows
    pairs = left.crossJoin(right).where(overlap if same_label else ~only).select("part", "block", chunk.alias("chunk"))
    bodies = ["ids", "codes", "matrix", "wanted"]
    heads = pairs.select("part", "chunk").distinct().join(asked.select("part", *bodies), "part").select(
        "part", "chunk", F.lit(0).alias("kind"), *bodies)
    rest = pairs.join(candidates.select("block", *bodies), "block").select("part", "chunk", F.lit(1).alias("kind"), *bodies)
    work = heads.unionByName(rest).repartition(tasks, "part", "chunk").sortWithinPartitions("part", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner = None
        for batch in batches:
            for kind, *body in zip(*(batch.column(c) for c in ("kind", *bodies)), strict=True):
                block = Block.unpacked(*(x.as_py() for x in body))
                if kind.as_py() == 1:
                    miner.add(block)
                    continue
                if miner is not None:
                    yield miner.rows()
                miner = Miner(block, k, same_label)
        if miner is not None:
            yield miner.rows()

    return work.mapInArrow(run, FOUND)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 10, low_percent: int = 30,
    high_percent: int = 90, scale: int = SCALE,
) -> DataFrame:
    """The best rows of other labels whose score lies in a window below that of a positive.

    ``vectors`` needs vec_id (long), embedding (array of numbers) and label; other columns are
    ignored, whatever their names. ``is_anchor`` is a condition on vec_id. Components become
    floor(scale * x), scores are integer inner products and must fit 53 bits times 100. Rows with a
    null id, label or vector, or a null or non-finite component, take no part; a shorter vector is
    taken with zeros at its end. Ties go to the smaller vec_id. An anchor meets every row but those
    with its own id; an anchor id that repeats is asked once, as its smallest row. Its positives are
    its ``n_positives`` best rows of its label; the window of a positive is from ``low_percent`` to
    ``high_percent`` of its score (empty for a negative score). A repeated row counts as often as it
    is there; positives with the same id and score have one window. An empty table gives no rows.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors lie in blocks of ANCHORS in order of label, each with a minimum spanning tree of its own;
    candidates in blocks of ROWS. Only blocks meet, and each task gives k rows a window.
    """
    whole = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), whole.alias("e"))
    usable = rows.where(
        "e IS NOT NULL AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    ).select("id", "label", F.xxhash64("label").alias("code"), F.transform("e", lambda x: F.floor(x * scale)).alias("e"))
    none = F.array().cast("array<bigint>").alias("wanted")
    placed = written(by_label(usable.select("*", none), vectors.count(), ROWS))
    candidates = written(blocks(placed, ROWS).withColumn("block", F.monotonically_increasing_id()))
    anchors = written(usable.withColumnRenamed("id", "vec_id").where(is_anchor).groupBy("vec_id").agg(
        F.min(F.struct("label", "code", "e")).alias("a")).select(F.col("vec_id").alias("id"), "a.*"))

    n_anchors = anchors.count()

    def in_blocks(asked: DataFrame) -> DataFrame:
        return blocks(by_label(asked, n_anchors, ANCHORS), ANCHORS)

    lowest, highest = F.lit(-(2**62)), F.lit(2**62)
    asked = anchors.withColumn("wanted", F.array(lowest, highest))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = written(best_in_windows(in_blocks(asked), candidates, n_positives, True).withColumn(
        "n", F.row_number().over(order)).where(F.col("n") <= n_positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct())
    # the bounds of a window as whole scores: 100 s >= low_percent * p and 100 s <= high_percent * p
    low, high = F.col("positive_score") * low_percent, F.col("positive_score") * high_percent
    low = ((low + F.pmod(-low, F.lit(100))) / 100).cast("long")
    high = ((high - F.pmod(high, F.lit(100))) / 100).cast("long")
    listed = positives.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("positive_id", "positive_score", low.alias("low"), high.alias("high")))).alias("p"))
    empty = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))  # a window that nothing enters
    pairs = F.concat(F.transform("p", lambda p: F.array(p["low"], p["high"])), F.array_repeat(empty, n_positives - F.size("p")))
    with_windows = anchors.join(listed, anchors["id"] == listed["anchor_id"]).select(
        "id", "label", "code", "e", F.flatten(pairs).alias("wanted"))
    found = best_in_windows(in_blocks(with_windows), candidates, k, False)
    numbered = listed.select("anchor_id", F.posexplode("p").alias("wanted_at", "p")).select(
        "anchor_id", "wanted_at", "p.positive_id", "p.positive_score")
    best = Window.partitionBy("anchor_id", "wanted_at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(numbered, ["anchor_id", "wanted_at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)
