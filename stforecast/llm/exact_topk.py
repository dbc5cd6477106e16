"""Exact top-k inner-product search, dimension block by block with bounds on what remains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.shared import query, table, written

ROWS = 8192  # vectors of a candidate block
QUERIES = 1024  # vectors of a query block
BLOCKS = 64  # candidate blocks that one task goes through for one query block
DIMS = 8  # dimensions added between two prunings
SLICE = 512  # candidates whose sums a task holds for all queries of a block
PAIRS = 64  # with fewer than one in so many pairs left, pairs go on one by one
SCALE = 1024
SCHEMA = "query_id long, vec_id long, score long"
# types in which whole numbers below a size are exact, the fastest first
EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**53))
LOWEST = np.iinfo(np.int64).min


class Block:
    """Vectors in vertical layout: one row per dimension, one column per vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, vectors
        starts = range(0, vectors.shape[0], DIMS)
        mass = [(vectors[d : d + DIMS].astype(float) ** 2).sum(0) for d in starts]
        rest = np.sqrt(np.cumsum(mass[::-1], axis=0)[::-1]) if mass else np.zeros((0, len(ids)))
        # the length of what is still to come, a little above the rounding error of single precision
        self.rest = np.vstack([rest, np.zeros((1, len(ids)))]) * (1 + 1e-6)


class Best:
    """The k best (score, smaller id first) of all that is offered for each of some places."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()  # the lowest score that can still enter, by place
        self.last = np.full(len(floor), np.iinfo(np.int64).max)  # and with that score, the largest id
        self.at, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor[at]
        enters = (scores > floor) | ((scores == floor) & (ids <= self.last[at]))
        met = np.zeros(len(self.floor), bool)
        met[at[enters]] = True
        old = met[self.at]
        rest = self.at[~old], self.ids[~old], self.scores[~old]
        at, ids, scores = (np.concatenate([kept[old], new[enters]]) for kept, new in
                           ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full, stay = rank == self.k - 1, rank < self.k
        self.floor[at[full]], self.last[at[full]] = scores[full], ids[full]
        self.at, self.ids, self.scores = (
            np.concatenate([kept, new[stay]]) for kept, new in zip(rest, (at, ids, scores), strict=True))


class TopK:
    """The k best (score, smaller id first) of one query block over the candidate blocks seen."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.best = Best(np.full(len(queries.ids), LOWEST), k)

    def add(self, block: Block) -> None:
        dims = min(len(self.queries.columns), len(block.columns))  # a shorter vector ends in zeros
        kind = exact_type(self.queries.rest[0].max(initial=0) * block.rest[0].max(initial=0))
        columns, wanted = block.columns[:dims].astype(kind), self.queries.columns[:dims].T.astype(kind)
        for a in range(0, len(block.ids), SLICE):
            part = slice(a, a + SLICE)
            self._search(wanted, columns[:, part], block.ids[part], block.rest[:, part])

    def _search(self, wanted, columns, ids, rest) -> None:
        """All pairs together while many are left, then pairs alone, DIMS dimensions at a time."""
        dims, own, floor = len(columns), self.queries.rest, self.best.floor
        need = floor - 1e-6 * (1 + np.abs(floor.astype(float)))  # rounding
        at = self._first_test(dims, need, rest)
        score = wanted[:, :at] @ columns[:at]
        near = self._reached(score, ids) if at == dims else None
        while near is None:
            near = score >= self._bounds(need, at // DIMS, rest, score.dtype)
            if PAIRS * np.count_nonzero(near) > near.size:
                score += wanted[:, at : at + DIMS] @ columns[at : at + DIMS]
                at = min(at + DIMS, dims)
                near = self._reached(score, ids) if at == dims else None
        q, c = np.divmod(np.flatnonzero(near), len(ids))  # much faster than the nonzero of a matrix
        other = ids[c] != self.queries.ids[q]
        q, c = q[other], c[other]
        score = score[q, c]
        for step, d in enumerate(range(at, dims, DIMS), at // DIMS + 1):
            score = score + (wanted[q, d : d + DIMS] * columns[d : d + DIMS, c].T).sum(axis=1)
            stay = score >= need[q] - own[step, q] * rest[step, c]
            q, c, score = q[stay], c[stay], score[stay]
        self.best.offer(q, ids[c], score.astype(np.int64))

    def _first_test(self, dims: int, need: np.ndarray, rest: np.ndarray) -> int:
        """The dimensions after which a usual pair with a sum of nothing falls out (all, if none does)."""
        steps = range(1, -(-dims // DIMS))
        usual = (step for step in steps if self.queries.rest[step].mean() * rest[step].mean() < need.mean())
        return min(DIMS * next(usual, dims), dims)

    def _bounds(self, need: np.ndarray, step: int, rest: np.ndarray, kind: np.dtype) -> np.ndarray:
        """The sum that each pair must have by now, to reach what it takes with the lengths that remain."""
        real = np.float32 if kind == np.float32 else np.float64
        bounds = np.outer(self.queries.rest[step].astype(real), rest[step].astype(real))
        return np.subtract(need.astype(real)[:, None], bounds, out=bounds)

    def _reached(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a whole score can be among the k best, of all seen or of these alone."""
        floor = self.best.floor
        if (floor == LOWEST).any():
            among = self.k + np.unique(ids, return_counts=True)[1].max()  # with the rows of a query's own id
            if among < len(ids):
                floor = np.maximum(floor, np.partition(score, -among, axis=1)[:, -among])
        return score >= floor.astype(score.dtype)[:, None]

    def rows(self) -> pa.RecordBatch:
        columns = self.queries.ids[self.best.at], self.best.ids, self.best.scores
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest integer type for its values, behind a byte that names it."""
    for kind in (np.int16, np.int32, np.int64):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            break
    return np.frombuffer(bytes([np.dtype(kind).itemsize]) + matrix.astype(kind).tobytes(), np.uint8)


def exact_type(longest: float) -> type:
    """The type for inner products of vectors whose lengths multiply to at most ``longest``: no
    partial sum of their products is larger than that (Cauchy-Schwarz)."""
    return next((kind for kind, size in EXACT if longest < size), np.int64)


def padded(lists: pa.ListArray) -> np.ndarray:
    """Whole numbers in lists as one matrix, with zeros behind the shorter ones."""
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    matrix = np.zeros((len(sizes), sizes.max()), np.int64)
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
    return matrix


def unpacked(ids: bytes, matrix: bytes) -> Block:
    names = np.frombuffer(ids, np.int64)
    values = np.frombuffer(matrix[1:], f"<i{matrix[0]}")
    return Block(names, values.reshape(-1, len(names)))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors of each partition in blocks of at most ``rows``: ids and the transposed matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block(part: pa.Table) -> pa.RecordBatch:
            matrix = narrow(padded(part.column("e").combine_chunks()).T)
            cells = part.column("vec_id").to_numpy().tobytes(), matrix.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells], ["ids", "matrix"])

        for batch in batches:
            whole = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            while len(whole) >= rows:
                yield block(whole.slice(0, rows))
                whole = whole.slice(rows)
            held = [whole]
        if held and len(held[0]):
            yield block(held[0])

    return vectors.mapInArrow(run, "ids binary, matrix binary")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for every query row.

    ``vectors`` needs vec_id (long) and embedding (array of numbers); other columns are ignored.
    ``is_query`` is a condition on vec_id. Components become floor(scale * x). Rows with a null
    id, a null vector, or a null or non-finite component take no part; a shorter vector is taken
    with zeros at its end. Ties go to the smaller vec_id; a query meets every row but those with
    its own id, and gets all of them if there are fewer than k. Returns query_id, rank, vec_id,
    score. Inner products must fit 64 bits.

    Candidates lie in vertical blocks. Every query block goes to every candidate block, not
    every row to every row. A task goes through its candidate blocks of one query block in turn,
    adds DIMS dimensions at a time, and keeps only the candidates whose sum so far plus the
    product of the remaining lengths (Cauchy-Schwarz) reaches the k-th best found. All pairs of
    a slice go on together, as products of matrices, while many of them are left; dimensions
    before the first bound that a usual pair misses are added at once. Each task then gives k
    rows a query, of which a last step takes the best.
    """
    whole = F.col("embedding").cast("array<double>")
    usable = written(vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), whole.alias("e")).where(
        "e IS NOT NULL AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    ).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("e")))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("e").alias("e")).coalesce(tasks)
    asked = written(blocks(queries, QUERIES).withColumn("part", F.monotonically_increasing_id()))
    held = written(blocks(usable, ROWS).withColumn("block", F.monotonically_increasing_id()))
    parts, many = asked.count(), held.count()
    # tasks enough for the cluster, and no task with more than BLOCKS blocks of candidates
    chunks = max(1, min(many, max(-(-2 * tasks // max(parts, 1)), -(-many // BLOCKS))))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    to_all = asked.select("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
                          F.lit(0).alias("kind"), "ids", "matrix")
    # blocks meet blocks: a stated query set against all rows
    meeting = held.select("block", chunk.alias("chunk")).crossJoin(asked.select("part"))
    to_each = meeting.join(held.select("block", "ids", "matrix"), "block").select(
        "part", "chunk", F.lit(1).alias("kind"), "ids", "matrix")
    work = to_all.unionByName(to_each).repartition(tasks, "part", "chunk").sortWithinPartitions("part", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for kind, ids, matrix in zip(*(batch.column(c) for c in ("kind", "ids", "matrix")), strict=True):
                block = unpacked(ids.as_py(), matrix.as_py())
                if kind.as_py() == 1:
                    best.add(block)
                    continue
                if best is not None:
                    yield best.rows()
                best = TopK(block, k)
        if best is not None:
            yield best.rows()

    found = work.mapInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op6_exact_top_k", SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
