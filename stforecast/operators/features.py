"""Readout features: squared entries, delay embedding, polynomial dictionary."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stforecast.functions.columns import seeded_int, seeded_normal_sql, square_even
from stforecast.sources.panel import KEYS, time_chunks

# A Gram matrix of this many features is 800 MB; the default limit of a model's width.
MAX_FEATURES = 10_000
# Steps per time chunk of the lag windows.
CHUNK = 4096


def squared_states(states: DataFrame, column: str = "x") -> DataFrame:
    """Quadratic readout features of a state table: even entries squared."""
    return states.withColumn(column, square_even(F.col(column)))


def index_combos(linear: DataFrame, size: int) -> DataFrame:
    """Combinations with repetition of the linear indices, ``size`` at a time.

    ``linear`` has one row per index ``i`` (from 0). A row is extended by every index
    not below its last one: a range of a sequence, not a join. Lexicographic by ``idx``.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    n = linear.agg(F.max("i")).first()[0]
    if n is None:
        raise ValueError("at least one linear index is needed")
    if size == 0:
        return linear.filter("i = 0").select(F.array().cast("array<int>").alias("idx"))
    out = linear.select(F.array(F.col("i").cast("int")).alias("idx"))
    top = F.lit(int(n))
    for _ in range(size - 1):
        out = out.select(
            "idx", F.explode(F.sequence(F.element_at("idx", -1), top)).alias("_next")
        ).select(F.concat("idx", F.array("_next")).alias("idx"))
    return out


def feature_length(n_linear: int, degree: int) -> int:
    """Number of features: constant, linear terms, monomials of degree 2..degree."""
    return 1 + n_linear + sum(math.comb(n_linear + p - 1, p) for p in range(2, degree + 1))


def feature_dictionary(linear: DataFrame, degree: int, max_features: int = MAX_FEATURES) -> DataFrame:
    """Rows ``(f, degree, idx)``: 0 is the constant, then linear terms, then monomials.

    More than ``max_features`` features are an error: their Gram matrix, 8 bytes times the
    square, must fit in one task of the fit.
    """
    n = int(linear.agg(F.max("i")).first()[0]) + 1
    if feature_length(n, degree) > max_features:
        raise ValueError(
            f"{feature_length(n, degree)} features exceed {max_features}; reduce the cells or raise max_features"
        )
    # row numbers over at most max_features rows
    out = index_combos(linear, 0).select(F.lit(0).alias("f"), F.lit(0).alias("degree"), "idx")
    start = 1
    for p in range(1, degree + 1):
        order = W.partitionBy("degree").orderBy("idx")
        combos = index_combos(linear, p).withColumn("degree", F.lit(p))
        out = out.unionByName(
            combos.select((F.row_number().over(order) + (start - 1)).cast("int").alias("f"), "degree", "idx")
        )
        start += math.comb(n + p - 1, p)
    return out


def select_features(dictionary: DataFrame, n_features: int, seed: int = 0) -> DataFrame:
    """Seeded choice of features in index order; the constant is always kept.

    ``n_features`` <= 0, or at least the size of the dictionary, keeps everything.
    """
    if n_features <= 0:
        return dictionary
    draw = dictionary.withColumn(
        "_key", F.when(F.col("f") == 0, F.lit(-1).cast("long")).otherwise(seeded_int(seed, "f"))
    )
    return draw.orderBy("_key", "f").limit(n_features).drop("_key").orderBy("f")


def chunk_for(depth: int) -> int:
    """Steps of a time chunk for lags of this depth: longer than the steps it repeats."""
    return max(CHUNK, 4 * depth)


def delay_embed(
    panel: DataFrame, past: int, delay: int, washout: int = 0, keys: Sequence[str] = KEYS,
    chunk: int | None = None,
) -> DataFrame:
    """Lags 0, d, ..., (past-1)d of every cell as columns ``lag0, lag1, ...``.

    Starts at the first step that has a full history after the washout. Steps must be
    dense (see ``complete_panel``).
    """
    depth = (past - 1) * delay
    w = W.partitionBy(*keys, "cell", "_chunk").orderBy("t")
    lags = [F.lag("value", j * delay).over(w).alias(f"lag{j}") for j in range(past)]
    cut = time_chunks(panel.select(*keys, "t", "cell", "value"), chunk or chunk_for(depth), back=depth)
    return (
        cut.select(*keys, "t", "cell", "_own", *lags)
        .filter(F.col("_own") & (F.col("t") >= washout + depth)).drop("_own")
    )


def next_step_target(
    panel: DataFrame, keys: Sequence[str] = KEYS, chunk: int = CHUNK
) -> DataFrame:
    """Add ``target``: the value one step later; the last step has none."""
    w = W.partitionBy(*keys, "cell", "_chunk").orderBy("t")
    ahead = time_chunks(panel, chunk, ahead=1).withColumn("target", F.lead("value").over(w))
    return ahead.filter(F.col("_own") & F.col("target").isNotNull()).drop("_own", "_chunk")


def delay_frames(
    frames: DataFrame, past: int, delay: int, washout: int = 0, keys: Sequence[str] = KEYS,
    chunk: int | None = None,
) -> DataFrame:
    """Delay vectors of whole frames: ``lin`` (lag-major, then cell) and target ``y``."""
    depth = (past - 1) * delay
    w = W.partitionBy(*keys, "_chunk").orderBy("t")
    lags = [F.lag("values", j * delay).over(w) for j in range(past)]
    cut = time_chunks(frames.select(*keys, "t", "values"), chunk or chunk_for(depth), back=depth, ahead=1)
    vectors = cut.select(
        *keys, "t", "_own", F.concat(*lags).alias("lin"), F.lead("values").over(w).alias("y")
    )
    return vectors.filter(
        F.col("_own") & (F.col("t") >= washout + depth) & F.col("y").isNotNull()
    ).drop("_own")


def pack_dictionary(dictionary: DataFrame) -> DataFrame:
    """The dictionary as one row: an array of index arrays in feature order."""
    rows = F.array_sort(F.collect_list(F.struct("f", "idx")))
    return dictionary.agg(rows.getField("idx").alias("terms"), rows.getField("f").alias("feature_ids"))


def poly_features(delayed: DataFrame, dictionary: DataFrame, width: int | None = None) -> DataFrame:
    """Feature vector ``phi`` of every delay vector, as array expressions in the JVM.

    The packed dictionary is one row of at most MAX_FEATURES short arrays.
    """
    packed = F.broadcast(pack_dictionary(dictionary))  # bounded by MAX_FEATURES
    phi = F.transform(
        F.col("terms"),
        lambda term: F.aggregate(
            term, F.lit(1.0), lambda product, i: product * F.get(F.col("lin"), i)
        ),
    )
    return (
        delayed.withColumn("_one", F.lit(1)).join(packed.withColumn("_one", F.lit(1)), "_one")
        .select(*delayed.columns, phi.alias("phi"), "feature_ids")
    )


def jitter_features(features: DataFrame, noise_std: float, seed: int = 0) -> DataFrame:
    """Gaussian noise on every feature, the constant included.

    The draw depends on (seed, t, feature) only, so it does not change with the
    partitioning or when a task is re-run.
    """
    if noise_std <= 0:
        return features
    noise = f"{float(noise_std)!r}D * {seeded_normal_sql(seed, 't', 'f')}"
    noisy = F.expr(f"zip_with(phi, feature_ids, (v, f) -> v + {noise})")
    return features.withColumn("phi", noisy)
