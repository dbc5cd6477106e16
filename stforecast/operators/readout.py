"""Ridge readouts from distributed Gram sums, fitted values, and PCA on the same sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stforecast.functions.columns import add_arrays, dot, square_even
from stforecast.functions.numeric import (
    monomials,
    padded_terms,
    ridge_solutions,
    seeded_normal_array,
)
from stforecast.operators.states import check_mode, state_gram
from stforecast.session import broadcast_within, spread

BLOCK = ["run", "layer", "block"]
# Partial rows summed by one group at a time.
SUM_FAN = 1024
# Gram sums one task keeps before it gives them out.
TASK_SUM_BYTES = 256 * 1024 * 1024


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _partial_sums(keys: list[str], stacked):
    """Task body: sums z' [z | y] per key over its batches, emitted as rows.

    ``stacked`` turns the rows of one key into (z, y or None). Sums of many keys are
    given out early when they grow past the budget; later rounds add them up anyway.
    """

    def emit(sums: dict) -> Iterator[pd.DataFrame]:
        for key, total in sums.items():
            out = pd.DataFrame({n: [v] * len(total) for n, v in zip(keys, key, strict=True)})
            yield out.assign(i=np.arange(len(total)), row=list(total))

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        held = 0
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                z, y = stacked(part)
                add = z.T @ (z if y is None else np.hstack([z, y]))
                if key in sums:
                    sums[key] += add
                else:
                    sums[key] = add
                    held += add.nbytes
            if held > TASK_SUM_BYTES:
                yield from emit(sums)
                sums, held = {}, 0
        yield from emit(sums)

    return body


def gram(features: DataFrame, keys: Sequence[str], x: str = "phi", y: str | None = "y") -> DataFrame:
    """Rows of [X X' | X Y'] per key: ``(keys, i, row)``.

    Every task multiplies its own batches and emits one partial per key it holds; only
    those partials are shuffled, never the feature rows.
    """
    keys = list(keys)
    taken = features.select(*keys, x, *([y] if y else []))

    def stacked(part: pd.DataFrame):
        return np.stack(part[x].to_numpy()), np.stack(part[y].to_numpy()) if y else None

    parts = taken.mapInPandas(
        _partial_sums(keys, stacked), f"{_types(features, keys)}, i int, row array<double>"
    )
    return sum_gram(parts.withColumn("part", F.spark_partition_id()), keys)


def delay_gram(
    delayed: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str],
    noise_std: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Gram rows of polynomial delay features, computed where the delay vectors are.

    Only the linear terms travel to the Python side; the monomials (and their noise) are
    formed there. The dictionary has at most MAX_FEATURES short rows.
    """
    keys = list(keys)
    listed = dictionary.orderBy("f").collect()  # bounded by MAX_FEATURES
    ids = np.array([row.f for row in listed], dtype=np.int64)
    terms = padded_terms([row.idx for row in listed])

    def stacked(part: pd.DataFrame):
        phi = monomials(np.stack(part["lin"].to_numpy()), terms)
        if noise_std > 0:
            t = part["t"].to_numpy(np.int64)[:, None]
            phi = phi + noise_std * seeded_normal_array(seed, t, ids[None, :])
        return phi, np.stack(part["y"].to_numpy())

    parts = delayed.select(*keys, "t", "lin", "y").mapInPandas(
        _partial_sums(keys, stacked), f"{_types(delayed, keys)}, i int, row array<double>"
    )
    return sum_gram(parts.withColumn("part", F.spark_partition_id()), keys)


def sum_gram(partials: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Sum partial Gram rows ``(keys, part, i, row)`` over ``part``.

    With many parts the sum is taken in two rounds, so that no group collects more than
    SUM_FAN partial rows at once.
    """
    keys = list(keys)
    rows = partials
    if parts is None or parts > SUM_FAN:
        rows = _sum_rows(
            rows.withColumn("_bucket", F.floor(F.col("part") / SUM_FAN)), [*keys, "i", "_bucket"]
        )
    return _sum_rows(rows, [*keys, "i"])


def _sum_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list("row").alias("_rows")).select(
        *keys, add_arrays(F.col("_rows")).alias("row")
    )


def fit_readout(
    grams: DataFrame, ridges: Sequence[float] | str, keys: Sequence[str] = BLOCK
) -> DataFrame:
    """Ridge readouts W = C (G + r I)^-1 per key: ``(keys, ridge, n_out, coef)``.

    ``coef`` is W row by row. One Gram serves every ridge value: pass a list, or the name
    of an array column on ``grams`` that differs per key.
    """
    keys = list(keys)
    fixed = None if isinstance(ridges, str) else [float(r) for r in ridges]

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        full = np.stack(pdf["row"].to_numpy())
        n = len(full)
        values = list(pdf[ridges].iloc[0]) if fixed is None else fixed
        solved = ridge_solutions(full[:, :n], full[:, n:].T, values)
        out = pd.DataFrame({name: [v] * len(values) for name, v in zip(keys, key, strict=True)})
        return out.assign(
            ridge=values, n_out=full.shape[1] - n, coef=[w.ravel() for w in solved]
        )

    return spread(grams, *keys).groupBy(*keys).applyInPandas(
        solve, f"{_types(grams, keys)}, ridge double, n_out int, coef array<double>"
    )


def readout_residual(grams: DataFrame, readouts: DataFrame, keys: Sequence[str] = BLOCK) -> DataFrame:
    """Largest |W(G + rI) - C| of every readout, relative to the largest |C|."""
    keys = list(keys)

    def check(key: tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        full = np.stack(left.sort_values("i")["row"].to_numpy())
        n = len(full)
        g, c = full[:, :n], full[:, n:].T
        rows = [
            (np.abs(np.asarray(r.coef).reshape(-1, n) @ (g + r.ridge * np.eye(n)) - c).max()
             / max(np.abs(c).max(), 1e-300))
            for r in right.itertuples()
        ]
        out = pd.DataFrame({name: [v] * len(rows) for name, v in zip(keys, key, strict=True)})
        return out.assign(ridge=right["ridge"].to_numpy(), residual=rows)

    return grams.groupBy(*keys).cogroup(readouts.groupBy(*keys)).applyInPandas(
        check, f"{_types(grams, keys)}, ridge double, residual double"
    )


def fit_block_readouts(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    washout: int,
    ridges: Sequence[float],
    mode: str = "quadratic",
    segment: int | None = None,
    overlap: int = 0,
    after: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Readouts of every (run, layer, block), all ridge values from one state pass.

    ``starts`` (``segments.starts_of``) makes the segments exact without an overlap.
    """
    n_segments = 1 if segment is None else -(-(stop - start) // segment)
    partial = state_gram(
        inputs, nets, block_map, start, stop, washout, mode, segment, overlap, after, starts
    )
    # a single segment already is the whole sum
    total = partial.drop("part") if n_segments == 1 else sum_gram(partial, BLOCK, n_segments)
    return fit_readout(total, ridges)


def fit_deep_readout(
    inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int,
    washout: int, ridges: Sequence[float], segment: int | None = None, overlap: int = 0,
) -> DataFrame:
    """Readout of a deep net on the squared-even concatenated states (target: next step)."""
    return fit_block_readouts(
        inputs, nets, block_map, start, stop, washout, ridges, "quadratic", segment, overlap, after=True
    )


def fit_delay_readout(
    features: DataFrame, ridges: Sequence[float], keys: Sequence[str] = ("run",),
) -> DataFrame:
    """Ridge readout of polynomial delay features ``(keys, phi, y)``."""
    return fit_readout(gram(features, keys), ridges, keys)


def fitted_values(
    features: DataFrame,
    readouts: DataFrame,
    keys: Sequence[str] = BLOCK,
    x: str = "x",
    mode: str = "quadratic",
    coef_rows: int | None = None,
    coef_width: int = 0,
) -> DataFrame:
    """W phi(x_t) for every stored feature row, as array expressions: adds ``yhat``."""
    check_mode(mode)
    phi = square_even(F.col(x)) if mode == "quadratic" else F.col(x)
    models = broadcast_within(readouts.select(*keys, "n_out", "coef"), coef_rows, 8 * coef_width + 64)
    joined = features.withColumn("_phi", phi).join(models, list(keys))
    yhat = F.transform(
        F.sequence(F.lit(0), F.col("n_out") - 1),
        lambda o: dot(
            F.slice("coef", o * F.size("_phi") + 1, F.size("_phi")), F.col("_phi")
        ),
    )
    return joined.withColumn("yhat", yhat).drop("_phi", "n_out", "coef")


def pca_fit(
    frames: DataFrame, keys: Sequence[str] = ("series",), ratio: float = 0.999,
    fit_until: int | None = None,
) -> DataFrame:
    """Principal components of the frames: ``(keys, k, eigenvalue, ratio, vector)``.

    The covariance comes from the distributed Gram of [1, values]; one group then holds
    the (cells + 1)^2 sums of one key. Keeps the fewest components that reach ``ratio``
    of the variance.
    """
    keys = list(keys)
    part = frames if fit_until is None else frames.filter(F.col("t") < fit_until)
    sums = gram(
        part.select(*keys, F.concat(F.array(F.lit(1.0)), "values").alias("phi")), keys, y=None
    )

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["row"].to_numpy())
        n = g[0, 0]
        mean = g[0, 1:] / n
        cov = (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)
        lam, q = np.linalg.eigh(cov)
        lam, q = np.maximum(lam[::-1], 0.0), q[:, ::-1]
        share = np.cumsum(lam) / lam.sum()
        kept = min(int(np.searchsorted(share, ratio - 1e-12)) + 1, len(lam))
        # the sign of a component is free: make its largest entry positive
        q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
        out = pd.DataFrame({name: [v] * kept for name, v in zip(keys, key, strict=True)})
        return out.assign(
            k=np.arange(kept), eigenvalue=lam[:kept], ratio=share[:kept], vector=list(q.T[:kept])
        )

    return spread(sums, *keys).groupBy(*keys).applyInPandas(
        solve,
        f"{_types(frames, keys)}, k int, eigenvalue double, ratio double, vector array<double>",
    )


def pca_power(components: DataFrame, power: float, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Adds ``weight``: the share of each component in the covariance raised to ``power``.

    A high power leaves the first component alone if the next eigenvalue is well below the
    first; close eigenvalues keep a share each, however near to each other they lie.
    """
    of_key = Window.partitionBy(*keys)
    raised = F.pow(F.col("eigenvalue") / F.max("eigenvalue").over(of_key), F.lit(float(power)))
    return components.withColumn("_raised", raised).withColumn(
        "weight", F.col("_raised") / F.sum("_raised").over(of_key)
    ).drop("_raised")


def _packed_components(components: DataFrame, keys: list[str], n_cells: int | None) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("k", "vector")))
    packed = components.groupBy(*keys).agg(rows.getField("vector").alias("_basis"))
    return broadcast_within(packed, n_cells, 8 * (n_cells or 0) + 64)


def pca_reduce(
    frames: DataFrame, components: DataFrame, keys: Sequence[str] = ("series",),
    n_cells: int | None = None,
) -> DataFrame:
    """Frames in component coordinates (the mean is not subtracted)."""
    joined = frames.join(_packed_components(components, list(keys), n_cells), list(keys))
    values = F.transform("_basis", lambda v: dot(v, F.col("values")))
    return joined.withColumn("values", values).drop("_basis")


def pca_restore(
    frames: DataFrame, components: DataFrame, keys: Sequence[str] = ("series",),
    n_cells: int | None = None,
) -> DataFrame:
    """Frames back in cell coordinates."""
    joined = frames.join(_packed_components(components, list(keys), n_cells), list(keys))
    scaled = F.zip_with("_basis", "values", lambda v, z: F.transform(v, lambda e: e * z))
    return joined.withColumn("values", add_arrays(scaled)).drop("_basis")
