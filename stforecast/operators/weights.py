"""Random nets from a spec table: one row of parameters in, sparse weight rows out.

A spec row is ``(run, layer, seed, n, g, degree, g_in_rec, g_in_neigh, g_in_layer, tau, dt,
d_rec, d_neigh, d_layer)``; a deep spec row is ``(run, level, seed, nr, rho, leak,
input_scale, inter_scale, sparsity, nu)``. Weights are ``(run, layer, tag, i, j, w)``. All
draws are keyed by (seed, layer, tag, i, j), so thousands of runs build in parallel and a
re-run task builds the same net.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stforecast.functions.columns import seeded_normal, seeded_uniform
from stforecast.session import spread

# stream numbers that keep the draws of different matrices apart
STREAMS = {"input": 11, "keep": 12, "recurrent": 13, "inter": 14}
WEIGHT_COLUMNS = ["run", "layer", "tag", "i", "j", "w"]
STACK_BYTES = 8 << 20  # of dense matrices whose eigenvalues are taken in one call


def layer_params(config: DataFrame, layer: int) -> DataFrame:
    """The rows of one layer of a per-layer parameter table."""
    return config.filter(F.col("layer") == layer)


def with_dimensions(config: DataFrame, dims: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Attach the input counts of each layer's blocks (see ``check_dimensions``)."""
    out = config
    for k, name in enumerate(("d_rec", "d_neigh", "d_layer")):
        value = F.lit(None).cast("int")
        for layer, counts in dims.items():
            value = F.when(F.col("layer") == layer, F.lit(int(counts[k]))).otherwise(value)
        out = out.withColumn(name, value)
    return out


def _symmetric(*key: str | int) -> Column:
    return 2.0 * seeded_uniform(*key) - 1.0


def input_weights(spec: DataFrame, mode: str = "structured") -> DataFrame:
    """Input weights of every spec row.

    ``structured``: each of the D inputs feeds its own q = n div D consecutive units;
    units beyond q*D get no input. ``random``: every unit sees every input. Entries are
    uniform in (-gain, gain) with the gain of the input's role.
    """
    if mode not in ("structured", "random"):
        raise ValueError(f"mode must be structured or random, got {mode!r}")
    d = F.col("d_rec") + F.col("d_neigh") + F.col("d_layer")
    inputs = spec.withColumn("_d", d).filter(F.col("_d") > 0).withColumn(
        "_in", F.explode(F.sequence(F.lit(0), F.col("_d") - 1))
    )
    if mode == "structured":
        q = F.coalesce(F.floor(F.try_divide(F.col("n"), F.col("_d"))), F.lit(0)).cast("int")
        first, count = F.col("_in") * q, q
    else:
        first, count = F.lit(0), F.col("n")
    units = inputs.withColumn("_first", first).withColumn("_count", count).filter(F.col("_count") > 0)
    rows = units.withColumn(
        "i", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1))
    )
    to_neigh = F.col("d_rec")
    to_layer = F.col("d_rec") + F.col("d_neigh")
    tag = F.when(F.col("_in") < to_neigh, "rec").when(F.col("_in") < to_layer, "neigh").otherwise("layer")
    j = (
        F.when(F.col("_in") < to_neigh, F.col("_in"))
        .when(F.col("_in") < to_layer, F.col("_in") - to_neigh)
        .otherwise(F.col("_in") - to_layer)
    )
    gain = (
        F.when(F.col("_in") < to_neigh, F.col("g_in_rec"))
        .when(F.col("_in") < to_layer, F.col("g_in_neigh"))
        .otherwise(F.col("g_in_layer"))
    )
    draw = _symmetric("seed", "layer", STREAMS["input"], "i", "_in")
    return rows.select(
        "run", "layer", tag.alias("tag"), F.col("i").cast("int").alias("i"),
        j.cast("int").alias("j"), (gain * draw).alias("w"),
    )


def _sparse_normal(spec: DataFrame, size: str, density: Column) -> DataFrame:
    """Entry (i, j) is present with the given probability, then standard normal."""
    key = ("seed", "layer")
    grid = spec.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(size) - 1))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    )
    kept = grid.filter(seeded_uniform(*key, STREAMS["keep"], "i", "j") < density)
    return kept.withColumn("w", seeded_normal(*key, STREAMS["recurrent"], "i", "j"))


def raw_recurrent_weights(spec: DataFrame) -> DataFrame:
    """Sparse normal recurrent entries before scaling, density degree / n."""
    return _sparse_normal(spec, "n", F.col("degree") / F.col("n")).select(
        "run", "layer", F.lit("W").alias("tag"), "i", "j", "w"
    )


def whole_nets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (run, layer) in tables of whole nets, with the first row of each net.

    A table has the rows of one batch, and of as many more as its last net goes on for.
    """
    held: list[pa.RecordBatch] = []
    first, last = [0], None

    def table() -> tuple[pa.Table, np.ndarray]:
        return pa.Table.from_batches(held), np.array(first)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([pc.fill_null(batch.column(c).cast(pa.int64()), -(2**63)).to_numpy() for c in ("run", "layer")])
        before = keys[:, :1] if last is None else last
        new = np.flatnonzero((keys != np.hstack([before, keys[:, :-1]])).any(0))
        last = keys[:, -1:]
        if len(new) == 0:
            held.append(batch)
            continue
        rows = sum(b.num_rows for b in held)
        cut = int(new[-1])
        held.append(batch.slice(0, cut))
        first += [rows + int(k) for k in new[:-1]]
        if rows + cut:
            yield table()
        held, first = [batch.slice(cut)], [0]
    if held:
        yield table()


def spectral_radii(nets: pa.Table, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spectral radius of each net of :func:`whole_nets`, many matrices of one size a call."""
    i, j, w = (nets.column(c).to_numpy() for c in ("i", "j", "w"))
    ends = np.append(first[1:], len(w))
    radii = np.empty(len(first))
    for n in np.unique(size):
        same, at_once = np.flatnonzero(size == n), max(1, STACK_BYTES // (8 * int(n) ** 2))
        for k in range(0, len(same), at_once):
            some = same[k : k + at_once]
            counts = ends[some] - first[some]
            rows = np.repeat(first[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            m = np.zeros((len(some), n, n))
            m[np.repeat(np.arange(len(some)), counts), i[rows], j[rows]] = w[rows]
            radii[some] = np.abs(np.linalg.eigvals(m)).max(-1)
    return radii


def scale_to_radius(entries: DataFrame) -> DataFrame:
    """Rescale each net's ``(run, layer, tag, i, j, w, size, radius)`` rows to its radius.

    Eigenvalues need a net's whole matrix, so the non-zero entries of a net meet in one task,
    which streams over its nets: a batch of rows and a stack of matrices are held.
    """

    def rescale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nets, first in whole_nets(batches):
            rho = spectral_radii(nets, first, nets.column("size").to_numpy()[first])
            asked = nets.column("radius").cast(pa.float64()).to_numpy()[first]
            factor = np.divide(asked, rho, out=np.zeros(len(rho)), where=rho > 0)
            w = nets.column("w").to_numpy() * np.repeat(factor, np.diff(np.append(first, nets.num_rows)))
            yield from nets.select(WEIGHT_COLUMNS[:-1]).append_column("w", pa.array(w)).to_batches()

    kinds = {"run": "long", "layer": "int", "i": "int", "j": "int", "w": "double", "size": "int", "radius": "double"}
    typed = entries.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in (*WEIGHT_COLUMNS, "size", "radius")])
    return spread(typed, "run", "layer").sortWithinPartitions("run", "layer").mapInArrow(
        rescale, "run long, layer int, tag string, i int, j int, w double"
    )


def recurrent_weights(spec: DataFrame) -> DataFrame:
    """Sparse normal recurrent weights with spectral radius ``g``."""
    size = spec.select("run", "layer", F.col("n").alias("size"), F.col("g").alias("radius"))
    return scale_to_radius(raw_recurrent_weights(spec).join(size, ["run", "layer"]))


def reservoir_weights(spec: DataFrame, mode: str = "structured") -> DataFrame:
    """All weights of one reservoir per spec row."""
    return recurrent_weights(spec).unionByName(input_weights(spec, mode))


def deep_input_weights(spec: DataFrame) -> DataFrame:
    """Level 0: structured input weights. Deeper levels: dense links from the level above."""
    first = spec.filter("level = 0").select(
        "run", F.col("level").alias("layer"), "seed", F.col("nr").alias("n"),
        F.col("input_scale").alias("g_in_rec"), F.lit(0.0).alias("g_in_neigh"),
        F.lit(0.0).alias("g_in_layer"), F.col("nu").alias("d_rec"),
        F.lit(0).alias("d_neigh"), F.lit(0).alias("d_layer"),
    )
    units = F.sequence(F.lit(0), F.col("nr") - 1)
    links = (
        spec.filter("level > 0").withColumn("i", F.explode(units)).withColumn("j", F.explode(units))
    )
    draw = _symmetric("seed", "level", STREAMS["inter"], "i", "j")
    return input_weights(first).unionByName(
        links.select(
            "run", F.col("level").alias("layer"), F.lit("inter").alias("tag"), "i", "j",
            (F.col("inter_scale") * draw).alias("w"),
        )
    )


def deep_weights(spec: DataFrame) -> DataFrame:
    """All weights of a deep net; ``layer`` is the depth level."""
    levels = spec.withColumn("layer", F.col("level"))
    entries = _sparse_normal(levels, "nr", F.col("sparsity")).select(
        "run", "layer", F.lit("W").alias("tag"), "i", "j", "w",
        F.col("nr").alias("size"), F.col("rho").alias("radius"),
    )
    return scale_to_radius(entries).unionByName(deep_input_weights(spec))


def pack_reservoir(spec: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per (run, layer): sizes, leak and the weights as parallel arrays.

    Input columns of the three roles are laid side by side in the order rec, neigh, layer.
    """
    offset = (
        F.when(F.col("tag") == "neigh", F.col("d_rec"))
        .when(F.col("tag") == "layer", F.col("d_rec") + F.col("d_neigh"))
        .otherwise(F.lit(0))
    )
    entry = F.struct(
        F.lit(0).alias("level"), F.when(F.col("tag") == "W", 0).otherwise(1).alias("kind"),
        "i", (F.col("j") + offset).alias("j"), "w",
    )
    dims = spec.select("run", "layer", "n", "tau", "dt", "d_rec", "d_neigh", "d_layer")
    packed = (
        dims.join(weights, ["run", "layer"], "left")
        .groupBy("run", "layer", "n", "tau", "dt", "d_rec", "d_neigh", "d_layer")
        .agg(F.collect_list(F.when(F.col("tag").isNotNull(), entry)).alias("_e"))
    )
    return packed.select(
        "run", "layer", F.array("n").alias("sizes"),
        F.array(F.col("dt") / F.col("tau")).alias("leaks"),
        (F.col("d_rec") + F.col("d_neigh") + F.col("d_layer")).alias("n_inputs"), *_arrays("_e"),
    )


def pack_deep(spec: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per run of a deep net, in the form of :func:`pack_reservoir` (layer 0)."""
    levels = spec.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("level", "nr", "leak"))).alias("_l"),
        F.max("nu").alias("n_inputs"),
    )
    entry = F.struct(
        F.col("layer").alias("level"), F.when(F.col("tag") == "W", 0).otherwise(1).alias("kind"),
        "i", "j", "w",
    )
    entries = weights.groupBy("run").agg(F.collect_list(entry).alias("_e"))
    return levels.join(entries, "run").select(
        "run", F.lit(0).alias("layer"), F.col("_l.nr").alias("sizes"),
        F.col("_l.leak").alias("leaks"), "n_inputs", *_arrays("_e"),
    )


def _arrays(entries: str) -> list[Column]:
    return [F.col(f"{entries}.{c}").alias(f"w_{c}") for c in ("level", "kind", "i", "j", "w")]
