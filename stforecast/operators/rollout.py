"""Free-running forecasts over many runs and forecast origins at once.

Blocks of one run exchange values at every step, so one group is one (run, layer, origin)
with its warm-up frames, readouts and coarse inputs; Spark spreads runs and origins. The
group's size is known before it is built and is checked.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.functions.numeric import monomials, padded_terms, squared_evens
from stforecast.operators.blocks import pack_blocks
from stforecast.operators.states import NET, check_mode, net_from_row
from stforecast.session import filled, spread

FORECAST_SCHEMA = "run long, layer int, origin long, t long, cell int, yhat double"
STATE_SCHEMA = "run long, layer int, origin long, block int, t long, x array<double>"
SYSTEM = ["run", "layer", "origin"]
# One forecast group is one whole coupled system; refuse what no task could hold.
MAX_SYSTEM_BYTES = 2 * 1024**3


def origin_table(runs: DataFrame, origins) -> DataFrame:
    """Rolling origins: every run at every origin, as rows ``(run, origin)``."""
    listed = F.array(*[F.lit(int(o)).cast("long") for o in origins])
    return runs.select("run", F.explode(listed).alias("origin"))


def _steps_of(origins: DataFrame, before: int, after: int) -> DataFrame:
    """The absolute steps each (run, origin) reads; an equi-join key, not a range join."""
    first, last = F.col("origin") - before, F.col("origin") + (after - 1)
    return origins.select("run", "origin", F.explode(F.sequence(first, last)).alias("t"))


def _coarse_of(
    past: DataFrame, ahead: DataFrame | None, origins: DataFrame, warmup: int, steps: int
) -> DataFrame:
    """Coarse values ``(run, origin, t, values)`` that each origin reads, in equi-joins."""
    columns = ["run", "origin", "t", "values"]
    past = past.select("run", "t", "values")
    if ahead is None:
        return past.join(_steps_of(origins, warmup, steps), ["run", "t"]).select(*columns)
    own = ahead.select(*columns).join(_steps_of(origins, 0, steps), ["run", "origin", "t"])
    if warmup == 0:
        return own.select(*columns)
    before = past.join(_steps_of(origins, warmup, 0), ["run", "t"])
    return before.select(*columns).unionByName(own.select(*columns))


def _latest_kept(nets: DataFrame, origins: DataFrame, kept: DataFrame) -> DataFrame:
    """The latest kept step (x0_t) at or before each (run, layer, origin)."""
    times = kept.select("run", "layer", "x0_t").distinct()
    near = nets.select("run", "layer").join(origins, "run").join(times, ["run", "layer"])
    return near.where("x0_t <= origin").groupBy(*SYSTEM).agg(F.max("x0_t").alias("x0_t"))


def system_bytes(n_cells: int, n_features: int, window: int, n_states: int = 0) -> int:
    """What one task holds of a coupled system: its readouts, its window of values, kept states."""
    return 8 * (n_cells * (n_features + 2 * window) + n_states * window)


def check_system_size(
    n_cells: int, n_features: int, window: int, max_bytes: int = MAX_SYSTEM_BYTES, n_states: int = 0
) -> None:
    """Refuse a coupled system whose readouts and window do not fit in one task."""
    need = system_bytes(n_cells, n_features, window, n_states)
    if need > max_bytes:
        raise ValueError(f"one forecast group holds {need} bytes; raise max_bytes or use fewer cells")


def rollout_blocks(
    frames: DataFrame,
    nets: DataFrame,
    readouts: DataFrame,
    block_map: DataFrame,
    origins: DataFrame,
    warmup: int,
    steps: int,
    mode: str = "quadratic",
    coarse_frames: DataFrame | None = None,
    after: bool = False,
    y_init: list[float] | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
    coarse_ahead: DataFrame | None = None,
    states: bool = False,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Warm up on true values, then feed the predictions back for ``steps`` steps.

    ``frames`` is ``(run, layer, t, values)``, ``coarse_frames`` ``(run, t, values)``; an
    origin is the first step to forecast. With ``coarse_ahead`` ``(run, origin, t, values)`` the
    coarse values from an origin on are those of that origin's own coarse forecast, and
    ``coarse_frames`` is read before the origins only. Each step all blocks give their output first,
    then all advance on their own and their neighbours' predicted values. The result
    covers the warm-up as well; ``t`` is always the step the value is for. Readouts with a column
    ``origin`` serve that origin alone. A system of more
    than ``max_bytes`` (readouts and window) fails; its task must hold it whole.

    ``states=True`` returns the states behind these values instead,
    ``(run, layer, origin, block, t, x)``: those the output for t is read from, over the
    warm-up and the free run.

    With ``kept`` states (run, layer, block, x0_t, x0), as ``segments.segment_starts`` returns, each
    origin warms up from the latest kept step at or before it, instead of ``warmup`` steps from
    zero: its states are those of the whole history, at the cost of the steps since. An origin
    without a kept state fails, and so does one whose blocks are not all kept at that step.
    """
    check_mode(mode)
    if steps < 1:
        raise ValueError("steps must be at least 1")
    systems = nets.join(origins, "run")
    head = systems.select(*SYSTEM, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("t"), *NET)
    own = ["run", "origin"] if "origin" in readouts.columns else ["run"]  # refitted for each origin, or not
    models = (
        readouts.select(*own, "layer", "block", "coef")
        .join(pack_blocks(block_map), ["layer", "block"])
        .join(origins, own)
        .select(*SYSTEM, F.lit(1).alias("kind"), F.col("block").cast("long").alias("t"), "coef",
                "rec_cells", "neigh_cells", "layer_cells")
    )
    window = _steps_of(origins, warmup, 0) if warmup > 0 else None
    resumed = kept is not None
    if resumed:
        if coarse_frames is not None:
            raise ValueError("kept states serve layers without coarse inputs")
        begins = _latest_kept(nets, origins, kept)
        held = kept.select("run", "layer", "block", "x0_t", "x0")
        models = models.withColumn("block", F.col("t").cast("int")).join(begins, SYSTEM, "left").join(
            held, ["run", "layer", "block", "x0_t"], "left").drop("block")
        window = begins.where("x0_t < origin").select(
            "run", "origin", F.explode(F.sequence(F.col("x0_t"), F.col("origin") - 1)).alias("t")).distinct()
    parts = [head, models]
    layers = nets.select("run", "layer")
    if window is not None:
        true = frames.join(window, ["run", "t"]).select(
            *SYSTEM, F.lit(2).alias("kind"), "t", "values"
        )
        parts.append(true)
    if coarse_frames is not None:
        upper = _coarse_of(coarse_frames, coarse_ahead, origins, warmup, steps).join(layers, "run")
        parts.append(upper.select(*SYSTEM, F.lit(3).alias("kind"), "t", "values"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)

    def roll(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        run, layer, origin = (int(v) for v in key)
        heads = pdf[pdf["kind"] == 0]
        blocks = pdf[pdf["kind"] == 1].sort_values("t")
        if heads.empty or blocks.empty:
            raise ValueError(f"run {run}, layer {layer}: net or readouts are missing")
        net = net_from_row(heads.iloc[0])
        coef = np.stack([np.asarray(c).reshape(-1, sum(net.sizes)) for c in blocks["coef"]])
        rec, neigh, upper = (
            np.stack([np.asarray(c, dtype=int) for c in blocks[name]])
            for name in ("rec_cells", "neigh_cells", "layer_cells")
        )
        cells = rec.size
        before, state = warmup, net.start(len(blocks))
        if resumed:
            if not all(len(x) for x in blocks["x0"]):
                raise ValueError(f"run {run}, layer {layer}: no kept state at or before step {origin}")
            before = origin - int(blocks["x0_t"].iloc[0])
            state = np.split(np.stack(blocks["x0"].to_numpy()).T, np.cumsum(net.sizes)[:-1])
        kept_units = len(blocks) * sum(net.sizes) if states else 0
        check_system_size(cells, coef.shape[2], before + steps, max_bytes, kept_units)

        def values_of(kind: int) -> dict[int, np.ndarray]:
            part = pdf[pdf["kind"] == kind]
            return {int(t): np.asarray(v) for t, v in zip(part["t"], part["values"], strict=True)}

        true, coarse = values_of(2), values_of(3)
        seen = np.zeros(cells) if y_init is None else np.asarray(y_init, dtype=float)
        times, outputs, passed = [], [], []

        def emit() -> np.ndarray:
            x = np.concatenate(state)
            if states:
                passed.append(x.T)
            z = squared_evens(x.T) if mode == "quadratic" else x.T
            out = np.zeros(cells)
            out[rec] = np.einsum("bdn,bn->bd", coef, z)
            return out

        for t in range(origin - before, origin + steps):
            if not after:
                seen = emit()
                times.append(t)
                outputs.append(seen)
            value = true[t] if t < origin else seen
            u = np.hstack([value[rec], value[neigh], coarse[t][upper] if upper.size else upper])
            state = net.advance(state, net.drive(u).T)
            if after:
                seen = emit()
                times.append(t + 1)
                outputs.append(seen)
        n = len(times)
        if states:
            each = len(blocks)
            return pd.DataFrame({
                "run": np.full(n * each, run), "layer": np.full(n * each, layer),
                "origin": np.full(n * each, origin), "block": np.tile(blocks["t"].to_numpy(np.int64), n),
                "t": np.repeat(times, each), "x": list(np.concatenate(passed)),
            })
        return pd.DataFrame({
            "run": np.full(n * cells, run), "layer": np.full(n * cells, layer),
            "origin": np.full(n * cells, origin), "t": np.repeat(times, cells),
            "cell": np.tile(np.arange(cells), n), "yhat": np.concatenate(outputs),
        })

    rows = filled(spread(rows, *SYSTEM), *NET, "coef", "rec_cells", "neigh_cells", "layer_cells", "values", "x0")
    return rows.groupBy(*SYSTEM).applyInPandas(roll, STATE_SCHEMA if states else FORECAST_SCHEMA)


def rollout_deep(
    frames: DataFrame, nets: DataFrame, readouts: DataFrame, block_map: DataFrame,
    origins: DataFrame, warmup: int, steps: int, y_init: list[float] | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES, states: bool = False, kept: DataFrame | None = None,
) -> DataFrame:
    """Closed loop of a deep net: the output after step t is the value for t + 1."""
    return rollout_blocks(
        frames, nets, readouts, block_map, origins, warmup, steps, "quadratic",
        after=True, y_init=y_init, max_bytes=max_bytes, states=states, kept=kept,
    )


def rollout_delay(
    frames: DataFrame,
    readouts: DataFrame,
    dictionary: DataFrame,
    origins: DataFrame,
    past: int,
    delay: int,
    steps: int,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> DataFrame:
    """Closed loop of delay-feature readouts.

    The history holds the 1 + (past-1)*delay steps before the origin; the first
    forecast is for the origin itself.
    """
    depth = 1 + (past - 1) * delay
    terms = F.broadcast(  # one row of at most MAX_FEATURES short arrays
        dictionary.agg(F.array_sort(F.collect_list(F.struct("f", "idx"))).getField("idx").alias("terms"))
    ).withColumn("_one", F.lit(1))
    head = (
        readouts.select("run", "coef").join(origins, "run").withColumn("_one", F.lit(1))
        .join(terms, "_one")
        .select("run", "origin", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("t"), "coef", "terms")
    )
    true = frames.join(_steps_of(origins, depth, 0), ["run", "t"]).select(
        "run", "origin", F.lit(2).alias("kind"), "t", "values"
    )

    def roll(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        run, origin = (int(v) for v in key)
        head_row = pdf[pdf["kind"] == 0].iloc[0]
        seeds = pdf[pdf["kind"] == 2].sort_values("t", ascending=False)
        history = [np.asarray(v) for v in seeds["values"]]
        if len(history) != depth:
            raise ValueError(f"origin {origin} has {len(history)} of {depth} history steps")
        cells = len(history[0])
        coef = np.asarray(head_row["coef"]).reshape(cells, -1)
        check_system_size(cells, coef.shape[1], depth + steps, max_bytes)
        terms = padded_terms(head_row["terms"])
        outputs = []
        for _ in range(steps):
            lin = np.concatenate([history[j * delay] for j in range(past)])
            nxt = coef @ monomials(lin, terms)
            outputs.append(nxt)
            history = [nxt, *history[:-1]]
        n = steps * cells
        return pd.DataFrame({
            "run": np.full(n, run), "layer": np.zeros(n, dtype=int), "origin": np.full(n, origin),
            "t": np.repeat(np.arange(origin, origin + steps), cells),
            "cell": np.tile(np.arange(cells), steps), "yhat": np.concatenate(outputs),
        })

    rows = head.unionByName(true, allowMissingColumns=True)
    rows = filled(spread(rows, "run", "origin"), "coef", "terms", "values")
    return rows.groupBy("run", "origin").applyInPandas(roll, FORECAST_SCHEMA)
