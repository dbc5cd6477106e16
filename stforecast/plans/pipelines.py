"""Whole forecasting pipelines: weights, fit, free run, per run and origin."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.operators.blocks import (
    check_dimensions,
    gather_inputs,
    layer_sizes,
    merge_block_outputs,
)
from stforecast.operators.evaluate import align_forecast, error_curve, sample_curve
from stforecast.operators.features import (
    MAX_FEATURES,
    delay_frames,
    feature_dictionary,
    jitter_features,
    poly_features,
    select_features,
)
from stforecast.operators.readout import (
    delay_gram,
    fit_block_readouts,
    fit_deep_readout,
    fit_readout,
    fitted_values,
    pca_fit,
    pca_reduce,
    pca_restore,
    sum_gram,
)
from stforecast.operators.rollout import (
    MAX_SYSTEM_BYTES,
    origin_table,
    rollout_blocks,
    rollout_deep,
    rollout_delay,
)
from stforecast.operators.stack import stack_gram, window_edges, window_readouts
from stforecast.operators.states import attach_runs, score_one_step
from stforecast.operators.sweep import sweep_runs, sweep_stats
from stforecast.operators.weights import (
    deep_weights,
    layer_params,
    pack_deep,
    pack_reservoir,
    reservoir_weights,
    with_dimensions,
)
from stforecast.session import settle
from stforecast.sources.panel import to_frames

__all__ = [
    "Result", "backtest_refit", "forecast_single_layer", "forecast_layers", "forecast_deep", "forecast_delay",
    "rolling_windows", "sweep_single_layer", "sweep_layers", "sweep_deep", "sweep_delay",
]


@dataclass
class Result:
    """Tables of one fitted layer: all are lazy unless noted by the pipeline."""

    readouts: DataFrame
    fitted: DataFrame | None
    forecast: DataFrame
    nets: DataFrame | None = None


def layer_input(fitted: DataFrame, forecast: DataFrame, train_stop: int) -> DataFrame:
    """Coarse values for the finer layer: the fit up to the training end, then the forecast."""
    past = fitted.filter(F.col("t") < train_stop).select("run", "t", "cell", F.col("yhat").alias("value"))
    ahead = forecast.filter(F.col("t") >= train_stop).select(
        "run", "t", "cell", F.col("yhat").alias("value")
    )
    return past.unionByName(ahead)


def around(frames: DataFrame, origins: Sequence[int], before: int, after: int) -> DataFrame:
    """The steps that free runs from these origins read; the filter reaches the scan."""
    return frames.filter(F.col("t").between(min(origins) - before, max(origins) + after))


def forecast_single_layer(
    frames: DataFrame,
    block_map: DataFrame,
    spec: DataFrame,
    train: tuple[int, int],
    origins: Sequence[int],
    steps: int,
    washout: int,
    warmup: int,
    ridge: float,
    mode: str = "quadratic",
    input_mode: str = "structured",
    weights: DataFrame | None = None,
    coarse_frames: DataFrame | None = None,
    segment: int | None = None,
    overlap: int = 0,
    map_rows: int | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
    coarse_ahead: DataFrame | None = None,
    score_until: int | None = None,
) -> Result:
    """Build the nets, fit every block, and roll forward from every origin.

    ``frames`` is ``(run, layer, t, values)``: attach the runs to the series first. ``spec``
    has one row per (run, layer). Input counts come from the block map. The one-step outputs
    reach to the end of training, or to ``score_until``. ``coarse_ahead``: see ``rollout_blocks``.
    """
    sizes = layer_sizes(block_map)
    sized = with_dimensions(spec, {l: (s.d_rec, s.d_neigh, s.d_layer) for l, s in sizes.items()})
    weights = reservoir_weights(sized, input_mode) if weights is None else weights
    nets = settle(pack_reservoir(sized, weights))
    if map_rows is None:
        map_rows = sum(s.n_blocks * (s.d_rec + s.d_neigh + s.d_layer) for s in sizes.values())
    inputs = gather_inputs(frames, block_map, coarse_frames, ["run"], map_rows)
    readouts = settle(
        fit_block_readouts(
            inputs, nets, block_map, *train, washout, [ridge], mode, segment, overlap
        )
    )
    until = train[1] if score_until is None else score_until
    scored = score_one_step(inputs, nets, readouts, block_map, train[0], until, mode, segment, overlap)
    fitted = merge_block_outputs(scored, block_map, map_rows=map_rows)
    runs = spec.select("run").distinct()
    forecast = rollout_blocks(
        around(frames, origins, warmup, steps), nets, readouts, block_map, origin_table(runs, origins),
        warmup, steps, mode, None if coarse_frames is None else around(coarse_frames, origins, warmup, steps),
        max_bytes=max_bytes, coarse_ahead=coarse_ahead,
    )
    return Result(readouts, fitted, forecast, nets)


def forecast_layers(
    frames_by_layer: Sequence[DataFrame],
    maps: Sequence[DataFrame],
    spec: DataFrame,
    train: tuple[int, int],
    steps: int,
    washout: int,
    warmup: int,
    ridges: Sequence[float],
    modes: Sequence[str],
    input_mode: str = "structured",
    weights: Sequence[DataFrame] | None = None,
    origins: Sequence[int] | None = None,
    segment: int | None = None,
    overlap: int = 0,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> list[Result]:
    """Coarse to fine: each layer reads the fit and forecast of the one above it.

    By default the one origin is the end of the training span; ``origins`` may name any steps
    from there on. Before an origin a finer layer reads the one-step outputs of the layer above
    (readouts of the training span under true inputs), from the origin on that origin's own
    coarse forecast; so no layer sees a value that is later than its origin. Each layer's two
    outputs are settled once, as frames, because the next layer reads them several times.
    """
    origins = [train[1]] if origins is None else list(origins)
    if min(origins) < train[1]:
        raise ValueError("an origin lies inside the training span")
    results: list[Result] = []
    coarse = ahead = None
    for l, (frames, block_map) in enumerate(zip(frames_by_layer, maps, strict=True)):
        result = forecast_single_layer(
            frames, block_map, layer_params(spec, l), train, origins, steps, washout, warmup,
            ridges[l], modes[l], input_mode, None if weights is None else weights[l], coarse,
            segment, overlap, max_bytes=max_bytes, coarse_ahead=ahead, score_until=max(origins),
        )
        results.append(result)
        if l + 1 < len(maps):
            values = F.col("yhat").alias("value")
            coarse = settle(to_frames(result.fitted.select("run", "t", "cell", values), ["run"]))
            free = result.forecast.filter(F.col("t") >= F.col("origin"))
            ahead = settle(to_frames(free.select("run", "origin", "t", "cell", values), ["run", "origin"]))
    return results


def whole_block(frames: DataFrame, n_cells: int, layer: int = 0) -> DataFrame:
    """Block map of a model without blocks: all cells in one block."""
    return frames.sparkSession.range(n_cells).select(
        F.lit(layer).alias("layer"), F.lit(0).alias("block"), F.lit("rec").alias("role"),
        F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("cell"),
    )


def frames_with_target(frames: DataFrame, keys: Sequence[str] = ("run", "layer")) -> DataFrame:
    """Frames as deep-net inputs with the next frame as target ``y``.

    The target comes from an equi-join on t + 1, so no single task sorts a whole series;
    the last frame has none (null).
    """
    ahead = frames.select(*keys, (F.col("t") - 1).alias("t"), F.col("values").alias("y"))
    return frames.join(ahead, [*keys, "t"], "left").select(
        *keys, F.lit(0).alias("block"), "t", F.col("values").alias("u_rec"),
        F.array().cast("array<double>").alias("u_neigh"),
        F.array().cast("array<double>").alias("u_layer"), "y",
    )


def forecast_deep(
    frames: DataFrame,
    n_cells: int,
    spec: DataFrame,
    train: tuple[int, int],
    origins: Sequence[int],
    steps: int,
    washout: int,
    warmup: int,
    ridge: float,
    weights: DataFrame | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> Result:
    """Deep net on whole frames: build, fit, warm up, free-run."""
    weights = deep_weights(spec) if weights is None else weights
    nets = settle(pack_deep(spec, weights))
    block_map = whole_block(frames, n_cells)
    inputs = frames_with_target(frames)
    readouts = settle(fit_deep_readout(inputs.filter("y IS NOT NULL"), nets, block_map, *train, washout, [ridge]))
    scored = score_one_step(inputs, nets, readouts, block_map, *train, after=True)
    fitted = merge_block_outputs(scored, block_map)
    runs = spec.select("run").distinct()
    forecast = rollout_deep(
        around(frames, origins, warmup, steps), nets, readouts, block_map, origin_table(runs, origins),
        warmup, steps, max_bytes=max_bytes,
    )
    return Result(readouts, fitted, forecast, nets)


def forecast_delay(
    frames: DataFrame,
    n_cells: int,
    train_len: int,
    steps: int,
    washout: int = 0,
    past: int = 2,
    delay: int = 1,
    degree: int = 2,
    ridge: float = 1e-6,
    noise_std: float = 0.0,
    n_features: int = 0,
    seed: int = 0,
    origins: Sequence[int] | None = None,
    pca_ratio: float | None = None,
    fit_until: int | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
    max_features: int = MAX_FEATURES,
) -> Result:
    """Polynomial delay features of ``(run, layer, t, values)``: (reduce,) fit, free-run, (restore).

    Training uses the ``train_len`` steps from washout + (past-1)*delay on. By default the
    origin is the step after the last training target.
    """
    model, width, components = frames, n_cells, None
    if pca_ratio is not None:
        components = settle(pca_fit(frames, ["run"], pca_ratio, fit_until))
        width = components.groupBy("run").count().agg(F.max("count")).first()[0]
        model = pca_reduce(frames, components, ["run"], n_cells)
    linear = frames.sparkSession.range(width * past).select(F.col("id").cast("int").alias("i"))
    dictionary = select_features(feature_dictionary(linear, degree, max_features), n_features, seed)
    start = washout + (past - 1) * delay
    stop = start + train_len
    delayed = delay_frames(model, past, delay, washout, ["run", "layer"]).filter(F.col("t") < stop)
    readouts = settle(
        fit_readout(delay_gram(delayed, dictionary, ["run"], noise_std, seed), [ridge], ["run"])
    )
    features = jitter_features(poly_features(delayed, dictionary), noise_std, seed)
    fitted = fitted_values(
        features, readouts, ["run"], "phi", "linear"
    ).select("run", "layer", (F.col("t") + 1).alias("t"), F.posexplode("yhat").alias("cell", "yhat"))
    runs = frames.select("run").distinct()
    origins = list(origins or [stop + 1])
    forecast = rollout_delay(
        around(model, origins, 1 + (past - 1) * delay, steps), readouts, dictionary,
        origin_table(runs, origins), past, delay, steps, max_bytes,
    )
    if components is not None:
        reduced = to_frames(
            forecast.withColumnRenamed("yhat", "value"), ["run", "layer", "origin"]
        )
        restored = pca_restore(reduced, components, ["run"], n_cells)
        forecast = restored.select(
            "run", "layer", "origin", "t", F.posexplode("values").alias("cell", "yhat")
        )
    return Result(readouts, fitted, forecast)


def rolling_windows(lengths: DataFrame, shares: Sequence[float], steps: int, width: int | None = None) -> DataFrame:
    """Training windows ``(series, origin, first, last)`` of rolling origins, from ``(series, n)``.

    An origin lies at each share of a series' steps that have ``steps`` more behind them. Training
    ends before the origin; it starts with the series (expanding) or ``width`` steps before its end.
    """
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("_share")
    origin = F.floor(F.col("_share") * (F.col("n") - steps)).cast("long")
    first = F.lit(0).cast("long") if width is None else F.greatest(F.lit(0), F.col("origin") - width).cast("long")
    return lengths.select("series", "n", at).select("series", origin.alias("origin")).distinct().select(
        "series", "origin", first.alias("first"), F.col("origin").alias("last"))


def backtest_refit(
    frames: DataFrame,
    block_map: DataFrame,
    spec: DataFrame,
    windows: DataFrame,
    steps: int,
    washout: int,
    warmup: int,
    ridge: float,
    mode: str = "quadratic",
    input_mode: str = "structured",
    weights: DataFrame | None = None,
    segment: int | None = None,
    overlap: int = 0,
    map_rows: int | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> Result:
    """Rolling-origin backtest: every origin forecasts with a readout fitted on steps before it.

    ``frames`` is ``(series, layer, t, values)``, ``spec`` has a row per (run, layer) with the run's
    ``series``, ``windows`` is ``(series, origin, first, last)``, see :func:`rolling_windows`; a
    window may not reach beyond its origin. One state pass over a series serves all its runs and
    all its windows: Gram sums are kept by the time between two window edges and added up along
    them. Only the very first ``washout`` steps of a series are never trained on.
    """
    late = windows.filter("last > origin").limit(1).count()
    if late:
        raise ValueError("a training window reaches beyond its origin")
    sizes = layer_sizes(block_map)
    sized = with_dimensions(spec, {l: (s.d_rec, s.d_neigh, s.d_layer) for l, s in sizes.items()})
    weights = reservoir_weights(sized, input_mode) if weights is None else weights
    of_run = spec.select("run", "series").distinct()
    nets = settle(pack_reservoir(sized, weights).join(of_run, "run"))
    if map_rows is None:
        map_rows = sum(s.n_blocks * (s.d_rec + s.d_neigh + s.d_layer) for s in sizes.values())
    inputs = gather_inputs(frames, block_map, None, ["series"], map_rows)
    span = windows.agg(F.max("last")).first()[0]
    partial = stack_gram(
        inputs, nets, block_map, 0, int(span), washout, mode, segment, overlap, edges=window_edges(windows))
    keys = ["run", "layer", "block", "bucket"]
    total = partial.drop("part") if segment is None else sum_gram(partial, keys)
    readouts = settle(window_readouts(total, windows, nets, [ridge]))
    # the frames around the origins go to the runs, never the whole history
    need = windows.select("series", F.explode(F.sequence(F.col("origin") - warmup, F.col("origin") + steps)).alias("t"))
    near = frames.join(need.distinct(), ["series", "t"])
    forecast = rollout_blocks(
        attach_runs(near, of_run).drop("series"), nets.drop("series"), readouts, block_map,
        of_run.join(windows, "series").select("run", "origin"), warmup, steps, mode, max_bytes=max_bytes,
    )
    return Result(readouts, None, forecast, nets)


def _swept(
    inputs: DataFrame, frames: DataFrame, panel: DataFrame, block_map: DataFrame, nets: DataFrame, runs: DataFrame,
    ridges: Sequence[float], train: tuple[int, int], steps: int, washout: int, warmup: int, mode: str, points: int,
    max_bytes: int, coarse: DataFrame | None = None, after: bool = False, fit_stop: int | None = None,
) -> DataFrame:
    """Errors of every (net, ridge), from one stacked state pass over each series' inputs.

    ``nets`` has the ``series`` each net reads; ``runs`` its grid point and repetition. The inputs are
    placed once for all nets of a series, however many there are.
    """
    last = train[1] if fit_stop is None else fit_stop
    partial = stack_gram(inputs, nets, block_map, train[0], last, washout, mode, after=after)
    readouts = fit_readout(partial.drop("bucket", "part"), ridges)
    # a run is a (net, ridge) pair
    listed = F.array(*[F.lit(float(r)) for r in ridges])
    number = F.array_position(listed, F.col("ridge")) - 1
    n_ridges = len(ridges)
    models = settle(readouts.withColumn("run", F.col("run") * n_ridges + number))
    run_nets = nets.drop("series").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_ridges - 1)))).withColumn(
        "run", F.col("run") * n_ridges + F.col("_k")
    ).drop("_k")
    pairs = runs.join(nets.select("run", "series"), "run").select(
        "config_id", "rep", "series", F.col("run").alias("_net"), F.posexplode(listed).alias("_k", "ridge")
    ).select("config_id", "rep", "series", "ridge", (F.col("_net") * n_ridges + F.col("_k")).alias("run"))
    near = attach_runs(around(frames, [train[1]], warmup, steps), pairs).drop("series")
    if coarse is not None:
        coarse = attach_runs(around(coarse, [train[1]], warmup, steps), pairs).drop("series")
    forecast = rollout_blocks(
        near, run_nets, models, block_map, origin_table(pairs, [train[1]]), warmup, steps, mode, coarse, after,
        max_bytes=max_bytes,
    )
    ahead = (train[1], train[1] + steps - 1)
    aligned = align_forecast(forecast.filter(F.col("t").between(*ahead)), panel, between=ahead)
    curve = sample_curve(error_curve(aligned, ["run"]), points, keys=["run"])
    errors = curve.join(pairs, "run").select(
        "config_id", "ridge", "rep",
        F.concat(F.lit("rmse"), F.col("point").cast("string")).alias("err"), F.col("rmse").alias("error"),
    )
    return sweep_stats(errors, ["config_id", "ridge"])


def _with_base(grid: DataFrame, base: dict, names: Sequence[str]) -> DataFrame:
    """Grid rows with the base values of the parameters that the grid does not vary."""
    for name in names:
        if name not in grid.columns:
            grid = grid.withColumn(name, F.lit(base[name]))
    return grid


RESERVOIR = ("n", "g", "degree", "g_in_rec", "g_in_neigh", "g_in_layer", "tau", "dt")


def sweep_single_layer(
    frames: DataFrame,
    panel: DataFrame,
    block_map: DataFrame,
    grid: DataFrame,
    ridges: Sequence[float],
    base: dict,
    repetitions: int,
    train: tuple[int, int],
    steps: int,
    washout: int,
    warmup: int,
    mode: str = "quadratic",
    points: int = 4,
    weights: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> DataFrame:
    """Sweep of the single-layer pipeline with one state pass for all nets and ridge values.

    ``frames`` is ``(series, layer, t, values)`` of one series; ``grid`` holds every
    parameter except the ridge. Each (grid point, repetition) is a net; each ridge value of
    it a run. Nets do not depend on the ridge, so the passes and Gram sums are shared, and the
    inputs of a block are shuffled once for all nets.
    ``weights`` makes the weights of the sized spec (one row per net); random nets if not given.
    """
    runs = sweep_runs(grid, repetitions)
    spec = _with_base(runs.withColumn("layer", F.lit(0)), base, RESERVOIR)
    sized = with_dimensions(spec, check_dimensions(block_map))
    nets = settle(pack_reservoir(sized, (weights or reservoir_weights)(sized)).withColumn("series", F.lit(base["series"])))
    inputs = gather_inputs(frames, block_map, keys=["series"])
    stats = _swept(inputs, frames, panel, block_map, nets, runs, ridges, train, steps, washout, warmup, mode, points, max_bytes)
    return grid.join(stats, "config_id")


def sweep_layers(
    frames: Sequence[DataFrame],
    panel: DataFrame,
    maps: Sequence[DataFrame],
    coarse_base: dict,
    grid: DataFrame,
    ridges: Sequence[float],
    base: dict,
    repetitions: int,
    train: tuple[int, int],
    steps: int,
    washout: int,
    warmup: int,
    modes: Sequence[str] = ("quadratic", "quadratic"),
    points: int = 4,
    weights: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> DataFrame:
    """Sweep of the finer of two layers; the coarser one runs once a repetition.

    ``frames`` and ``maps`` are those of the coarse and of the fine layer, frames ``(t, values)`` with
    any other columns. The coarse layer's parameters (``coarse_base``, with its ``ridge``) do not vary,
    so its nets, fit and forecast belong to the repetition alone: their number of jobs and their
    rows do not depend on the grid. Every grid point of a repetition reads the same coarse
    values, so their nets share one stacked pass. Scores are those of the fine layer.
    """
    spark = grid.sparkSession
    reps = spark.range(repetitions).withColumnRenamed("id", "run")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repetitions - 1).cast("long")))
    make = weights or reservoir_weights
    upper_spec = _with_base(reps.withColumn("layer", F.lit(0)).withColumn("seed", F.col("run")), coarse_base, RESERVOIR)
    upper_sized = with_dimensions(upper_spec, check_dimensions(maps[0]))
    upper_frames = frames[0].select(each.alias("run"), F.lit(0).alias("layer"), "t", "values")
    upper = forecast_single_layer(
        upper_frames, maps[0], upper_spec, train, [train[1]], steps, washout, warmup, coarse_base["ridge"], modes[0],
        weights=make(upper_sized), max_bytes=max_bytes,
    )
    known = settle(layer_input(upper.fitted, upper.forecast, train[1]))
    coarse = settle(to_frames(known, ["run"]).withColumnRenamed("run", "series"))
    fine = frames[1].select(each.alias("series"), F.lit(1).alias("layer"), "t", "values")
    runs = sweep_runs(grid, repetitions)
    spec = _with_base(runs.withColumn("layer", F.lit(1)), base, RESERVOIR)
    sized = with_dimensions(spec, check_dimensions(maps[1]))
    of_rep = runs.select("run", F.col("rep").cast("long").alias("series"))
    nets = settle(pack_reservoir(sized, make(sized)).join(of_rep, "run"))
    inputs = gather_inputs(fine, maps[1], coarse, ["series"])
    stats = _swept(
        inputs, fine, panel, maps[1], nets, runs, ridges, train, steps, washout, warmup, modes[1], points, max_bytes, coarse)
    return grid.join(stats, "config_id")


DEEP = ("nr", "rho", "leak", "input_scale", "inter_scale", "sparsity", "nu")


def sweep_deep(
    frames: DataFrame,
    panel: DataFrame,
    n_cells: int,
    grid: DataFrame,
    ridges: Sequence[float],
    base: Sequence[dict],
    repetitions: int,
    train: tuple[int, int],
    steps: int,
    washout: int,
    warmup: int,
    points: int = 4,
    weights: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int = MAX_SYSTEM_BYTES,
) -> DataFrame:
    """Sweep of the deep model: all nets of the grid advance together over the frames.

    ``frames`` is ``(t, values)`` of one series. ``base`` has the parameters of each level; a column
    of the grid replaces one at all levels. Training uses steps whose target lies before the origin.
    """
    runs = sweep_runs(grid, repetitions)
    levels = None
    for level, parameters in enumerate(base):
        one = _with_base(runs.withColumn("level", F.lit(level)), parameters, DEEP)
        levels = one if levels is None else levels.unionByName(one)
    nets = settle(pack_deep(levels, (weights or deep_weights)(levels)).withColumn("series", F.lit("all")))
    block_map = whole_block(frames, n_cells)
    one = frames.select(F.lit("all").alias("series"), F.lit(0).alias("layer"), "t", "values")
    inputs = frames_with_target(one, ("series", "layer")).filter("y IS NOT NULL")
    stats = _swept(
        inputs, one, panel, block_map, nets, runs, ridges, train, steps, washout, warmup, "quadratic", points, max_bytes,
        after=True, fit_stop=train[1] - 1,
    )
    return grid.join(stats, "config_id")


def sweep_delay(
    frames: DataFrame,
    panel: DataFrame,
    n_cells: int,
    structures: Sequence[tuple[int, int, int]],
    ridges: Sequence[float],
    train_len: int,
    origins: Sequence[int],
    steps: int,
    washout: int = 0,
    points: int = 4,
    max_bytes: int = MAX_SYSTEM_BYTES,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """Sweep of the delay model: (past, delay, degree) x ridge, scored from several origins.

    ``frames`` is ``(layer, t, values)`` of one series, trained on ``train_len`` steps. The
    features of a structure and its Gram sums serve every ridge value; a (ridge, origin) pair
    is one group of the free run. Mean and deviation are over the origins.
    Returns config_id (the place in ``structures``), past, delay, degree, ridge, err, mean, std, n_rep.
    """
    runs = frames.sparkSession.range(len(ridges)).select(F.col("id").alias("run"))
    listed = F.array(*[F.lit(float(r)) for r in ridges])
    parts = []
    for config, (past, delay, degree) in enumerate(structures):
        linear = frames.sparkSession.range(n_cells * past).select(F.col("id").cast("int").alias("i"))
        dictionary = feature_dictionary(linear, degree, max_features)
        one = frames.select(F.lit(0).cast("long").alias("run"), "layer", "t", "values")
        stop = washout + (past - 1) * delay + train_len
        delayed = delay_frames(one, past, delay, washout, ["run", "layer"]).filter(F.col("t") < stop)
        readouts = fit_readout(delay_gram(delayed, dictionary, ["run"]), ridges, ["run"]).withColumn(
            "run", (F.array_position(listed, F.col("ridge")) - 1).cast("long"))
        near = around(frames, origins, 1 + (past - 1) * delay, steps)
        each = F.array(*[F.lit(k).cast("long") for k in range(len(ridges))])
        near = near.select(F.explode(each).alias("run"), "layer", "t", "values")
        forecast = rollout_delay(
            near, settle(readouts), dictionary, origin_table(runs, origins), past, delay, steps, max_bytes
        )
        aligned = align_forecast(forecast, panel, between=(min(origins), max(origins) + steps - 1))
        curve = sample_curve(error_curve(aligned, ["run", "origin"]), points, keys=["run", "origin"])
        parts.append(curve.select(
            F.lit(config).alias("config_id"), F.lit(past).alias("past"), F.lit(delay).alias("delay"),
            F.lit(degree).alias("degree"), F.get(listed, F.col("run").cast("int")).alias("ridge"),
            F.concat(F.lit("rmse"), F.col("point").cast("string")).alias("err"), F.col("rmse").alias("error"),
        ))
    errors = parts[0]
    for part in parts[1:]:
        errors = errors.unionByName(part)
    return sweep_stats(errors, ["config_id", "past", "delay", "degree", "ridge"])
