"""Hyper-parameter sweeps: runs are rows, so every grid point and repetition runs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stforecast.session import settle, spread


def _expand(lists: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of value arrays to all combinations, the first parameter fastest.

    The combination number is split into digits, one per parameter: no joins.
    """
    total = F.lit(1).cast("long")
    weights = []
    for name in names:
        weights.append(total)
        total = total * F.size(name)
    numbered = lists.select("*", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("config_id"))
    return numbered.select("config_id", *[
        F.get(F.col(name), (F.floor(F.col("config_id") / weight) % F.size(name)).cast("int")).alias(name)
        for name, weight in zip(names, weights, strict=True)
    ])


def config_grid(
    spark: SparkSession, grids: Mapping[str, Sequence], order: Sequence[str] | None = None
) -> DataFrame:
    """Every combination of the listed values, first parameter fastest, as ``config_id`` rows."""
    names = list(order) if order else list(grids)
    for name in names:
        if not len(grids[name]):
            raise ValueError(f"parameter {name} has no values")
    lists = spark.range(1).select(*[
        F.array(*[F.lit(v) for v in grids[name]]).alias(name) for name in names
    ])
    return _expand(lists, names)


def config_grid_from_tables(columns: Mapping[str, DataFrame]) -> DataFrame:
    """As :func:`config_grid`, the values being the distinct ones of a table column.

    Each value list is a (short) parameter list and becomes one array of one row.
    """
    lists = None
    for name, df in columns.items():
        row = df.select(name).distinct().agg(
            F.sort_array(F.collect_list(name)).alias(name)
        ).withColumn("_one", F.lit(1))
        lists = row if lists is None else lists.join(F.broadcast(row), "_one")  # one row each
    return _expand(lists, list(columns))


def override_config(
    grid: DataFrame, base: Sequence[Mapping], columns: Mapping[str, str], layer: int
) -> DataFrame:
    """Per-layer base parameters for every grid point, some of one layer replaced.

    ``base`` has one mapping per layer; ``columns`` maps a base parameter to the grid
    column that replaces it. A NULL grid value keeps the base value.
    """
    rows = F.array(*[
        F.struct(F.lit(l).alias("layer"), *[F.lit(v).alias(k) for k, v in params.items()])
        for l, params in enumerate(base)
    ])
    per_layer = grid.withColumn("_base", F.explode(rows))
    names = list(base[0])
    return per_layer.select("config_id", F.col("_base.layer").alias("layer"), *[
        (F.when(F.col("_base.layer") == layer, F.coalesce(F.col(columns[n]), F.col(f"_base.{n}")))
         .otherwise(F.col(f"_base.{n}")) if n in columns else F.col(f"_base.{n}")).alias(n)
        for n in names
    ])


def sweep_runs(grid: DataFrame, repetitions: int) -> DataFrame:
    """One row per (grid point, repetition) with a ``run`` number and a seed."""
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    return grid.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn(
        "run", F.col("config_id") * repetitions + F.col("rep")
    ).withColumn("seed", F.col("run"))


def run_errors(
    runs: DataFrame, run_once: Callable[[pd.DataFrame], Sequence[float]]
) -> DataFrame:
    """User function on every run's row: ``(config_id, rep, errors)``.

    ``run_once`` gets a one-row frame of parameters and returns numbers. Runs are spread
    over all partitions, whatever their size in bytes.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = [[float(e) for e in run_once(pdf.iloc[k : k + 1])] for k in range(len(pdf))]
            yield pd.DataFrame({"config_id": pdf["config_id"], "rep": pdf["rep"], "errors": errors})

    return spread(runs, "run").mapInPandas(call, "config_id long, rep int, errors array<double>")


def multi_error(errors: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Error vectors to rows ``(config_id, rep, err, error)``; unnamed errors are err1, err2, ..."""
    long = errors.select("config_id", "rep", F.size("errors").alias("_len"), F.posexplode("errors").alias("_p", "error"))
    if names is None:
        label = F.concat(F.lit("err"), (F.col("_p") + 1).cast("string"))
    else:
        label = F.get(F.array(*[F.lit(n) for n in names]), F.col("_p"))
        wrong = F.col("_len") != len(names)
        label = F.when(
            wrong, F.raise_error(F.lit("the number of error names differs from the error length"))
        ).otherwise(label)
    return long.select("config_id", "rep", label.alias("err"), "error")


def sweep_stats(errors: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Mean and sample deviation of each error over the repetitions (0 for a single one)."""
    keys = list(keys)
    return errors.groupBy(*keys, "err").agg(
        F.avg("error").alias("mean"),
        F.coalesce(F.stddev_samp("error"), F.lit(0.0)).alias("std"),
        F.count("*").alias("n_rep"),
    )


def error_length(errors: DataFrame) -> int:
    """Length of the error vectors of a sweep; an error if the runs disagree."""
    sizes = errors.agg(F.min(F.size("errors")).alias("lo"), F.max(F.size("errors")).alias("hi")).first()
    if sizes.lo != sizes.hi:
        raise ValueError(f"runs returned between {sizes.lo} and {sizes.hi} errors")
    return sizes.hi


def sweep_table(stats: DataFrame, grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per grid point: parameters, then mean_<err>, std_<err> for every error."""
    wide = stats.groupBy("config_id").pivot("err", list(names)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    columns = []
    for n in names:
        columns += [F.col(f"{n}_mean").alias(f"mean_{n}"), F.col(f"{n}_std").alias(f"std_{n}")]
    parameters = [c for c in grid.columns if c != "config_id"]
    return grid.join(wide, "config_id").select("config_id", *parameters, *columns)


def run_sweep(
    grid: DataFrame,
    run_once: Callable[[pd.DataFrame], Sequence[float]],
    repetitions: int = 20,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Grid x repetitions of a user function, summarised per grid point."""
    errors = settle(run_errors(sweep_runs(grid, repetitions), run_once))
    width = error_length(errors)
    if names is None:
        names = [f"err{k + 1}" for k in range(width)]
    if len(names) != width:
        raise ValueError(f"{len(names)} error names for {width} errors")
    return sweep_table(sweep_stats(multi_error(errors, names)), grid, names)


def best_configs(table: DataFrame, error: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k grid points with the smallest error, overall or per key."""
    if not keys:
        return table.orderBy(F.col(error).asc(), F.col("config_id").asc()).limit(k)
    w = W.partitionBy(*keys).orderBy(F.col(error).asc(), F.col("config_id").asc())
    return table.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
