"""Scores of forecasts and the tables behind the usual pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORECAST_KEYS = ["run", "layer", "origin"]


def align_forecast(
    forecast: DataFrame, actual: DataFrame, on: Sequence[str] | None = None,
    between: tuple[int, int] | None = None,
) -> DataFrame:
    """Forecast rows with the actual value of the same absolute step: adds ``value, error``.

    Rows meet on those of series, layer, t and cell that both tables have, or on ``on``. The
    query fails if two actual values have the same key. Where the caller knows the first and last
    step of the forecast (``between``), only their actual values are read and grouped.
    """
    if on is None:
        on = [c for c in ("series", "layer", "t", "cell") if c in forecast.columns and c in actual.columns]
    twice = F.raise_error(F.lit(f"more than one actual value for the same {', '.join(on)}"))
    if between is not None:
        actual = actual.filter(F.col("t").between(*between))
    truth = actual.groupBy(*on).agg(F.max("value").alias("value"), F.count("*").alias("_n")).select(
        *on, F.when(F.col("_n") == 1, F.col("value")).otherwise(twice).alias("value")
    )
    return forecast.join(truth, list(on)).withColumn("error", F.col("yhat") - F.col("value"))


def step_errors(aligned: DataFrame, keys: Sequence[str] = FORECAST_KEYS) -> DataFrame:
    """Squared error and number of cells per step, the only rows later scores need."""
    return aligned.groupBy(*keys, "t").agg(
        F.sum(F.col("error") * F.col("error")).alias("sse"), F.count("error").alias("n")
    )


def error_curve(aligned: DataFrame, keys: Sequence[str] = FORECAST_KEYS) -> DataFrame:
    """RMSE over the first 1, 2, ... steps, in one pass: ``(keys, t, t_len, rmse)``.

    Cells are summed before the shuffle; the running sum is over one row per step.
    """
    w = W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    steps = step_errors(aligned, keys)
    return steps.select(
        *keys, "t",
        F.count("*").over(w).alias("t_len"),
        F.sqrt(F.sum("sse").over(w) / F.sum("n").over(w)).alias("rmse"),
    )


def rmse_upto(
    aligned: DataFrame,
    first_t: int,
    n_steps: int | None = None,
    cells: Sequence[int] | None = None,
    keys: Sequence[str] = FORECAST_KEYS,
) -> DataFrame:
    """RMSE over the first ``n_steps`` steps from ``first_t`` and the chosen cells."""
    part = aligned.filter(F.col("t") >= first_t)
    if n_steps is not None:
        if n_steps < 1:
            raise ValueError("n_steps must be at least 1")
        part = part.filter(F.col("t") < first_t + n_steps)
    if cells is not None:
        if not len(cells):
            raise ValueError("no cells chosen")
        part = part.filter(F.col("cell").isin([int(c) for c in cells]))
    return part.groupBy(*keys).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))


def sample_curve(
    curve: DataFrame, points: int = 4, mode: str = "stride", keys: Sequence[str] = FORECAST_KEYS
) -> DataFrame:
    """Pick points of an error curve: adds ``point`` (from 1).

    ``stride``: steps 1, 1+s, ... with s = max(1, round(n / points)), so the last step is
    never among them. ``even``: evenly spaced steps, first and last included.
    """
    n = F.max("t_len").over(W.partitionBy(*keys))
    sized = curve.withColumn("_n", n)
    if mode == "stride":
        stride = F.greatest(F.lit(1), F.bround(F.col("_n") / points).cast("long"))
        picked = sized.withColumn("_s", stride).filter(
            (F.pmod(F.col("t_len") - 1, F.col("_s")) == 0)
            & ((F.col("t_len") - 1) / F.col("_s") < points)
        )
        return picked.withColumn(
            "point", (F.floor((F.col("t_len") - 1) / F.col("_s")) + 1).cast("int")
        ).drop("_n", "_s")
    if mode != "even":
        raise ValueError(f"mode must be stride or even, got {mode!r}")
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(
            (i + 1).alias("point"),
            F.bround(1.0 + i * (F.col("_n") - 1) / float(points - 1)).cast("long").alias("at"),
        ),
    )
    return (
        sized.withColumn("_g", F.explode(F.filter(grid, lambda g: g["at"] == F.col("t_len"))))
        .withColumn("point", F.col("_g.point")).drop("_n", "_g")
    )


def thin_units(states: DataFrame, n_units: int, block: int = 0) -> DataFrame:
    """Every (N div n_units)-th unit of one block's states over time."""
    if n_units < 1:
        raise ValueError("n_units must be at least 1")
    one = states.filter(F.col("block") == block).select(
        "run", "layer", "block", "t", F.size("x").alias("_n"), F.posexplode("x").alias("unit", "activity")
    )
    skip = F.greatest(F.lit(1), F.floor(F.col("_n") / n_units))
    return one.filter(F.col("unit") % skip == 0).drop("_n")


def forecast_error_table(
    aligned: DataFrame,
    tau: float,
    lambda_max: float,
    n_cells: int,
    length: float,
    origin: int | None = None,
    n_lyap_before: int = 1,
    n_lyap_after: int = 10,
) -> DataFrame:
    """Actual, forecast and error by position and Lyapunov time around the origin.

    Position of cell c is (c+1) * length / n_cells. The window spans whole multiples of
    round(1 / (tau * lambda_max)) steps.
    """
    per_lyap = round(1.0 / (tau * lambda_max))
    lead = F.col("t") - (F.col("origin") if origin is None else F.lit(origin))
    return (
        aligned.withColumn("lead", lead)
        .filter((F.col("lead") >= -n_lyap_before * per_lyap) & (F.col("lead") < n_lyap_after * per_lyap))
        .select(
            *[c for c in FORECAST_KEYS if c in aligned.columns],
            (F.col("lead") * F.lit(tau) * F.lit(lambda_max)).alias("lyapunov_time"),
            ((F.col("cell") + 1) * F.lit(length / n_cells)).alias("position"),
            "t", "cell", F.col("value").alias("actual"), F.col("yhat").alias("forecast"), "error",
        )
    )
