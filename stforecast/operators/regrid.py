"""Coarse-graining of panels and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.functions.columns import once
from stforecast.sources.panel import KEYS


def cell_count(panel: DataFrame) -> int:
    """Number of cells of a panel whose cells are numbered from 0 (one small aggregate)."""
    top = panel.agg(F.max("cell")).first()[0]
    if top is None:
        raise ValueError("the panel is empty")
    return int(top) + 1


def _require_divides(n_cells: int, divisor: int) -> None:
    if divisor < 1 or n_cells % divisor:
        raise ValueError(f"{divisor} does not divide {n_cells} cells")


def regrid_1d(
    panel: DataFrame,
    divisor: int,
    n_cells: int | None = None,
    layer: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean over ``divisor`` neighbouring cells; missing if any of them is missing.

    ``layer`` relabels the result as another resolution.
    """
    _require_divides(cell_count(panel) if n_cells is None else n_cells, divisor)
    out = (
        panel.groupBy(*keys, "t", F.floor(F.col("cell") / divisor).cast("int").alias("cell"))
        .agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
        .select(*keys, "t", "cell", F.when(F.col("_n") == divisor, F.col("_s") / divisor).alias("value"))
    )
    return out if layer is None else out.withColumn("layer", F.lit(layer))


def regrid_1d_frames(
    frames: DataFrame, divisor: int, n_cells: int, layer: int | None = None
) -> DataFrame:
    """As :func:`regrid_1d` on frames: a projection, no shuffle."""
    _require_divides(n_cells, divisor)
    mean = once(F.col("values"), lambda values: F.transform(
        F.sequence(F.lit(0), F.lit(n_cells // divisor - 1)),
        lambda i: F.aggregate(
            F.slice(values, i * divisor + 1, F.lit(divisor)), F.lit(0.0), lambda s, v: s + v
        ) / divisor,
    ))
    out = frames.withColumn("values", mean)
    return out if layer is None else out.withColumn("layer", F.lit(layer))


def regrid_2d(
    panel: DataFrame,
    step_lon: int,
    step_lat: int,
    min_valid: int = 1,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean of the valid values in step_lon x step_lat boxes, missing below ``min_valid``."""
    box = [
        F.floor(F.col("lon_idx") / step_lon).cast("int").alias("lon_idx"),
        F.floor(F.col("lat_idx") / step_lat).cast("int").alias("lat_idx"),
    ]
    return (
        panel.groupBy(*keys, "t", *box)
        .agg(F.avg("value").alias("_m"), F.count("value").alias("n_valid"))
        .select(
            *keys, "t", "lon_idx", "lat_idx",
            F.when(F.col("n_valid") >= min_valid, F.col("_m")).alias("value"), "n_valid",
        )
    )
