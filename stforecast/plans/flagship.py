"""The flagship query: a blocked reservoir forecast and its error curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.operators.blocks import blocks_1d
from stforecast.operators.evaluate import align_forecast, error_curve
from stforecast.plans.catalog import panels as p
from stforecast.plans.pipelines import forecast_single_layer


def error_curve_of_forecast(
    spark: SparkSession, sf_dir: str, units: int = 100, horizon: int = 20
) -> DataFrame:
    """Standardise, block, build nets, fit, free-run and score; one row per lead step."""
    n = p.frame_count(spark, sf_dir)
    train = n - horizon
    frames = p.emb_std_frames(spark, sf_dir).select(
        F.lit(0).cast("long").alias("run"), "layer", "t", "values"
    )
    spec = spark.range(1).select(
        F.col("id").alias("run"), F.lit(0).alias("layer"), F.lit(7).alias("seed"),
        F.lit(units).alias("n"), F.lit(0.6).alias("g"), F.lit(10).alias("degree"),
        F.lit(0.3).alias("g_in_rec"), F.lit(0.2).alias("g_in_neigh"), F.lit(0.0).alias("g_in_layer"),
        F.lit(0.25).alias("tau"), F.lit(0.25).alias("dt"),
    )
    result = forecast_single_layer(
        frames, blocks_1d(spark, 64, 8, 2), spec, (0, train), [train], horizon,
        washout=50, warmup=50, ridge=1.0,
    )
    ahead = result.forecast.filter(F.col("t") >= train)
    return error_curve(align_forecast(ahead, p.emb_std(spark, sf_dir)))
