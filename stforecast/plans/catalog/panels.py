"""Panels of the catalogue's tables, in Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.operators.clean import standardise, standardise_frames
from stforecast.operators.regrid import regrid_1d, regrid_1d_frames
from stforecast.sources import complete_panel, panel_from_events

BUCKET_SECONDS = 7200
EVENTS_ORIGIN = 1704067200  # 2024-01-01


# Known schemas of the tables, so that opening one reads no file.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
EMB_CELLS = 64  # the width of an embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table is a frame table already."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("emb").alias("series"), F.lit(0).alias("layer"), F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def emb_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_frames(spark, sf_dir).select(
        "series", "layer", "t", F.posexplode("values").alias("cell", "value")
    )


def emb_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise(emb_panel(spark, sf_dir), n_cells=EMB_CELLS)


def emb_std_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise_frames(emb_frames(spark, sf_dir), n_series=1, n_cells=EMB_CELLS)


def emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid_1d(emb_std(spark, sf_dir), 8, n_cells=EMB_CELLS)


def emb8_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid_1d_frames(emb_std_frames(spark, sf_dir), 8, n_cells=EMB_CELLS)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(
        F.col("event_type").isin("purchase", "signup"), 8 + F.col("user_id") % 6
    ).otherwise(F.col("user_id") % 8)
    return panel_from_events(
        table(spark, sf_dir, "events"), "ts", cell, F.col("value"), BUCKET_SECONDS,
        origin_seconds=EVENTS_ORIGIN,
    )


def event_panel_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_panel(event_panel(spark, sf_dir))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = (F.col("user_id") % 12) * 6 + F.floor(F.col("user_id") / 12) % 6
    panel = panel_from_events(
        table(spark, sf_dir, "events"), "ts", cell, F.col("value"), BUCKET_SECONDS,
        origin_seconds=EVENTS_ORIGIN,
    )
    return complete_panel(panel).select(
        "*", F.floor(F.col("cell") / 6).cast("int").alias("lon_idx"),
        F.pmod("cell", F.lit(6)).cast("int").alias("lat_idx"),
    )


def ship_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.lit("ship").alias("series"), F.lit(0).alias("layer"),
            ((F.year(ship) - 1995) * 12 + F.month(ship) - 1).cast("long").alias("t"),
            (F.col("l_suppkey") % 12).cast("int").alias("lon_idx"),
            (F.col("l_partkey") % 6).cast("int").alias("lat_idx"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.lit("orders").alias("series"), F.lit(0).alias("layer"),
            F.col("o_orderdate").alias("day"), F.col("c_nationkey").alias("cell"),
        )
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    )


def frame_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of frames, from the Parquet footers."""
    return table(spark, sf_dir, "embeddings").count()


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in comparable types: integers as long, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(field.name)
        if kind in ("integer", "short", "byte"):
            col = col.cast("long")
        elif kind in ("double", "float"):
            col = F.round(col.cast("double"), digits) + 0.0
        columns.append(col.alias(field.name))
    return df.select(*columns)


def work_folder(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads back, on the shared storage."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared.rstrip('/')}/panels-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-")
