import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast import sources as src


def test_wide_csv_is_transposed_in_line_order(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(20, 3))
    text = "a,b,c\n" + "\n".join(",".join(repr(float(v)) for v in row) for row in values) + "\n"
    (tmp_path / "x.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several splits
    try:
        panel = src.read_wide_csv(spark, str(tmp_path), 3, column_names=["a", "b", "c"])
        pdf = panel.toPandas().pivot(index="cell", columns="t", values="value")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert pdf.shape == (3, 20)
    assert np.array_equal(pdf.to_numpy(), values.T)


def test_nan_becomes_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t,c0\n5,NaN\n3,1.5\n")
    rows = src.read_wide_csv(spark, str(tmp_path), 1, time_col="t").orderBy("t").collect()
    assert [(r.t, r.value) for r in rows] == [(0, 1.5), (1, None)]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        src.read_panel(spark, str(tmp_path / "none")).count()


def test_panel_round_trip_prunes_layers(spark, panel_of, tmp_path):
    both = panel_of(np.ones((2, 3))).unionByName(panel_of(np.zeros((1, 3)), layer=1))
    path = str(tmp_path / "p")
    src.write_panel(both, path)
    one = src.read_panel(spark, path, [1])
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan


def test_dense_index_skips_missing_days(spark):
    days = spark.sql(
        "SELECT 's' AS series, 0 AS layer, d AS day, 0 AS cell, 1.0D AS value "
        "FROM VALUES (DATE'2020-01-01'), (DATE'2020-01-03'), (DATE'2021-02-01') AS v(d)"
    )
    out = src.stack_daily(days, "day", F.col("cell"), F.col("value")).orderBy("ts").collect()
    assert [r.t for r in out] == [0, 1, 2]


def test_chunked_rank_equals_rank(spark):
    from stforecast.sources.panel import chunked_rank

    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 37 % 1009).alias("v"))
    got = chunked_rank(df, ["k"], "v", F.floor(F.col("v") / 50)).orderBy("v").collect()
    assert [r["rank"] for r in got] == list(range(1000))


def test_time_slice_overlaps(panel_of):
    out = src.time_slice(panel_of(np.ones((1, 10))), {"train": (0, 6), "warmup": (4, 6), "test": (6, 9)})
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 6, "warmup": 2, "test": 3}


def test_cells_and_grid(spark):
    grid = src.unflatten_cells(spark.range(12).select(F.col("id").cast("int").alias("cell")), 4)
    back = src.flatten_cells(grid.withColumnRenamed("cell", "old"), 4)
    assert back.filter("old <> cell").count() == 0
    assert grid.filter("cell = 7").first().lon_idx == 1
