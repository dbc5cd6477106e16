import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators import evaluate as ev
from stforecast.operators import sweep as sw
from stforecast.plans import pipelines as pl
from stforecast.sources import to_frames, write_sweep_csv


product = lambda pdf: [float(pdf.a.iloc[0] * pdf.b.iloc[0])]  # noqa: E731  (travels by value)


def test_grid_order_and_constant_errors(spark, tmp_path):
    grid = sw.config_grid(spark, {"a": [1, 2], "b": [10, 20]})
    assert [(r.a, r.b) for r in grid.orderBy("config_id").collect()] == [(1, 10), (2, 10), (1, 20), (2, 20)]
    table = sw.run_sweep(grid, product, repetitions=2)
    rows = table.orderBy("config_id").collect()
    assert [(r.mean_err1, r.std_err1) for r in rows] == [(10, 0), (20, 0), (20, 0), (40, 0)]
    write_sweep_csv(table, str(tmp_path / "g"))
    lines = spark.read.text(str(tmp_path / "g")).filter("value like 'config_id,a,b,mean_err1%'")
    assert lines.count() >= 1
    assert [r.config_id for r in sw.best_configs(table, "mean_err1", 2).collect()] == [0, 1]


def test_one_repetition_has_no_deviation(spark):
    grid = sw.config_grid(spark, {"a": [1], "b": [3]})
    assert sw.run_sweep(grid, product, 1, ["e"]).first().std_e == 0


def test_unequal_lengths_and_names_are_errors(spark):
    grid = sw.config_grid(spark, {"a": [1, 2], "b": [1]})
    with pytest.raises(ValueError):
        sw.run_sweep(grid, lambda pdf: [1.0] * int(pdf.a.iloc[0]), 1)
    with pytest.raises(ValueError, match="2 error names for 1"):
        sw.run_sweep(grid, lambda pdf: [1.0], 1, ["x", "y"])
    with pytest.raises(ValueError):
        sw.config_grid(spark, {"a": []})


def test_override_keeps_base_for_null(spark):
    grid = spark.createDataFrame([(0, 0.5), (1, None)], "config_id long, g2 double")
    out = sw.override_config(grid, [{"g": 0.1, "n": 5}, {"g": 0.2, "n": 6}], {"g": "g2"}, 1)
    got = {(r.config_id, r.layer): (r.g, r.n) for r in out.collect()}
    assert got == {(0, 0): (0.1, 5), (0, 1): (0.5, 6), (1, 0): (0.1, 5), (1, 1): (0.2, 6)}


def aligned(spark, panel_of, error):
    panel = panel_of(np.zeros_like(error))
    rows = [
        (0, 0, 0, t, c, float(error[c, t])) for c in range(error.shape[0]) for t in range(error.shape[1])
    ]
    forecast = spark.createDataFrame(rows, "run long, layer int, origin long, t long, cell int, yhat double")
    return ev.align_forecast(forecast, panel)


def test_rmse_and_curve(spark, panel_of):
    error = np.zeros((4, 10))
    error[0, 0] = 1.0
    table = aligned(spark, panel_of, error)
    assert ev.rmse_upto(table, 0, 1, [0]).first().rmse == 1.0
    assert np.isclose(ev.rmse_upto(table, 0).first().rmse, np.sqrt(1 / 40))
    assert np.isclose(ev.rmse_upto(table, 0, 99).first().rmse, np.sqrt(1 / 40))
    curve = [r.rmse for r in ev.error_curve(table).orderBy("t").collect()]
    assert np.allclose(curve, [np.sqrt(1 / (4 * k)) for k in range(1, 11)])
    with pytest.raises(ValueError):
        ev.rmse_upto(table, 0, cells=[])


def test_curve_points(spark, panel_of):
    curve = ev.error_curve(aligned(spark, panel_of, np.ones((1, 10))))
    stride = [r.t_len for r in ev.sample_curve(curve, 4).orderBy("t_len").collect()]
    assert stride == [1, 3, 5, 7]  # round(2.5) is 2
    even = [r.t_len for r in ev.sample_curve(curve, 4, "even").orderBy("point").collect()]
    assert even == [1, 4, 7, 10]


def test_error_table_window(spark, panel_of):
    table = aligned(spark, panel_of, np.ones((2, 100)))
    out = ev.forecast_error_table(table, 0.25, 0.1, 2, 22.0, origin=50, n_lyap_before=1, n_lyap_after=1)
    assert out.agg(F.min("t"), F.max("t")).first() == (10, 89)
    first = out.filter("t = 50 and cell = 1").first()
    assert first.lyapunov_time == 0 and first.position == 22.0


def test_shared_gram_sweep_equals_single_runs(spark, panel_of):
    data = 0.5 * np.random.default_rng(8).normal(size=(8, 120))
    panel = panel_of(data)
    frames, m = to_frames(panel), bl.blocks_1d(spark, 8, 4, 1)
    base = {"n": 12, "degree": 4, "g_in_neigh": 0.3, "g_in_layer": 0.0, "tau": 0.25, "dt": 0.25, "series": "s"}
    grid = sw.config_grid(spark, {"g": [0.4], "g_in_rec": [0.5]})
    args = (base, 2, (0, 100), 12, 10, 10)
    both = pl.sweep_single_layer(frames, panel, m, grid, [1e-2, 1.0], *args)
    alone = [pl.sweep_single_layer(frames, panel, m, grid, [r], *args) for r in (1e-2, 1.0)]
    key = ["ridge", "err"]
    got = both.toPandas().sort_values(key)
    want = alone[0].unionByName(alone[1]).toPandas().sort_values(key)
    assert len(got) == 8 and (got.n_rep == 2).all()
    assert np.allclose(got["mean"], want["mean"]) and np.allclose(got["std"], want["std"])


def test_layers_and_series_are_kept_apart(spark):
    rows = [(s, l, t, 0, 10.0 * l + t) for s in ("a", "b") for l in (0, 1) for t in (0, 1)]
    actual = spark.createDataFrame(rows, "series string, layer int, t long, cell int, value double")
    forecast = actual.withColumnRenamed("value", "yhat")
    out = ev.align_forecast(forecast, actual).collect()
    assert len(out) == len(rows) and all(r.error == 0 for r in out)
    with pytest.raises(Exception, match="more than one actual value"):
        ev.align_forecast(forecast.drop("series"), actual).collect()
