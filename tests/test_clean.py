import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.functions.numeric import natural_spline
from stforecast.operators import clean
from stforecast.operators.features import delay_embed, next_step_target
from stforecast.operators.regrid import regrid_1d, regrid_1d_frames, regrid_2d
from stforecast.plans.cleaning import Cleaning, cleaned_copies, finished
from stforecast.sources import complete_panel, to_frames


def dense_spline(x, y, at):
    """Natural spline by one dense solve."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    out = []
    for v in at:
        k = int(np.clip(np.searchsorted(x, v, side="right") - 1, 0, n - 2))
        s, t = (x[k + 1] - v) / h[k], (v - x[k]) / h[k]
        out.append(s * y[k] + t * y[k + 1] + ((s**3 - s) * m[k] + (t**3 - t) * m[k + 1]) * h[k] ** 2 / 6)
    return np.array(out)


def test_spline_helper_against_dense_solve():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.5, 2, 12))
    y = rng.normal(size=12)
    at = np.linspace(x[0], x[-1], 40)
    assert np.allclose(natural_spline(x, y, at), dense_spline(x, y, at))


def test_spline_helper_two_points_and_one():
    assert np.allclose(natural_spline(np.array([0.0, 1]), np.array([1.0, 3]), np.array([-1.0, 0.5, 2])), [-1, 2, 5])
    assert np.allclose(natural_spline(np.array([4.0]), np.array([7.0]), np.array([0.0, 9])), [7, 7])


def test_refine_time_keeps_knots_and_chunks_change_nothing(panel_of, matrix_of):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(3, 500))
    fine = matrix_of(clean.refine_time(panel_of(values), 2, chunk=130))
    assert fine.shape == (3, 999)
    assert np.allclose(fine[:, ::2], values, atol=1e-12)
    x = np.arange(500.0)
    assert np.allclose(fine[1], dense_spline(x, values[1], np.arange(999) / 2), atol=1e-11)


def test_refine_time_of_a_line_is_the_line(panel_of, matrix_of):
    values = np.vstack([np.arange(10.0), 5 - 2 * np.arange(10.0)])
    fine = matrix_of(clean.refine_time(panel_of(values), 3))
    assert np.allclose(fine[0], np.arange(28) / 3)


def test_refine_time_of_a_broken_cell_is_missing(panel_of):
    values = np.array([[1.0, 2, 3], [1.0, np.nan, 3]])
    out = clean.refine_time(panel_of(values), 2)
    assert out.filter("cell = 1 and value is null").count() == 5
    assert out.filter("cell = 0 and value is not null").count() == 5


@pytest.mark.parametrize("mode", ["compact", "time"])
def test_fill_gaps_against_whole_series(panel_of, matrix_of, mode):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(2, 700))
    values[0, rng.choice(699, 60, replace=False) + 1] = np.nan
    values[0, -1] = np.nan
    filled = matrix_of(clean.fill_gaps(panel_of(values), mode, chunk=140))
    known = np.flatnonzero(~np.isnan(values[0]))
    if mode == "compact":
        k = len(known)
        want = natural_spline(np.arange(k) * 1.0, values[0, known], np.arange(700) * (k - 1) / 699)
    else:
        want = natural_spline(known * 1.0, values[0, known], np.arange(700) * 1.0)
        assert np.allclose(filled[0, known], values[0, known])
    assert np.allclose(filled[0], want, atol=1e-10)
    assert np.allclose(filled[1], values[1], atol=1e-10)


def test_fill_gaps_leaves_empty_cells(panel_of):
    values = np.array([[np.nan] * 4, [1.0, np.nan, np.nan, 4.0], [np.nan, 2.0, np.nan, np.nan]])
    for mode in ("compact", "time", "linear"):
        out = clean.fill_gaps(panel_of(values), mode).orderBy("cell", "t").collect()
        assert [r.value for r in out[:4]] == [None] * 4
        assert np.allclose([r.value for r in out[4:8]], [1, 2, 3, 4])
        assert np.allclose([r.value for r in out[8:]], [2] * 4)


def test_sparse_threshold_is_strict(panel_of):
    values = np.ones((2, 20))
    values[0, :3] = np.nan  # exactly 15 %
    values[1, :4] = np.nan
    out = clean.drop_sparse_cells(panel_of(values))
    assert out.filter("cell = 0 and value is not null").count() == 17
    assert out.filter("cell = 1 and value is not null").count() == 0


def test_mask_never_touches_the_border(spark):
    rows = [("s", 0, t, x, y, None if (x, y) != (1, 1) else 1.0) for t in (0, 1) for x in range(3) for y in range(3)]
    grid = spark.createDataFrame(
        rows, "series string, layer int, t long, lon_idx int, lat_idx int, value double"
    )
    assert clean.mask_isolated(grid).filter("value is not null").count() == 0
    few = grid.withColumn("value", F.when(F.col("lon_idx") == 0, F.lit(None)).otherwise(F.lit(1.0)))
    assert clean.mask_isolated(few).filter("value is not null").count() == 12


def test_standardise_and_back(panel_of, matrix_of):
    values = np.random.default_rng(4).normal(3, 2, size=(4, 50))
    values[3] = 1.0
    panel = panel_of(values)
    std = clean.standardise(panel)
    got = matrix_of(std)
    assert np.allclose(got[:3], ((values - values.mean(1, keepdims=True)) / values.std(1, ddof=1, keepdims=True))[:3])
    assert np.isnan(got[3]).all()
    assert (matrix_of(clean.fill_missing(std))[3] == 0).all()
    frames = clean.standardise_frames(to_frames(panel))
    assert np.allclose(np.array(frames.orderBy("t").first()["values"][:3]), got[:3, 0])


def test_decode_limits(spark):
    raw = spark.createDataFrame([(-32768,), (-301,), (-300,), (4500,), (4501,)], "raw int")
    values = [r.value for r in clean.decode_packed(raw, "raw").collect()]
    assert values[0] is None and values[1] is None and values[4] is None
    assert np.allclose(values[2:4], [270.15, 318.15])


def test_regrid(panel_of, matrix_of):
    values = np.random.default_rng(5).normal(size=(8, 5))
    coarse = matrix_of(regrid_1d(panel_of(values), 2))
    assert np.allclose(coarse, values.reshape(4, 2, 5).mean(1))
    frames = regrid_1d_frames(to_frames(panel_of(values)), 2, 8)
    assert np.allclose(frames.orderBy("t").first()["values"], coarse[:, 0])
    with pytest.raises(ValueError):
        regrid_1d(panel_of(values), 3)


def test_regrid_reads_computed_frames_once(spark):
    # merged into the lambda, the scaled values would be computed again for every coarse cell
    frames = spark.range(3).select(F.col("id").alias("t"), F.expr("array(id * 1D, 2D, 3D, 4D)").alias("values"))
    scaled = frames.withColumn("values", F.zip_with("values", "values", lambda v, w: v * w))
    coarse = regrid_1d_frames(regrid_1d_frames(scaled, 2, 4), 2, 2)
    plan = coarse._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" in plan and "slice(zip_with(" not in plan and "slice(transform(" not in plan
    assert [list(r["values"]) for r in coarse.orderBy("t").collect()] == [[(t * t + 4 + 9 + 16) / 4] for t in range(3)]


def test_regrid_2d_min_valid(spark):
    rows = [("s", 0, 0, x, y, None if x == 0 else float(y)) for x in range(2) for y in range(2)]
    grid = spark.createDataFrame(rows, "series string, layer int, t long, lon_idx int, lat_idx int, value double")
    assert regrid_2d(grid, 2, 2).first().value == 0.5
    assert regrid_2d(grid, 2, 2, min_valid=3).first().value is None


def test_lags_cross_chunks(panel_of):
    values = np.arange(40.0).reshape(2, 20)
    out = delay_embed(panel_of(values), 3, 2, washout=1, chunk=7).orderBy("cell", "t").collect()
    assert [(r.t, r.lag0, r.lag1, r.lag2) for r in out[:15]] == [(t, t, t - 2, t - 4) for t in range(5, 20)]
    ahead = next_step_target(panel_of(values), chunk=4).orderBy("cell", "t").collect()
    assert [(r.t, r.target) for r in ahead[:19]] == [(t, t + 1) for t in range(19)]


def test_complete_panel(spark):
    panel = spark.createDataFrame(
        [("s", 0, 0, 0, 1.0), ("s", 0, 3, 1, 2.0)], "series string, layer int, t long, cell int, value double"
    )
    full = complete_panel(panel)
    assert full.count() == 8 and full.filter("value is not null").count() == 2


def missing_after(missing, passes, scan):
    """Cells blanked on one grid, by loops."""
    state, hit = missing.copy(), np.zeros_like(missing)
    lon, lat = missing.shape
    while passes is None or passes > 0:
        before, seen = state.copy(), state.copy()
        for i in range(1, lon - 1):
            for j in range(1, lat - 1):
                source = state if scan else seen
                if source[i - 1:i + 2, j - 1:j + 2].sum() >= 7:
                    state[i, j] = hit[i, j] = True
        if passes is not None:
            passes -= 1
        elif (state == before).all():
            break
    return hit


@pytest.mark.parametrize("passes, order", [(1, "snapshot"), (3, "snapshot"), (None, "snapshot"), (1, "scan")])
def test_mask_equals_loops(spark, passes, order):
    rng = np.random.default_rng(8)
    grids = {f"g{k}": rng.random((14, 11)) < 0.5 + 0.05 * k for k in range(4)}
    rows = [(s, 0, t, int(i), int(j), None if m[i, j] and t == 0 else 1.0)
            for s, m in grids.items() for t in (0, 1) for i in range(14) for j in range(11)]
    panel = spark.createDataFrame(rows, "series string, layer int, t long, lon_idx int, lat_idx int, value double")
    got = clean.mask_isolated(panel, passes=passes, order=order).filter("t = 1 AND value IS NULL")
    blanked = {(r.series, r.lon_idx, r.lat_idx) for r in got.collect()}
    want = {(s, i, j) for s, m in grids.items() for i, j in np.argwhere(missing_after(m, passes, order == "scan"))}
    assert blanked == want and want


def test_mask_refuses_two_scans_and_takes_an_empty_panel(spark):
    empty = spark.createDataFrame([], "series string, layer int, t long, lon_idx int, lat_idx int, value double")
    assert clean.mask_isolated(empty, passes=None).count() == 0
    with pytest.raises(ValueError, match="1 for a scan"):
        clean.mask_isolated(empty, passes=2, order="scan")


def test_copies_follow_files_and_parameters(spark, tmp_path, panel_of):
    """Only a layer whose files or parameters changed is cleaned again; a copy without manifest does not count."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(16, 40))
    values[5, :30] = np.nan
    values[3, 7] = np.nan
    paths = {l: str(tmp_path / f"raw{l}") for l in (0, 1)}
    for l, path in paths.items():
        panel_of(values + l, layer=l).write.parquet(path)
    out, lat = str(tmp_path / "clean"), {0: 4, 1: 4}
    first = cleaned_copies(spark, paths, lat, out)
    assert first.cleaned == [0, 1] and first.panel.count() == 2 * 16 * 40
    assert first.panel.filter("cell = 5 AND value IS NOT NULL").count() == 0
    assert first.panel.filter("cell = 3 AND value IS NULL").count() == 0
    group = "cleaning-again"
    spark.sparkContext.setJobGroup(group, group)
    again = cleaned_copies(spark, paths, lat, out)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("other", "other")
    assert again.cleaned == [] and len(jobs) <= 10  # fingerprints, manifests and footers only
    assert sorted(again.panel.collect()) == sorted(first.panel.collect())
    assert cleaned_copies(spark, paths, lat, out, Cleaning(max_missing=0.9)).cleaned == [0, 1]
    panel_of(values[:, :20], series="more", layer=1).write.mode("append").parquet(paths[1])
    assert cleaned_copies(spark, paths, lat, out).cleaned == [1]
    lost = next((tmp_path / "clean" / "layer-0").iterdir()) / "manifest"
    for part in lost.glob("*.parquet"):
        part.unlink()
    assert len(cleaned_copies(spark, {0: paths[0]}, lat, out).cleaned) + len(
        cleaned_copies(spark, {0: paths[0]}, lat, out, Cleaning(max_missing=0.9)).cleaned) == 1
    ready = finished(again.panel, refinement=2)
    assert ready.filter("value IS NULL").count() == 0 and ready.count() == 2 * 16 * 79
