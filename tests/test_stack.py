"""Many nets and many windows from one pass, against single passes and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators import readout as ro
from stforecast.operators import stack as sk
from stforecast.operators import states as st
from stforecast.operators import weights as wt
from stforecast.plans import pipelines as pl
from stforecast.sources import to_frames

L, T, B = 8, 90, 4
DATA = {"a": 0.5 * np.random.default_rng(1).normal(size=(L, T)), "b": 0.5 * np.random.default_rng(2).normal(size=(L, T - 20))}


def spec(spark, runs=6):
    """Nets of two sizes, each other one on series a."""
    return spark.range(runs).select(
        F.col("id").alias("run"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("series"), F.lit(0).alias("layer"),
        (F.col("id") + 3).alias("seed"), F.when(F.col("id") < 4, 12).otherwise(9).alias("n"), F.lit(4).alias("degree"),
        F.lit(0.8).alias("g"), F.lit(0.5).alias("g_in_rec"), F.lit(0.4).alias("g_in_neigh"), F.lit(0.0).alias("g_in_layer"),
        F.lit(0.5).alias("tau"), F.when(F.col("id") == 1, 0.125).otherwise(0.25).alias("dt"),
        F.lit(2).alias("d_rec"), F.lit(2).alias("d_neigh"), F.lit(0).alias("d_layer"),
    )


@pytest.fixture(scope="module")
def nets(spark):
    s = spec(spark)
    return wt.pack_reservoir(s, wt.reservoir_weights(s)).join(s.select("run", "series"), "run").cache()


@pytest.fixture
def setup(spark, panel_of):
    frames = to_frames(panel_of(DATA["a"], "a").unionByName(panel_of(DATA["b"], "b")))
    m = bl.blocks_1d(spark, L, B, 1)
    return frames, m, bl.gather_inputs(frames, m)


def collected(df, value):
    return {(r.run, r.block, r.t): np.array(r[value]) for r in df.collect()}


def test_rows_behind_nets_hold_no_null_arrays(setup, nets):
    # Spark walks the nulls of a list column again for every row that it adds to a batch
    _, m, inputs = setup
    names = [n for n in st.NET if n != "n_inputs"]
    rows = sk._placed(inputs, nets, m, 0, T, None, 0, sk.CHUNK_BYTES, ())
    nulls = rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    assert set(nulls) == {0}
    assert rows.filter("t IS NOT NULL").count() == B * (T + T - 20)


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 2000}, {"segment": 30, "overlap": 30}])
@pytest.mark.parametrize("after", [False, True])
def test_states_equal_single_passes(spark, setup, nets, monkeypatch, how, after):
    monkeypatch.setattr(sk, "SLICE_BYTES", 8 * 12 * 7)
    frames, m, inputs = setup
    per_run = st.attach_runs(inputs, nets.select("run", "series")).drop("series")
    split = {k: v for k, v in how.items() if k != "chunk_bytes"}
    one = collected(st.leaky_tanh_states(per_run, nets.drop("series"), m, 0, 70, after=after, **split), "x")
    many = collected(sk.stack_states(inputs, nets, m, 0, 70, after=after, **how), "x")
    assert one.keys() == many.keys() and len(one) == 6 * B * 70
    assert all(np.allclose(one[k], many[k], atol=1e-12) for k in one)


def test_inputs_are_sent_once_for_a_hundred_nets(spark, setup, nets):
    _, m, inputs = setup
    hundred = nets.filter("run < 2").drop("run", "series").crossJoin(spark.range(50)).select(
        (F.monotonically_increasing_id() % 1000).alias("run"), F.lit("a").alias("series"), *[c for c in nets.columns if c not in ("run", "series")])
    assert [r.chunks for r in sk.chunk_counts(hundred).collect()] == [1]
    placed = sk._placed(inputs, nets.filter("run = 0"), m, 0, 70, None, 0, sk.CHUNK_BYTES, ()).filter("t IS NOT NULL").count()
    many = sk._placed(inputs, hundred, m, 0, 70, None, 0, sk.CHUNK_BYTES, ()).filter("t IS NOT NULL").count()
    assert placed == many == 2 * B * 70
    assert {r.chunks for r in sk.chunk_counts(nets, 2000).collect()} == {2}


def test_a_missing_step_or_net_fails(setup, nets):
    _, m, inputs = setup
    with pytest.raises(Exception, match="one row per step"):
        sk.stack_states(inputs.filter("t <> 11"), nets, m, 0, 70).count()
    with pytest.raises(Exception, match="inputs without a net"):
        sk.stack_states(inputs, nets.filter("series = 'a'"), m, 0, 70).count()


WINDOWS = [("a", 60, 0, 60), ("a", 80, 0, 80), ("a", 80, 40, 80), ("a", 50, 20, 40), ("a", 89, 60, 89), ("b", 50, 0, 50), ("b", 65, 30, 60)]


@pytest.mark.parametrize("how", [{}, {"segment": 35, "overlap": 35}])
def test_window_readouts_equal_fits_of_each_window(spark, setup, nets, how):
    _, m, inputs = setup
    per_window = {}  # an origin has one window: number them
    listed = [(s, k, first, last) for k, (s, _, first, last) in enumerate(WINDOWS)]
    windows = spark.createDataFrame(listed, "series string, origin long, first long, last long")
    grams = sk.stack_gram(inputs, nets, m, 0, 89, 10, edges=sk.window_edges(windows), **how)
    total = ro.sum_gram(grams, ["run", "layer", "block", "bucket"])
    got = {(r.run, r.block, r.origin, r.ridge): np.array(r.coef).reshape(r.n_out, -1)
           for r in sk.window_readouts(total, windows, nets, [0.1, 10.0]).collect()}
    states = collected(sk.stack_states(inputs, nets, m, 0, 89, **how), "x")
    series = {r.run: r.series for r in nets.select("run", "series").collect()}
    for run, s in series.items():
        for k, (own, _, first, last) in enumerate(WINDOWS):
            if own != s:
                continue
            for b in range(B):
                steps = [t for t in range(max(first, 10), last) if (run, b, t) in states]
                z = np.array([states[run, b, t] for t in steps])
                z[:, 1::2] **= 2
                y = DATA[s][2 * b : 2 * b + 2, steps].T
                for ridge in (0.1, 10.0):
                    want = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y).T
                    assert np.allclose(got[run, b, k, ridge], want, rtol=1e-7, atol=1e-9)
                    per_window[run, b, k, ridge] = want
    assert got.keys() == per_window.keys()


def test_backtest_does_not_see_what_comes_after_its_origins(spark, setup, nets, panel_of):
    frames, m, _ = setup
    s = spec(spark).drop("d_rec", "d_neigh", "d_layer")
    windows = pl.rolling_windows(spark.createDataFrame([("a", T), ("b", T - 20)], "series string, n long"), [0.5, 1.0], 6)
    assert sorted(tuple(r) for r in windows.collect()) == [("a", 42, 0, 42), ("a", 84, 0, 84), ("b", 32, 0, 32), ("b", 64, 0, 64)]

    def forecasts(f):
        out = pl.backtest_refit(f, m, s, windows, 6, 10, 8, 0.1).forecast
        return {(r.run, r.origin, r.t, r.cell): r.yhat for r in out.collect()}

    one = forecasts(frames)
    assert len(one) == 6 * 2 * 14 * L
    later = frames.withColumn("values", F.when(F.col("t") >= 84, F.transform("values", lambda v: v + 9)).otherwise(F.col("values")))
    two = forecasts(later)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    early = windows.withColumn("last", F.col("last") + 1)
    with pytest.raises(ValueError, match="beyond its origin"):
        pl.backtest_refit(frames, m, s, early, 6, 10, 8, 0.1)
