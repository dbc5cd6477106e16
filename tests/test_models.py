"""Model jobs against plain numpy on small systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators import features as ft
from stforecast.operators import readout as ro
from stforecast.operators import rollout as rl
from stforecast.operators import segments as sg
from stforecast.operators import states as st
from stforecast.operators import weights as wt
from stforecast.plans import pipelines as pl
from stforecast.sources import to_frames

L, T, B, N = 8, 160, 4, 15
DATA = 0.5 * np.random.default_rng(11).normal(size=(L, T))


def spec(spark, runs=2, **change):
    values = {
        "n": N, "g": 0.8, "degree": 4, "g_in_rec": 0.5, "g_in_neigh": 0.4, "g_in_layer": 0.3,
        "tau": 0.5, "dt": 0.25, "d_rec": 2, "d_neigh": 2, "d_layer": 0, **change,
    }
    return spark.range(runs).select(
        F.col("id").alias("run"), F.lit(0).alias("layer"), (F.col("id") + 3).alias("seed"),
        *[F.lit(v).alias(k) for k, v in values.items()],
    )


@pytest.fixture(scope="module")
def weights(spark):
    return wt.reservoir_weights(spec(spark)).cache()


@pytest.fixture(scope="module")
def nets(spark, weights):
    return wt.pack_reservoir(spec(spark), weights).cache()


@pytest.fixture
def setup(spark, panel_of):
    frames = to_frames(panel_of(DATA))
    runs = spark.range(2).select(F.col("id").alias("run"), F.lit("s").alias("series"))
    frames = st.attach_runs(frames, runs).drop("series")
    m = bl.blocks_1d(spark, L, B, 1)
    return frames, m, bl.gather_inputs(frames, m, keys=["run"])


def null_arrays(rows, *names):
    """Rows that send a null array to a Python task, for each column."""
    return rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first().asDict()


def test_rows_behind_a_net_hold_no_null_arrays(setup, nets):
    # Spark walks the nulls of a list column again for every row that it adds to a batch
    _, m, inputs = setup
    names = [n for n in st.NET if n != "n_inputs"]
    starts = sg.starts_of(sg.segment_starts(inputs, nets, m, 0, T, 80, 1e-8))
    rows = st._placed(inputs, nets, m, 0, T, 80, 0, starts=starts)
    assert set(null_arrays(rows, *names, "x0").values()) == {0}
    assert rows.filter("t IS NULL AND size(w_w) > 0").count() == 2 * B * 2
    assert rows.filter("t IS NOT NULL AND size(w_w) = 0").count() == 2 * B * T


def dense(weights, run):
    """W and [rec | neigh] input matrix of a run."""
    w, win = np.zeros((N, N)), np.zeros((N, 4))
    for r in weights.filter(f"run = {run}").collect():
        if r.tag == "W":
            w[r.i, r.j] = r.w
        else:
            win[r.i, r.j + {"rec": 0, "neigh": 2}[r.tag]] = r.w
    return w, win


def block_cells(b):
    return [2 * b, 2 * b + 1], [(2 * b - 1) % L, (2 * b + 2) % L]


def sq(x):
    z = x.copy()
    z[..., 1::2] **= 2
    return z


def np_states(w, win, b, stop, start=0, a=0.5):
    rec, neigh = block_cells(b)
    x, out = np.zeros(N), []
    for t in range(start, stop):
        out.append(x)
        x = (1 - a) * x + a * np.tanh(w @ x + win @ DATA[rec + neigh, t])
    return np.array(out)


def np_fit(w, win, b, stop, washout, ridge, mode):
    x = np_states(w, win, b, stop)[washout:]
    z = sq(x) if mode == "quadratic" else x
    y = DATA[block_cells(b)[0], washout:stop].T
    return y.T @ z @ np.linalg.inv(z.T @ z + ridge * np.eye(N))


def test_recurrent_radius_and_density(spark):
    big = spec(spark, runs=3, n=60, degree=6, g=0.7)
    for run in range(3):
        m = np.zeros((60, 60))
        rows = wt.recurrent_weights(big).filter(f"run = {run}").collect()
        for r in rows:
            m[r.i, r.j] = r.w
        assert abs(np.abs(np.linalg.eigvals(m)).max() - 0.7) < 1e-9
        assert 200 < len(rows) < 540  # 360 expected


def test_weights_depend_on_seed_not_on_partitions(spark, weights):
    again = wt.reservoir_weights(spec(spark).repartition(7))
    assert weights.exceptAll(again).count() == 0
    w0, w1 = dense(weights, 0)[0], dense(weights, 1)[0]
    assert not np.allclose(w0, w1)


def test_structured_input_blocks(spark, weights):
    _, win = dense(weights, 0)
    q = N // 4
    for c in range(4):
        used = np.flatnonzero(win[:, c])
        assert set(used) <= set(range(c * q, (c + 1) * q))
    assert not win[4 * q:].any()
    assert wt.input_weights(spec(spark, d_rec=0, d_neigh=0)).count() == 0
    assert wt.input_weights(spec(spark, n=3, d_rec=4)).count() == 0  # fewer units than inputs
    with pytest.raises(ValueError):
        wt.input_weights(spec(spark), "other")


def test_states_of_every_run_and_block(setup, nets, weights):
    _, m, inputs = setup
    got = st.leaky_tanh_states(inputs, nets, m, 0, T).toPandas()
    for run in range(2):
        w, win = dense(weights, run)
        for b in range(B):
            x = np.stack(got[(got.run == run) & (got.block == b)].sort_values("t")["x"].to_numpy())
            assert np.allclose(x, np_states(w, win, b, T), atol=1e-13)


def test_segments_forget_their_start(setup, nets):
    _, m, inputs = setup
    whole = st.leaky_tanh_states(inputs, nets, m, 0, T)
    parts = st.leaky_tanh_states(inputs, nets, m, 0, T, segment=40, overlap=40)
    both = whole.join(parts.withColumnRenamed("x", "z"), ["run", "layer", "block", "t"])
    assert both.count() == whole.count() == parts.count() == 2 * B * T
    gap = F.array_max(F.zip_with("x", "z", lambda p, q: F.abs(p - q)))
    # the leak halves the memory and the radius is 0.8: 40 steps leave about 1e-2 at most
    assert 0 < both.agg(F.max(gap)).first()[0] < 0.05
    exact = parts.filter("t < 40").join(whole.withColumnRenamed("x", "z"), ["run", "layer", "block", "t"])
    assert exact.agg(F.max(gap)).first()[0] == 0


def test_gaps_in_time_are_refused(setup, nets):
    _, m, inputs = setup
    with pytest.raises(Exception, match="without gaps"):
        st.leaky_tanh_states(inputs.filter("t <> 50"), nets, m, 0, T).count()


@pytest.mark.parametrize("mode", ["linear", "quadratic"])
def test_fit_for_many_ridges_from_one_pass(setup, nets, weights, mode):
    _, m, inputs = setup
    got = ro.fit_block_readouts(inputs, nets, m, 0, 120, 10, [1e-4, 1e-1], mode).collect()
    assert len(got) == 2 * B * 2
    for r in got:
        want = np_fit(*dense(weights, r.run), r.block, 120, 10, r.ridge, mode)
        assert np.allclose(np.reshape(r.coef, want.shape), want, rtol=1e-6, atol=1e-7)


def test_segmented_gram_is_the_sum(setup, nets):
    _, m, inputs = setup
    parts = st.state_gram(inputs, nets, m, 0, 120, 10, segment=40, overlap=40)
    one = ro.sum_gram(parts, ro.BLOCK, 3).orderBy("run", "block", "i").collect()
    two = ro.sum_gram(parts, ro.BLOCK).orderBy("run", "block", "i").collect()
    assert np.allclose([r["row"] for r in one], [r["row"] for r in two])
    assert len(one) == 2 * B * N


def test_bad_modes(setup, nets):
    _, m, inputs = setup
    with pytest.raises(ValueError):
        st.state_gram(inputs, nets, m, 0, 120, 10, mode="cubic")


def test_rollout_states_lead_to_the_outputs(spark, setup, nets):
    frames, m, inputs = setup
    readouts = ro.fit_block_readouts(inputs, nets, m, 0, 120, 10, [1e-2], "linear").cache()
    origins = rl.origin_table(spark.range(2).withColumnRenamed("id", "run"), [120, 130])
    args = (frames, nets, readouts, m, origins, 15, 12, "linear")
    states = rl.rollout_blocks(*args, states=True)
    rows = states.collect()
    assert len({(r.run, r.origin, r.block, r.t) for r in rows}) == len(rows) == 2 * 2 * B * 27
    coef = {(r.run, r.block): np.reshape(r.coef, (2, N)) for r in readouts.collect()}
    want = {(r.run, r.origin, r.t, r.cell): r.yhat for r in rl.rollout_blocks(*args).collect()}
    for r in rows:
        out = coef[r.run, r.block] @ np.array(r.x)
        assert np.allclose(out, [want[r.run, r.origin, r.t, 2 * r.block + o] for o in range(2)], atol=1e-9)
    with pytest.raises(Exception, match="bytes"):
        rl.rollout_blocks(*args, max_bytes=rl.system_bytes(L, N, 27), states=True).count()


def test_rollout_from_kept_states(spark, setup, nets):
    frames, m, inputs = setup
    readouts = ro.fit_block_readouts(inputs, nets, m, 0, 120, 10, [1e-2]).cache()
    runs = spark.range(2).withColumnRenamed("id", "run")
    kept = sg.segment_starts(inputs, nets, m, 0, 140, 30, 0.0).cache()
    key = ["run", "layer", "origin", "t", "cell"]
    for origin in (120, 131):  # right at a kept step, and eleven steps after one
        origins = rl.origin_table(runs, [origin])
        want = rl.rollout_blocks(frames, nets, readouts, m, origins, origin, 12).where(f"t >= {origin}")
        late = frames.where("t >= 120")  # nothing before the kept step is read
        got = rl.rollout_blocks(late, nets, readouts, m, origins, 0, 12, kept=kept)
        assert got.agg(F.min("t")).first()[0] == 120
        both = want.join(got.withColumnRenamed("yhat", "z"), key)
        assert both.count() == want.count() == 2 * 12 * L
        assert both.agg(F.max(F.abs(F.col("yhat") - F.col("z")))).first()[0] < 1e-9
    for few in (kept.where("x0_t > 120"), kept.where("block <> 2 OR x0_t < 120")):
        with pytest.raises(Exception, match="no kept state"):
            rl.rollout_blocks(frames, nets, readouts, m, origins, 0, 12, kept=few).count()


@pytest.mark.parametrize("mode", ["linear", "quadratic"])
def test_coupled_rollout(spark, setup, nets, weights, mode):
    frames, m, inputs = setup
    readouts = ro.fit_block_readouts(inputs, nets, m, 0, 120, 10, [1e-2], mode)
    origins = rl.origin_table(spark.range(2).withColumnRenamed("id", "run"), [120, 130])
    args = (frames, nets, readouts, m, origins, 15, 12, mode)
    got = rl.rollout_blocks(*args).toPandas()
    assert len(got) == 2 * 2 * 27 * L
    for run in range(2):
        w, win = dense(weights, run)
        wo = [np_fit(w, win, b, 120, 10, 1e-2, mode) for b in range(B)]
        for origin in (120, 130):
            x = [np.zeros(N) for _ in range(B)]
            for t in range(origin - 15, origin + 12):
                out = np.concatenate([wo[b] @ (sq(x[b]) if mode == "quadratic" else x[b]) for b in range(B)])
                part = got[(got.run == run) & (got.origin == origin) & (got.t == t)].sort_values("cell")
                assert np.allclose(part.yhat, out, atol=1e-6)
                v = DATA[:, t] if t < origin else out
                for b in range(B):
                    rec, neigh = block_cells(b)
                    x[b] = 0.5 * x[b] + 0.5 * np.tanh(w @ x[b] + win @ v[rec + neigh])


def test_single_layer_shapes(spark, setup):
    frames, m, _ = setup
    plain = spec(spark).drop("d_rec", "d_neigh", "d_layer")
    result = pl.forecast_single_layer(frames, m, plain, (0, 120), [120], 30, 10, 10, 1e-4)
    assert result.forecast.count() == 2 * L * 40
    assert result.fitted.count() == 2 * L * 120
    assert result.readouts.count() == 2 * B
    assert result.forecast.filter("yhat is null or isnan(yhat)").count() == 0


def test_two_layers_shapes(spark, panel_of):
    def frames_of(values, layer):
        return to_frames(panel_of(values, layer=layer)).select(F.lit(0).cast("long").alias("run"), "layer", "t", "values")

    coarse = DATA.reshape(4, 2, T).mean(1)
    one = spec(spark, runs=1).drop("d_rec", "d_neigh", "d_layer")
    maps = [bl.blocks_1d(spark, 4, 2, 1), bl.blocks_1d_linked(spark, 8, 2, 4, 1, 2, "include")]
    results = pl.forecast_layers(
        [frames_of(coarse, 0), frames_of(DATA, 1)], maps,
        one.unionByName(one.withColumn("layer", F.lit(1))), (0, 120), 20, 10, 10,
        [1e-2, 1e-2], ["quadratic", "linear"],
    )
    assert [r.forecast.count() for r in results] == [4 * 30, 8 * 30]
    assert results[1].forecast.filter("layer <> 1 or isnan(yhat)").count() == 0


def test_two_layers_from_several_origins(spark, panel_of):
    """Each origin is forecast as if it were alone, and from nothing that lies behind it."""

    def frames_of(values, layer):
        return to_frames(panel_of(values, layer=layer)).select(F.lit(0).cast("long").alias("run"), "layer", "t", "values")

    one = spec(spark, runs=1).drop("d_rec", "d_neigh", "d_layer")
    maps = [bl.blocks_1d(spark, 4, 2, 1), bl.blocks_1d_linked(spark, 8, 2, 4, 1, 2, "include")]

    def forecast(data, origins):
        results = pl.forecast_layers(
            [frames_of(data.reshape(4, 2, T).mean(1), 0), frames_of(data, 1)], maps,
            one.unionByName(one.withColumn("layer", F.lit(1))), (0, 110), 8, 10, 6,
            [1e-2, 1e-2], ["linear", "quadratic"], "random", origins=origins,
        )
        rows = results[0].forecast.unionByName(results[1].forecast).collect()
        return {(r.layer, r.origin, r.t, r.cell): r.yhat for r in rows}

    together = forecast(DATA, [110, 117, 123])
    assert len(together) == 3 * (4 + 8) * 14
    changed = DATA.copy()
    changed[:, 117:] += 5.0
    alone = forecast(changed, [117])
    assert len(alone) == 12 * 14
    assert max(abs(v - together[k]) for k, v in alone.items()) < 1e-9
    with pytest.raises(ValueError, match="inside the training span"):
        pl.forecast_layers([], [], one, (0, 110), 8, 10, 6, [], [], origins=[100])


def test_deep_states_and_closed_loop(spark, panel_of):
    data = DATA[:4]
    levels = spark.range(2).select(
        F.lit(0).cast("long").alias("run"), F.col("id").cast("int").alias("level"), F.lit(9).alias("seed"),
        F.lit(12).alias("nr"), F.lit(0.6).alias("rho"), (1.0 - 0.3 * F.col("id")).alias("leak"),
        F.lit(0.5).alias("input_scale"), F.lit(0.3).alias("inter_scale"), F.lit(0.5).alias("sparsity"),
        F.lit(4).alias("nu"),
    )
    weights = wt.deep_weights(levels).cache()
    w, v = np.zeros((2, 12, 12)), [np.zeros((12, 4)), np.zeros((12, 12))]
    for r in weights.collect():
        (w[r.layer] if r.tag == "W" else v[r.layer])[r.i, r.j] = r.w
    for level in range(2):
        assert abs(np.abs(np.linalg.eigvals(w[level])).max() - 0.6) < 1e-9

    def step(x, u):
        y0 = np.tanh(w[0] @ x[0] + v[0] @ u)
        return [y0, 0.3 * x[1] + 0.7 * np.tanh(w[1] @ x[1] + v[1] @ y0)]

    frames = to_frames(panel_of(data)).select(F.lit(0).cast("long").alias("run"), "layer", "t", "values")
    result = pl.forecast_deep(frames, 4, levels, (0, 120), [130], 10, 5, 20, 1e-2, weights=weights)
    x, xs = [np.zeros(12)] * 2, []
    for t in range(120):
        x = step(x, data[:, t])
        xs.append(np.concatenate(x))
    z = sq(np.array(xs))[5:]
    wo = data[:, 6:121] @ z @ np.linalg.inv(z.T @ z + 1e-2 * np.eye(24))
    x, y, want = [np.zeros(12)] * 2, None, []
    for t in range(110, 140):
        x = step(x, data[:, t] if t < 130 else y)
        y = wo @ sq(np.concatenate(x))
        want.append(y)
    got = result.forecast.toPandas().pivot(index="t", columns="cell", values="yhat")
    assert list(got.index) == list(range(111, 141))
    assert np.allclose(got.to_numpy(), np.array(want), atol=1e-6)


@pytest.mark.parametrize("past,delay,degree,n_features", [(2, 1, 2, 0), (3, 2, 2, 20), (1, 1, 3, 0)])
def test_delay_forecast(spark, panel_of, past, delay, degree, n_features):
    data = DATA[:3]
    frames = to_frames(panel_of(data)).select(F.lit(0).cast("long").alias("run"), "layer", "t", "values")
    result = pl.forecast_delay(
        frames, 3, 80, 12, washout=5, past=past, delay=delay, degree=degree, ridge=1e-1,
        n_features=n_features, seed=4,
    )
    linear = spark.range(3 * past).select(F.col("id").cast("int").alias("i"))
    chosen = ft.select_features(ft.feature_dictionary(linear, degree), n_features, 4).collect()
    assert len(chosen) == (n_features or ft.feature_length(3 * past, degree))
    assert chosen[0].idx == []

    def phi(history):
        lin = np.concatenate([history[j * delay] for j in range(past)])
        return np.array([np.prod(lin[r.idx]) if r.idx else 1.0 for r in chosen])

    start = 5 + (past - 1) * delay
    rows = range(start, start + 80)
    z = np.array([phi([data[:, t - s] for s in range((past - 1) * delay + 1)]) for t in rows])
    y = data[:, start + 1 : start + 81].T
    wo = y.T @ z @ np.linalg.inv(z.T @ z + 0.1 * np.eye(z.shape[1]))
    assert np.allclose(np.reshape(result.readouts.first().coef, wo.shape), wo, atol=1e-7)
    fitted = result.fitted.toPandas().pivot(index="t", columns="cell", values="yhat")
    assert list(fitted.index) == [t + 1 for t in rows]
    assert np.allclose(fitted.to_numpy(), z @ wo.T, atol=1e-7)
    history = [data[:, start + 80 - s] for s in range((past - 1) * delay + 1)]
    got = result.forecast.toPandas().pivot(index="t", columns="cell", values="yhat")
    assert got.index[0] == start + 81
    for k in range(12):
        nxt = wo @ phi(history)
        assert np.allclose(got.to_numpy()[k], nxt, atol=1e-6)
        history = [nxt, *history[:-1]]


def test_noise_is_the_same_in_both_places(spark, panel_of):
    frames = to_frames(panel_of(DATA[:3]))
    linear = spark.range(6).select(F.col("id").cast("int").alias("i"))
    dictionary = ft.feature_dictionary(linear, 2)
    delayed = ft.delay_frames(frames, 2, 1)
    noisy = ft.jitter_features(ft.poly_features(delayed, dictionary), 0.1, 7)
    plain = ft.poly_features(delayed, dictionary)
    a = ro.gram(noisy, ["series"]).orderBy("i").collect()
    b = ro.delay_gram(delayed.repartition(3), dictionary, ["series"], 0.1, 7).orderBy("i").collect()
    assert np.allclose([r["row"] for r in a], [r["row"] for r in b])
    draws = np.concatenate([
        np.array(p.phi) - np.array(q.phi)
        for p, q in zip(noisy.orderBy("t").collect(), plain.orderBy("t").collect(), strict=True)
    ]) / 0.1
    assert abs(draws.mean()) < 0.06 and abs(draws.std() - 1) < 0.05


def test_combos_and_lengths(spark):
    def combos(n, k):
        linear = spark.range(n).select(F.col("id").cast("int").alias("i"))
        return [tuple(r.idx) for r in ft.index_combos(linear, k).orderBy("idx").collect()]

    assert combos(2, 2) == [(0, 0), (0, 1), (1, 1)]
    assert combos(3, 1) == [(0,), (1,), (2,)]
    assert combos(3, 0) == [()]
    assert ft.feature_length(4, 1) == 5 and ft.feature_length(4, 2) == 15
    with pytest.raises(ValueError):
        combos(2, -1)
    linear = spark.range(200).select(F.col("id").cast("int").alias("i"))
    with pytest.raises(ValueError, match="features exceed"):
        ft.feature_dictionary(linear, 2)


def test_choice_of_features(spark):
    linear = spark.range(4).select(F.col("id").cast("int").alias("i"))
    d = ft.feature_dictionary(linear, 2)
    assert [r.f for r in ft.select_features(d, 1).collect()] == [0]
    assert ft.select_features(d, 0).count() == ft.select_features(d, 99).count() == 15
    five = [r.f for r in ft.select_features(d, 5, 1).collect()]
    assert five == sorted(five) and five[0] == 0 and len(five) == 5


def test_pca_keeps_the_asked_share(panel_of):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2, 300))
    values = rng.normal(size=(6, 2)) @ base + 1e-3 * rng.normal(size=(6, 300)) + 2.0
    frames = to_frames(panel_of(values))
    components = ro.pca_fit(frames, ratio=0.999)
    rows = components.orderBy("k").collect()
    assert len(rows) == 2
    cov = np.cov(values)
    lam, q = np.linalg.eigh(cov)
    assert np.allclose([r.eigenvalue for r in rows], lam[::-1][:2])
    assert abs(abs(np.dot(rows[0].vector, q[:, -1])) - 1) < 1e-9
    restored = ro.pca_restore(ro.pca_reduce(frames, components), components)
    got = np.array([r["values"] for r in restored.orderBy("t").collect()]).T
    p = q[:, -2:] @ q[:, -2:].T
    assert np.allclose(got, p @ values)
    early = ro.pca_fit(frames, ratio=0.999, fit_until=100).orderBy("k").first()
    assert np.isclose(early.eigenvalue, np.linalg.eigvalsh(np.cov(values[:, :100]))[-1])


def test_system_size_is_checked():
    rl.check_system_size(1000, 400, 2000)
    with pytest.raises(ValueError):
        rl.check_system_size(10**7, 1000, 2000)


def test_ridges_alone_or_together_give_the_same():
    from stforecast.functions.numeric import ridge_solutions

    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 100))
    x[1:] = x[0] + 1e-5 * x[1:]  # near-collinear
    gram, cross = x @ x.T, rng.normal(size=(4, 100)) @ x.T
    both = ridge_solutions(gram, cross, [1e-6, 1e-3])
    for r, got in zip([1e-6, 1e-3], both, strict=True):
        assert np.allclose(got, ridge_solutions(gram, cross, [r])[0], rtol=1e-9, atol=0)


def test_a_system_too_large_for_a_task_fails(spark, setup, nets):
    frames, m, inputs = setup
    readouts = ro.fit_block_readouts(inputs, nets, m, 0, 120, 10, [1e-2])
    origins = rl.origin_table(spark.range(2).withColumnRenamed("id", "run"), [120])
    with pytest.raises(Exception, match="max_bytes"):
        rl.rollout_blocks(frames, nets, readouts, m, origins, 3, 4, max_bytes=100).count()
