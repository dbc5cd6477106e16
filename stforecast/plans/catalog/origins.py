"""Catalogue: many runs, many origins and whole sweeps over one history."""

from __future__ import annotations

from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators import evaluate as ev
from stforecast.operators import stack as sk
from stforecast.operators import sweep as sw
from stforecast.operators import weights as wt
from stforecast.operators.regrid import regrid_1d_frames
from stforecast.plans import pipelines as pl
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog import sqlmodel as sm
from stforecast.plans.catalog.models import COARSE, FINE
from stforecast.plans.catalog.registry import query
from stforecast.sources.panel import chunked_rank

r = sql.r

# Every label is a series of its own length; two nets each; origins at shares of its length.
SHARES, STEPS, WARMUP, WASHOUT, NETS, WIDTH = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 5, 6, 4, 2, 18
LABELS = """lf AS (SELECT label AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding AS e FROM embeddings),
    lv AS (SELECT series, t, list_transform(range(8), lambda c: list_avg(list_transform(e[8 * c + 1:8 * c + 8], lambda x: x::DOUBLE))) AS v
           FROM lf)"""


def label_frames(spark, sf_dir):
    """One series a label: eight cells, steps in order of vec_id."""
    rows = p.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("series"), "vec_id", "embedding")
    ranked = chunked_rank(rows, ["series"], "vec_id", F.floor(F.col("vec_id") / 4096), "t")
    return ranked.select("series", F.lit(0).alias("layer"), F.col("t").cast("long").alias("t"), F.expr("""
        transform(sequence(0, 7), c -> aggregate(slice(CAST(embedding AS ARRAY<DOUBLE>), 8 * c + 1, 8), 0D, (s, x) -> s + x) / 8)
    """).alias("values"))


def runs_model(width: int | None) -> sm.RunsReservoir:
    first = "0" if width is None else f"greatest(0, origin - {width})"
    windows = f"""SELECT DISTINCT series, origin, {first} AS first, origin AS last FROM (
      SELECT series, CAST(floor(share * (n - {STEPS})) AS BIGINT) AS origin
      FROM (SELECT series, count(*) AS n FROM lv GROUP BY series), (SELECT unnest([{", ".join(map(str, SHARES))}]::DOUBLE[]) AS share))"""
    return sm.RunsReservoir("m", "lv", 8, 4, 1, 8, seed=0, washout=WASHOUT, nets=NETS, windows=windows)


def given_nets(spec):
    """Weights SQL can state too: seeded draws times a fixed factor instead of a radius."""
    damped = wt.raw_recurrent_weights(spec).withColumn("w", F.col("w") * F.lit(0.3))
    return damped.unionByName(wt.input_weights(spec))


def _backtest(spark, sf_dir, width: int | None):
    model = runs_model(width)
    frames = label_frames(spark, sf_dir)
    lengths = frames.groupBy("series").agg(F.count("*").alias("n"))
    windows = pl.rolling_windows(lengths, SHARES, STEPS, width)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NETS - 1).cast("long"))).alias("seed")
    spec = lengths.select("series", each).select(
        (F.col("series").cast("long") * NETS + F.col("seed")).alias("run"), "series", F.lit(0).alias("layer"), "seed",
        F.lit(8).alias("n"), F.lit(4).alias("degree"), F.lit(0.3).alias("g"),
        *[F.lit(g).alias(c) for g, c in zip(model.gains, ("g_in_rec", "g_in_neigh", "g_in_layer"), strict=True)],
        F.lit(1.0).alias("tau"), F.lit(0.5).alias("dt"),
    )
    block_map = bl.blocks_1d(spark, 8, 4, 1)
    sized = wt.with_dimensions(spec, bl.check_dimensions(block_map))
    result = pl.backtest_refit(
        frames, block_map, spec, windows, STEPS, WASHOUT, WARMUP, model.ridge, weights=given_nets(sized))
    return frames, result.forecast


@query(
    "backtest_refit",
    f"""WITH RECURSIVE {LABELS}, {runs_model(None).runs(WARMUP, STEPS)}
    SELECT CAST(run AS BIGINT) AS run, origin, t, CAST(cell AS BIGINT) AS cell, {r('value')} AS yhat FROM mfc""",
)
def backtest_refit_job(spark, sf_dir):
    """Ten series, two nets each, six origins; each origin's readouts know only the steps before it."""
    _, forecast = _backtest(spark, sf_dir, None)
    return p.present(forecast.select("run", "origin", "t", "cell", "yhat"))


@query(
    "backtest_refit_sliding",
    f"""WITH RECURSIVE {LABELS}, {runs_model(WIDTH).runs(WARMUP, STEPS)},
    st AS (SELECT f.run, f.origin, f.t, sum((f.value - a.v[f.cell + 1]) ** 2) AS sse, count(*) AS n
           FROM mfc f JOIN lv a ON a.series = f.run // {NETS} AND a.t = f.t WHERE f.t >= f.origin GROUP BY ALL)
    SELECT CAST(run AS BIGINT) AS run, origin, t, row_number() OVER w AS t_len,
      {r('sqrt(sum(sse) OVER w / sum(n) OVER w)')} AS rmse
    FROM st WINDOW w AS (PARTITION BY run, origin ORDER BY t)""",
)
def backtest_refit_sliding_job(spark, sf_dir):
    """The same with training windows of fixed width, as error curves."""
    frames, forecast = _backtest(spark, sf_dir, WIDTH)
    ahead = forecast.filter(F.col("t") >= F.col("origin")).withColumn(
        "series", F.floor(F.col("run") / NETS).cast("string"))
    truth = frames.select("series", "layer", "t", F.posexplode("values").alias("cell", "value"))
    curve = ev.error_curve(ev.align_forecast(ahead, truth), ["run", "origin"])
    return p.present(curve.select("run", "origin", "t", "t_len", "rmse"))


# A hundred nets on the whole embeddings panel in one pass: their mean states.
MANY = 100


def _many_sql() -> str:
    one = sm.Reservoir("y", "z8", 8, 4, 1, 4, seed=0)
    return f"""WITH RECURSIVE {sql.Z8}, {sm.SPAN}, {one.inputs()},
    w AS (SELECT net, i, list(CASE WHEN {sql.seeded_uniform('net', 0, 12, 'i', 'j')} < 0.5
            THEN 0.3 * {sql.seeded_normal('net', 0, 13, 'i', 'j')} ELSE 0 END ORDER BY j) AS row
          FROM (SELECT unnest(range({MANY})) AS net), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY net, i),
    v AS (SELECT net, i, list(CASE WHEN i = c THEN (CASE WHEN c < 2 THEN 0.5 ELSE 0.4 END) * (2 * {sql.seeded_uniform('net', 0, 11, 'i', 'c')} - 1)
            ELSE 0 END ORDER BY c) AS row
          FROM (SELECT unnest(range({MANY})) AS net), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS c) GROUP BY net, i),
    nt AS (SELECT net, (SELECT list(CAST(row AS DOUBLE[]) ORDER BY i) FROM w WHERE w.net = k.net) AS wm,
             (SELECT list(CAST(row AS DOUBLE[]) ORDER BY i) FROM v WHERE v.net = k.net) AS wn
           FROM (SELECT unnest(range({MANY})) AS net) k),
    st AS (
      SELECT net, block, CAST(0 AS BIGINT) AS t, {sm.zeros(4)} AS x FROM nt, (SELECT unnest(range(4)) AS block)
      UNION ALL
      SELECT s.net, s.block, s.t + 1, list_transform(range(1, 5), lambda k: 0.5 * s.x[k] + 0.5 *
        tanh(list_dot_product(nt.wm[k], s.x) + list_dot_product(nt.wn[k], i.u)))
      FROM st s JOIN yin i ON i.block = s.block AND i.t = s.t JOIN nt ON nt.net = s.net, pr WHERE s.t + 1 < pr.n)
    SELECT CAST(net AS BIGINT) AS run, CAST(block AS BIGINT) AS block, CAST(unit AS BIGINT) AS unit, count(*) AS n,
      {r('sum(x)')} AS total, {r('sum(x * x)')} AS square
    FROM (SELECT net, block, unnest(range(4)) AS unit, unnest(x) AS x FROM st) GROUP BY net, block, unit"""


def many_setup(spark, sf_dir, count: int = MANY):
    block_map = bl.blocks_1d(spark, 8, 4, 1)
    spec = spark.range(count).select(
        F.col("id").alias("run"), F.lit("emb").alias("series"), F.lit(0).alias("layer"), F.col("id").alias("seed"), F.lit(4).alias("n"),
        F.lit(2).alias("degree"), F.lit(0.0).alias("g"), F.lit(0.5).alias("g_in_rec"), F.lit(0.4).alias("g_in_neigh"),
        F.lit(0.0).alias("g_in_layer"), F.lit(1.0).alias("tau"), F.lit(0.5).alias("dt"))
    sized = wt.with_dimensions(spec, bl.check_dimensions(block_map))
    nets = wt.pack_reservoir(sized, given_nets(sized)).withColumn("series", F.lit("emb"))
    return block_map, nets, bl.gather_inputs(p.emb8_frames(spark, sf_dir), block_map, map_rows=16)


@query("stack_states", _many_sql())
def stack_states_job(spark, sf_dir):
    block_map, nets, inputs = many_setup(spark, sf_dir)
    states = sk.stack_states(inputs, nets, block_map, 0, p.frame_count(spark, sf_dir))
    long = states.select("run", "block", F.posexplode("x").alias("unit", "x"))
    return p.present(long.groupBy("run", "block", "unit").agg(
        F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("square")))


def _sweep_table(errors: list[str], names: str) -> str:
    """Mean and deviation over repetitions of the error curve at every fourth step."""
    return f"""er AS ({' UNION ALL '.join(errors)}),
    es AS (SELECT {names}, rep, t_len, sum(se) AS sse, count(*) AS n FROM er GROUP BY ALL),
    cu AS (SELECT {names}, rep, t_len, sqrt(sum(sse) OVER w / sum(n) OVER w) AS rmse
           FROM es WINDOW w AS (PARTITION BY {names}, rep ORDER BY t_len))"""


# Two layers: the gain of the coarse input and the fine ridge vary, the coarse layer does not.
GAINS, RIDGES, REPS, AHEAD = (0.1, 0.3), (0.1, 10.0), 2, 15
COARSE_GAINS = (0.5, 0.4, 0.0)


def _layers_sql() -> str:
    parts, errors = [], []
    for rep in range(REPS):
        upper = sm.Reservoir(f"c{rep}", "z4", 4, 2, 1, 8, seed=rep, gains=COARSE_GAINS, quadratic=False, washout=30)
        parts += [upper.net(), upper.inputs(), upper.states(), upper.fit(), upper.fitted(),
                  upper.rollout("SELECT stop AS origin FROM pr", 25, AHEAD),
                  f"""li{rep} AS (SELECT t, cell, value FROM c{rep}ft, pr WHERE t < stop
                      UNION ALL SELECT t, cell, value FROM c{rep}fc, pr WHERE t >= stop)"""]
    for config, gain in enumerate(GAINS):
        for rep in range(REPS):
            run = config * REPS + rep
            for k, ridge in enumerate(RIDGES):
                net = sm.Reservoir(
                    f"f{run}r{k}", "z8", 8, 4, 1, 10, seed=run, layer=1, gains=(0.5, 0.4, gain), ridge=ridge, washout=30,
                    coarse=f"li{rep}", n_layer=1, linked=FINE.linked)
                parts += [net.net(), net.inputs(), net.states(), net.fit(),
                          net.rollout("SELECT stop AS origin FROM pr", 25, AHEAD)]
                errors.append(f"""
                  SELECT {config} AS config_id, {gain} AS g_in_layer, {ridge} AS ridge, {rep} AS rep,
                         f.t - pr.stop + 1 AS t_len, (f.value - z8.value) ** 2 AS se
                  FROM {net.p}fc f JOIN z8 ON z8.t = f.t AND z8.cell = f.cell, pr WHERE f.t >= pr.stop""")
    return f"""WITH RECURSIVE {sql.Z8}, {sm.SPAN},
    z4 AS (SELECT t, cell // 2 AS cell, avg(value) AS value FROM z8 GROUP BY t, cell // 2), {', '.join(parts)},
    {_sweep_table(errors, 'config_id, g_in_layer, ridge')}
    SELECT CAST(config_id AS BIGINT) AS config_id, {r('g_in_layer')} AS g_in_layer, {r('ridge')} AS ridge,
           'rmse' || ((t_len - 1) // 4 + 1) AS err, {r('avg(rmse)')} AS mean, {r('stddev_samp(rmse)')} AS std,
           count(*) AS n_rep
    FROM cu WHERE (t_len - 1) % 4 = 0 GROUP BY config_id, g_in_layer, ridge, t_len"""


@query("sweep_layers", _layers_sql())
def sweep_layers_job(spark, sf_dir):
    """The finer layer's grid on coarse values that are made once a repetition."""
    n = p.frame_count(spark, sf_dir)
    fine = p.emb8_frames(spark, sf_dir)
    common = {"degree": 4, "g": 0.0, "g_in_rec": 0.5, "g_in_neigh": 0.4, "tau": 1.0, "dt": 0.5}
    out = pl.sweep_layers(
        [regrid_1d_frames(fine, 2, 8), fine], p.emb8(spark, sf_dir).drop("layer"),
        [bl.blocks_1d(spark, 4, 2, 1), bl.blocks_1d_linked(spark, 8, 2, 4, 1, 2, "exclude")],
        {**common, "n": 8, "g_in_layer": 0.0, "ridge": COARSE.ridge}, sw.config_grid(spark, {"g_in_layer": list(GAINS)}),
        RIDGES, {**common, "n": 10, "degree": 5}, REPS, (0, n - sm.LAST), AHEAD, 30, 25, ("linear", "quadratic"), weights=given_nets,
    )
    return p.present(out)


# Deep nets: the input scale and the ridge vary.
SCALES = (0.25, 0.5)


def _deep_sql() -> str:
    parts, errors = [], []
    for config, scale in enumerate(SCALES):
        for rep in range(REPS):
            run = config * REPS + rep
            q = f"d{run}"
            parts += [
                sm.deep_states(8, 8, run, "z8", q, scale),
                f"{q}fe AS (SELECT t, {sm.squared('list_concat(x1, x2)')} AS z FROM {q}st, pr WHERE t >= 30 AND t < stop - 1)",
                f"{q}ta AS (SELECT t - 1 AS t, u AS y FROM {q}fr)",
            ]
            for k, ridge in enumerate(RIDGES):
                m = f"{q}k{k}"
                parts += [
                    sm.ridge_fit(m, f"{q}fe", f"{q}ta", 16, 8, ridge),
                    f"""{m}r AS (
                      SELECT stop - 26 AS t, {sm.zeros(8)} AS x1, {sm.zeros(8)} AS x2, {sm.zeros(8)} AS y FROM pr
                      UNION ALL
                      SELECT t + 1, y1, y2, list_transform(range(1, 9), lambda o: list_dot_product({m}w.w[o],
                               {sm.squared('list_concat(y1, y2)')}))
                      FROM (SELECT t, y1, {sm.deep_step(8, 1, 'x2', 'y1')} AS y2
                            FROM (SELECT e.t, e.x2, {sm.deep_step(8, 0, 'e.x1', 'e.u')} AS y1, {q}n.*
                                  FROM (SELECT d.t, d.x1, d.x2, CASE WHEN d.t + 1 < pr.stop THEN f.u ELSE d.y END AS u
                                        FROM {m}r d JOIN {q}fr f ON f.t = d.t + 1, pr
                                        WHERE d.t + 1 < pr.stop + {AHEAD}) e, {q}n)), {m}w)""",
                ]
                errors.append(f"""
                  SELECT {config} AS config_id, {scale} AS input_scale, {ridge} AS ridge, {rep} AS rep,
                         f.t + 1 - stop + 1 AS t_len, (f.value - z8.value) ** 2 AS se
                  FROM (SELECT t, unnest(range(8)) AS cell, unnest(y) AS value FROM {m}r) f
                  JOIN z8 ON z8.t = f.t + 1 AND z8.cell = f.cell, pr WHERE f.t + 1 >= stop AND f.t + 1 < stop + {AHEAD}""")
    return f"""WITH RECURSIVE {sql.Z8}, {sm.SPAN}, {', '.join(parts)},
    {_sweep_table(errors, 'config_id, input_scale, ridge')}
    SELECT CAST(config_id AS BIGINT) AS config_id, {r('input_scale')} AS input_scale, {r('ridge')} AS ridge,
           'rmse' || ((t_len - 1) // 4 + 1) AS err, {r('avg(rmse)')} AS mean, {r('stddev_samp(rmse)')} AS std,
           count(*) AS n_rep
    FROM cu WHERE (t_len - 1) % 4 = 0 GROUP BY config_id, input_scale, ridge, t_len"""


def given_deep(spec):
    """Deep weights SQL can state too: raw seeded entries times a fixed factor."""
    raw = wt._sparse_normal(spec.withColumn("layer", F.col("level")), "nr", F.col("sparsity")).select(
        "run", "layer", F.lit("W").alias("tag"), "i", "j", (F.col("w") * 0.3).alias("w"))
    return raw.unionByName(wt.deep_input_weights(spec))


@query("sweep_deep", _deep_sql())
def sweep_deep_job(spark, sf_dir):
    n = p.frame_count(spark, sf_dir)
    level = {"nr": 8, "rho": 0.5, "inter_scale": 0.25, "sparsity": 0.4, "nu": 8}
    out = pl.sweep_deep(
        p.emb8_frames(spark, sf_dir), p.emb8(spark, sf_dir), 8, sw.config_grid(spark, {"input_scale": list(SCALES)}), RIDGES,
        [{**level, "leak": leak} for leak in sm.DEEP_LEAKS], REPS, (0, n - sm.LAST), AHEAD, 30, 25, weights=given_deep,
    )
    return p.present(out)
