"""Catalogue: scores, sweeps, configuration tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators import evaluate as ev
from stforecast.operators import sweep as sw
from stforecast.operators import weights as wt
from stforecast.plans import pipelines as pl
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog import sqlmodel as sm
from stforecast.plans.catalog.prepare import _lineitem_errors
from stforecast.plans.catalog.registry import query

r = sql.r

# A forecast of every step by the step before, one run per half of the cells.
PERSIST = sql.Z + """,
al AS (
  SELECT cell // 32 AS run, t, cell, value, lag(value) OVER (PARTITION BY cell ORDER BY t) AS yhat FROM z),
fc AS (SELECT run, t, cell, value, yhat, yhat - value AS error FROM al WHERE t >= 1)"""


def _persist(spark, sf_dir):
    panel = p.emb_std(spark, sf_dir)
    forecast = panel.select(
        F.floor(F.col("cell") / 32).alias("run"), F.lit(0).alias("layer"), F.lit(1).cast("long").alias("origin"),
        (F.col("t") + 1).alias("t"), "cell", F.col("value").alias("yhat"),
    )
    return ev.align_forecast(forecast, panel)


@query(
    "align_forecast",
    f"""WITH {PERSIST} SELECT CAST(run AS BIGINT) AS run, CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell,
        {r('value')} AS value, {r('yhat')} AS yhat, {r('error')} AS error FROM fc""",
)
def align_forecast_job(spark, sf_dir):
    return p.present(_persist(spark, sf_dir).select("run", "t", "cell", "value", "yhat", "error"))


@query(
    "rmse_upto",
    f"""WITH {PERSIST} SELECT CAST(run AS BIGINT) AS run, {r('sqrt(sum(error * error) / count(*))')} AS rmse
        FROM fc WHERE t < 1 + 100 AND cell IN (0, 5, 31, 32, 63) GROUP BY run""",
)
def rmse_upto_job(spark, sf_dir):
    # the first steps and the chosen cells are the operator's own arguments
    out = ev.rmse_upto(_persist(spark, sf_dir), 1, 100, [0, 5, 31, 32, 63], ["run"])
    return p.present(out)


@query(
    "rmse_all",
    f"""WITH {PERSIST} SELECT CAST(run AS BIGINT) AS run, {r('sqrt(sum(error * error) / count(*))')} AS rmse
        FROM fc GROUP BY run""",
)
def rmse_all_job(spark, sf_dir):
    return p.present(ev.rmse_upto(_persist(spark, sf_dir), 1, keys=["run"]))


CURVE = PERSIST + """,
se AS (SELECT run, t, sum(error * error) AS sse, count(*) AS n FROM fc GROUP BY run, t),
cu AS (SELECT run, t, row_number() OVER w AS t_len, sqrt(sum(sse) OVER w / sum(n) OVER w) AS rmse
       FROM se WINDOW w AS (PARTITION BY run ORDER BY t))"""


@query(
    "error_curve",
    f"""WITH {CURVE} SELECT CAST(run AS BIGINT) AS run, CAST(t AS BIGINT) AS t, t_len, {r('rmse')} AS rmse
        FROM cu""",
)
def error_curve_job(spark, sf_dir):
    return p.present(ev.error_curve(_persist(spark, sf_dir), ["run"]))


@query(
    "sample_curve_stride",
    f"""WITH {CURVE}, s AS (
      SELECT run, greatest(1, CAST(round_even(max(t_len) / 4.0, 0) AS BIGINT)) AS s FROM cu GROUP BY run)
    SELECT CAST(cu.run AS BIGINT) AS run, t_len, (t_len - 1) // s + 1 AS point, {r('rmse')} AS rmse
    FROM cu JOIN s ON s.run = cu.run WHERE (t_len - 1) % s = 0 AND (t_len - 1) // s < 4""",
)
def sample_curve_stride_job(spark, sf_dir):
    curve = ev.error_curve(_persist(spark, sf_dir), ["run"])
    return p.present(ev.sample_curve(curve, 4, keys=["run"]).select("run", "t_len", "point", "rmse"))


@query(
    "sample_curve_even",
    f"""WITH {CURVE}, s AS (
      SELECT run, i + 1 AS point, CAST(round_even(1 + i * (max(t_len) - 1) / 24.0, 0) AS BIGINT) AS at
      FROM cu, (SELECT unnest(range(25)) AS i) GROUP BY run, i)
    SELECT CAST(cu.run AS BIGINT) AS run, t_len, point, {r('rmse')} AS rmse
    FROM cu JOIN s ON s.run = cu.run AND s.at = cu.t_len""",
)
def sample_curve_even_job(spark, sf_dir):
    curve = ev.error_curve(_persist(spark, sf_dir), ["run"])
    return p.present(
        ev.sample_curve(curve, 25, "even", ["run"]).select("run", "t_len", "point", "rmse")
    )


@query(
    "forecast_error_table",
    f"""WITH {PERSIST}, n AS (SELECT count(*) - 120 AS origin FROM embeddings)
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell,
      {r('(t - origin) * 0.25 * 0.1')} AS lyapunov_time, {r('(cell + 1) * 0.34375')} AS position,
      {r('value')} AS actual, {r('yhat')} AS forecast, {r('error')} AS error
    FROM fc, n WHERE t - origin >= -40 AND t - origin < 80""",
)
def forecast_error_table_job(spark, sf_dir):
    n = p.frame_count(spark, sf_dir)
    out = ev.forecast_error_table(_persist(spark, sf_dir), 0.25, 0.1, 64, 22.0, n - 120, 1, 2)
    return p.present(out.select(
        "t", "cell", "lyapunov_time", "position", "actual", "forecast", "error"
    ))


# --- sweeps -----------------------------------------------------------------------

ERRORS = """er AS (
  SELECT l_suppkey % 10 AS config_id, l_linenumber AS rep, avg(l_discount) AS e1, avg(l_tax) AS e2,
         avg(l_quantity) AS e3
  FROM lineitem GROUP BY 1, 2),
lo AS (
  SELECT config_id, rep, 'discount' AS err, e1 AS error FROM er
  UNION ALL SELECT config_id, rep, 'tax', e2 FROM er
  UNION ALL SELECT config_id, rep, 'quantity', e3 FROM er)"""
NAMES = ["discount", "tax", "quantity"]


@query(
    "multi_error",
    f"""WITH {ERRORS} SELECT CAST(config_id AS BIGINT) AS config_id, CAST(rep AS BIGINT) AS rep, err,
        {r('error')} AS error FROM lo""",
)
def multi_error_job(spark, sf_dir):
    return p.present(sw.multi_error(_lineitem_errors(spark, sf_dir), NAMES))


@query(
    "sweep_stats",
    f"""WITH {ERRORS} SELECT CAST(config_id AS BIGINT) AS config_id, err, {r('avg(error)')} AS mean,
        {r('coalesce(stddev_samp(error), 0)')} AS std, count(*) AS n_rep FROM lo GROUP BY 1, 2""",
)
def sweep_stats_job(spark, sf_dir):
    return p.present(sw.sweep_stats(sw.multi_error(_lineitem_errors(spark, sf_dir), NAMES)))


def _sweep_table(spark, sf_dir):
    supplier = p.table(spark, sf_dir, "supplier")
    grid = supplier.groupBy((F.col("s_suppkey") % 10).alias("config_id")).agg(
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")
    )
    stats = sw.sweep_stats(sw.multi_error(_lineitem_errors(spark, sf_dir), NAMES))
    return sw.sweep_table(stats, grid, NAMES)


TABLE = ERRORS + """,
ta AS (
  SELECT s.config_id, s.balance, m.* EXCLUDE (config_id) FROM (
    SELECT s_suppkey % 10 AS config_id, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance
    FROM supplier GROUP BY 1) s
  JOIN (SELECT config_id, avg(e1) AS mean_discount, stddev_samp(e1) AS std_discount,
          avg(e2) AS mean_tax, stddev_samp(e2) AS std_tax, avg(e3) AS mean_quantity,
          stddev_samp(e3) AS std_quantity FROM er GROUP BY config_id) m ON m.config_id = s.config_id)"""
COLUMNS = ", ".join(
    ["CAST(config_id AS BIGINT) AS config_id", f"{r('balance')} AS balance"]
    + [f"{r(f'{s}_{n}')} AS {s}_{n}" for n in NAMES for s in ("mean", "std")]
)


@query("sweep_table", f"WITH {TABLE} SELECT {COLUMNS} FROM ta")
def sweep_table_job(spark, sf_dir):
    return p.present(_sweep_table(spark, sf_dir))


@query(
    "best_configs",
    f"WITH {TABLE} SELECT {COLUMNS} FROM (SELECT * FROM ta ORDER BY mean_quantity, config_id LIMIT 3)",
)
def best_configs_job(spark, sf_dir):
    return p.present(sw.best_configs(_sweep_table(spark, sf_dir), "mean_quantity", 3))


@query(
    "best_configs_per_key",
    f"""SELECT o_orderpriority, CAST(config_id AS BIGINT) AS config_id, {r('price', 2)} AS price FROM (
      SELECT o_orderpriority, o_custkey AS config_id, min(o_totalprice) AS price,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY min(o_totalprice), o_custkey) AS n
      FROM orders GROUP BY 1, 2) WHERE n <= 5""",
)
def best_configs_per_key_job(spark, sf_dir):
    table = p.table(spark, sf_dir, "orders").groupBy(
        "o_orderpriority", F.col("o_custkey").alias("config_id")
    ).agg(F.min("o_totalprice").alias("price"))
    return p.present(sw.best_configs(table, "price", 5, ["o_orderpriority"]), 2)


GRID_SQL = """gr AS (
  SELECT (dense_rank() OVER (ORDER BY a.v) - 1)
         + (SELECT count(DISTINCT c_mktsegment) FROM customer) * ((dense_rank() OVER (ORDER BY b.v) - 1)
         + (SELECT count(DISTINCT p_size) FROM part) * (dense_rank() OVER (ORDER BY c.v) - 1)) AS config_id,
         a.v AS segment, b.v AS size, c.v AS priority
  FROM (SELECT DISTINCT c_mktsegment AS v FROM customer) a, (SELECT DISTINCT p_size AS v FROM part) b,
       (SELECT DISTINCT o_orderpriority AS v FROM orders) c)"""


def _table_grid(spark, sf_dir):
    return sw.config_grid_from_tables({
        "segment": p.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")),
        "size": p.table(spark, sf_dir, "part").select(F.col("p_size").alias("size")),
        "priority": p.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")),
    })


@query(
    "config_grid",
    f"""WITH {GRID_SQL} SELECT CAST(config_id AS BIGINT) AS config_id, segment, CAST(size AS BIGINT) AS size,
        priority FROM gr""",
)
def config_grid_job(spark, sf_dir):
    return p.present(_table_grid(spark, sf_dir))


@query(
    "override_config",
    f"""SELECT CAST(o_orderkey AS BIGINT) AS config_id, CAST(layer AS BIGINT) AS layer,
      {r("CASE WHEN layer = 1 AND o_totalprice > 100000 THEN o_totalprice / 1000000 WHEN layer = 1 THEN 0.6 ELSE 0.1 END")} AS g,
      {r("CASE WHEN layer = 1 THEN 1.0 ELSE 0.00001 END")} AS ridge,
      CAST(CASE WHEN layer = 1 THEN 400 ELSE 1000 END AS BIGINT) AS n
    FROM orders, (SELECT unnest(range(2)) AS layer)""",
)
def override_config_job(spark, sf_dir):
    """The radius of the finer layer from each order, unless the order is too small."""
    grid = p.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("config_id"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 1000000).alias("radius"),
    )
    base = [{"g": 0.1, "ridge": 0.00001, "n": 1000}, {"g": 0.6, "ridge": 1.0, "n": 400}]
    return p.present(sw.override_config(grid, base, {"g": "radius"}, 1))


def _toy_errors(pdf: pd.DataFrame) -> list[float]:
    """User function of the sweep query: two errors from a run's parameters and seed."""
    row = pdf.iloc[0]
    return [float(row["size"] * len(row["segment"]) + row["rep"]), float(row["seed"] % 7)]


@query(
    "run_sweep",
    f"""WITH {GRID_SQL}, ru AS (
      SELECT config_id, segment, size, priority, size * len(segment) + rep AS e1, (config_id * 3 + rep) % 7 AS e2
      FROM gr, (SELECT unnest(range(3)) AS rep))
    SELECT CAST(config_id AS BIGINT) AS config_id, segment, CAST(size AS BIGINT) AS size, priority,
      {r('avg(e1)')} AS mean_err1, {r('stddev_samp(e1)')} AS std_err1,
      {r('avg(e2)')} AS mean_err2, {r('stddev_samp(e2)')} AS std_err2
    FROM ru GROUP BY ALL""",
)
def run_sweep_job(spark, sf_dir):
    return p.present(sw.run_sweep(_table_grid(spark, sf_dir), _toy_errors, repetitions=3))


# The sweep: gains x ridge values x repetitions; the seed of a net is its number.
SWEEP_GAINS, SWEEP_RIDGES, SWEEP_REPS, SWEEP_STEPS = (0.3, 0.6), (0.1, 10.0), 2, 15


def _sweep_sql() -> str:
    parts, errors = [], []
    for config, gain in enumerate(SWEEP_GAINS):
        for rep in range(SWEEP_REPS):
            for k, ridge in enumerate(SWEEP_RIDGES):
                run = config * SWEEP_REPS + rep
                net = sm.Reservoir(
                    f"s{run}r{k}", "z8", 8, 4, 1, 8, seed=run, gains=(gain, 0.4, 0.0), ridge=ridge, washout=20
                )
                parts += [net.net(), net.inputs(), net.states(), net.fit(),
                          net.rollout("SELECT stop AS origin FROM pr", 25, SWEEP_STEPS)]
                errors.append(f"""
                  SELECT {config} AS config_id, {gain} AS g_in_rec, {ridge} AS ridge, {rep} AS rep,
                         f.t - pr.stop + 1 AS t_len, (f.value - z8.value) ** 2 AS se
                  FROM {net.p}fc f JOIN z8 ON z8.t = f.t AND z8.cell = f.cell, pr WHERE f.t >= pr.stop""")
    return f"""WITH RECURSIVE {sql.Z8}, {sm.SPAN}, {', '.join(parts)},
    er AS ({' UNION ALL '.join(errors)}),
    st AS (SELECT config_id, g_in_rec, ridge, rep, t_len, sum(se) AS sse, count(*) AS n FROM er GROUP BY ALL),
    cu AS (SELECT config_id, g_in_rec, ridge, rep, t_len, sqrt(sum(sse) OVER w / sum(n) OVER w) AS rmse
           FROM st WINDOW w AS (PARTITION BY config_id, ridge, rep ORDER BY t_len))
    SELECT CAST(config_id AS BIGINT) AS config_id, {r('g_in_rec')} AS g_in_rec, {r('ridge')} AS ridge,
           'rmse' || ((t_len - 1) // 4 + 1) AS err, {r('avg(rmse)')} AS mean, {r('stddev_samp(rmse)')} AS std,
           count(*) AS n_rep
    FROM cu WHERE (t_len - 1) % 4 = 0 GROUP BY config_id, g_in_rec, ridge, t_len"""


@query("sweep_single_layer", _sweep_sql())
def sweep_single_layer_job(spark, sf_dir):
    """Gains x ridge values x repetitions of the block model, with weights SQL can state too."""
    n = p.frame_count(spark, sf_dir)

    def given(sized):
        damped = wt.raw_recurrent_weights(sized).withColumn("w", F.col("w") * 0.3)
        return damped.unionByName(wt.input_weights(sized))

    base = {"n": 8, "degree": 4, "g": 0.0, "g_in_neigh": 0.4, "g_in_layer": 0.0, "tau": 1.0, "dt": 0.5, "series": "emb"}
    out = pl.sweep_single_layer(
        p.emb8_frames(spark, sf_dir), p.emb8(spark, sf_dir), bl.blocks_1d(spark, 8, 4, 1),
        sw.config_grid(spark, {"g_in_rec": list(SWEEP_GAINS)}), SWEEP_RIDGES, base, SWEEP_REPS,
        (0, n - sm.LAST), SWEEP_STEPS, 20, 25, weights=given,
    )
    return p.present(out)


# Two series and two resolutions: a forecast of every step by the step before.
LAYERED = sql.Z + """,
la AS (SELECT label AS series, 0 AS layer, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,
              unnest(range(64)) AS cell, unnest(embedding)::DOUBLE AS value FROM embeddings),
both_ AS (SELECT * FROM la UNION ALL SELECT series, 1, t, cell // 2, avg(value) FROM la GROUP BY 1, 3, 4)"""


@query(
    "align_forecast_layers",
    f"""WITH {LAYERED} SELECT 's' || series AS series, CAST(layer AS BIGINT) AS layer, t, CAST(cell AS BIGINT) AS cell,
      {r('value')} AS value, {r('yhat')} AS yhat, {r('yhat - value')} AS error FROM (
        SELECT *, lag(value) OVER (PARTITION BY series, layer, cell ORDER BY t) AS yhat FROM both_)
    WHERE t > 0""",
)
def align_forecast_layers_job(spark, sf_dir):
    """Scores of ten series at two resolutions, kept apart by their keys."""
    order = Window.partitionBy("label").orderBy("vec_id")
    fine = p.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("series"), F.lit(0).alias("layer"),
        (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("embedding").cast("array<double>").alias("values"),
    ).select("series", "layer", "t", F.posexplode("values").alias("cell", "value"))
    coarse = fine.groupBy("series", "t", F.floor(F.col("cell") / 2).cast("int").alias("cell")).agg(
        F.avg("value").alias("value")).withColumn("layer", F.lit(1))
    panel = fine.unionByName(coarse)
    forecast = panel.select("series", "layer", (F.col("t") + 1).alias("t"), "cell", F.col("value").alias("yhat"))
    return p.present(ev.align_forecast(forecast, panel).select("series", "layer", "t", "cell", "value", "yhat", "error"))
