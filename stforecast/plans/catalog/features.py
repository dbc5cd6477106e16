"""Catalogue: readout features, Gram sums, seeded nets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stforecast.functions.columns import square_even
from stforecast.operators import features as ft
from stforecast.operators import weights as wt
from stforecast.operators.readout import gram
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog.registry import query
from stforecast.session import spread

r = sql.r


@query(
    "square_even",
    f"""WITH {sql.EMB} SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell,
        {r('CASE WHEN cell % 2 = 1 THEN value * value ELSE value END')} AS value FROM emb""",
)
def square_even_job(spark, sf_dir):
    frames = p.emb_frames(spark, sf_dir)
    return p.present(frames.select("t", F.posexplode(square_even(F.col("values"))).alias("cell", "value")))


@query(
    "index_combos",
    f"""WITH {sql.EMB}, s AS (SELECT DISTINCT CAST(cell AS BIGINT) AS i FROM emb)
    SELECT a.i AS i0, b.i AS i1 FROM s a JOIN s b ON a.i <= b.i""",
)
def index_combos_job(spark, sf_dir):
    linear = p.emb_panel(spark, sf_dir).select(F.col("cell").alias("i")).distinct()
    idx = ft.index_combos(linear, 2)
    return p.present(idx.select(F.get("idx", F.lit(0)).alias("i0"), F.get("idx", F.lit(1)).alias("i1")))


@query(
    "index_combos_three",
    """SELECT CAST(a.n_nationkey AS BIGINT) AS i0, CAST(b.n_nationkey AS BIGINT) AS i1,
              CAST(c.n_nationkey AS BIGINT) AS i2
    FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey
                  JOIN nation c ON b.n_nationkey <= c.n_nationkey""",
)
def index_combos_three_job(spark, sf_dir):
    linear = p.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    idx = ft.index_combos(linear, 3)
    return p.present(idx.select(*[F.get("idx", F.lit(k)).alias(f"i{k}") for k in range(3)]))


# linear terms: two lags of the eight coarse cells
LINEAR = "lin AS (SELECT unnest(range(0, 2 * (SELECT max(cell) + 1 FROM z8))) AS i)"


def _linear(spark, sf_dir, past: int = 2):
    """Linear indices of a delay vector over the cells of the coarse panel."""
    cells = p.emb8(spark, sf_dir).select("cell").distinct()
    counted = cells.agg(F.max("cell").alias("top"))
    return counted.select(
        F.explode(F.sequence(F.lit(0), (F.col("top") + 1) * past - 1)).alias("i")
    )


DICTIONARY = LINEAR + """,
dict AS (
  SELECT 0 AS f, 0 AS degree, -1 AS i0, -1 AS i1
  UNION ALL SELECT 1 + i, 1, i, -1 FROM lin
  UNION ALL
  SELECT (SELECT count(*) FROM lin) + row_number() OVER (ORDER BY a.i, b.i), 2, a.i, b.i
  FROM lin a JOIN lin b ON a.i <= b.i)"""


@query(
    "feature_length",
    f"""WITH {sql.Z8}, n AS (SELECT 2 * (max(cell) + 1) AS n FROM z8)
    SELECT CAST(degree AS BIGINT) AS degree, CAST(CASE degree WHEN 0 THEN 1 WHEN 1 THEN n
           WHEN 2 THEN n * (n + 1) // 2 ELSE n * (n + 1) * (n + 2) // 6 END AS BIGINT) AS n_features
    FROM n, (SELECT unnest(range(4)) AS degree)""",
)
def feature_length_job(spark, sf_dir):
    dictionary = ft.feature_dictionary(_linear(spark, sf_dir), 3)
    return p.present(dictionary.groupBy("degree").agg(F.count("*").alias("n_features")))


DELAYED = """dl AS (
  SELECT t, cell, value, lag(value, 1) OVER w AS lag1, lead(value, 1) OVER w AS target FROM z8
  WINDOW w AS (PARTITION BY cell ORDER BY t)),
vec AS (
  SELECT t, list_concat(list(value ORDER BY cell), list(lag1 ORDER BY cell)) AS v,
         list(target ORDER BY cell) AS y
  FROM dl WHERE t >= 11 AND target IS NOT NULL GROUP BY t),
phi AS (
  SELECT vec.t, dict.f, dict.degree,
    CASE degree WHEN 0 THEN 1.0 WHEN 1 THEN v[i0 + 1] ELSE v[i0 + 1] * v[i1 + 1] END AS value
  FROM vec, dict)"""


@query(
    "delay_embed",
    f"""WITH {sql.Z8}, w AS (
      SELECT t, cell, value AS lag0, lag(value, 2) OVER w AS lag1, lag(value, 4) OVER w AS lag2
      FROM z8 WINDOW w AS (PARTITION BY cell ORDER BY t))
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('lag0')} AS lag0,
           {r('lag1')} AS lag1, {r('lag2')} AS lag2 FROM w WHERE t >= 14""",
)
def delay_embed_job(spark, sf_dir):
    out = ft.delay_embed(p.emb8(spark, sf_dir), 3, 2, washout=10, chunk=128)
    return p.present(out.select("t", "cell", "lag0", "lag1", "lag2"))


@query(
    "delay_frames",
    f"""WITH {sql.Z8}, {DICTIONARY}, {DELAYED}
    SELECT CAST(t AS BIGINT) AS t, CAST(k AS BIGINT) AS pos, {r('value')} AS value
    FROM (SELECT t, unnest(range(0, len(v))) AS k, unnest(v) AS value FROM vec)""",
)
def delay_frames_job(spark, sf_dir):
    delayed = ft.delay_frames(p.emb8_frames(spark, sf_dir), 2, 1, washout=10, chunk=64)
    return p.present(delayed.select("t", F.posexplode("lin").alias("pos", "value")))


def _features(spark, sf_dir, n_features: int = 0):
    delayed = ft.delay_frames(p.emb8_frames(spark, sf_dir), 2, 1, washout=10)
    dictionary = ft.feature_dictionary(_linear(spark, sf_dir), 2)
    return ft.poly_features(delayed, ft.select_features(dictionary, n_features, 5))


def _long_features(features):
    pairs = F.arrays_zip("feature_ids", "phi")
    return p.present(features.select("t", F.explode(pairs).alias("_p")).select(
        "t", F.col("_p.feature_ids").alias("f"), F.col("_p.phi").alias("value")
    ))


def _feature_sql(value: str = "value", where: str = "") -> str:
    return f"""WITH {sql.Z8}, {DICTIONARY}, {DELAYED},
    chosen AS (
      SELECT f FROM dict ORDER BY CASE WHEN f = 0 THEN -1 ELSE {sql.seeded_int(5, 'f')} END LIMIT 40)
    SELECT CAST(t AS BIGINT) AS t, CAST(f AS BIGINT) AS f, {r(value)} AS value FROM phi {where}"""


@query("poly_features", _feature_sql())
def poly_features_job(spark, sf_dir):
    return _long_features(_features(spark, sf_dir))


@query("select_features", _feature_sql(where="WHERE f IN (SELECT f FROM chosen)"))
def select_features_job(spark, sf_dir):
    return _long_features(_features(spark, sf_dir, 40))


@query(
    "jitter_features",
    _feature_sql(f"value + 0.01 * {sql.seeded_normal(3, 't', 'f')}", "WHERE f IN (SELECT f FROM chosen)"),
)
def jitter_features_job(spark, sf_dir):
    return _long_features(ft.jitter_features(_features(spark, sf_dir, 40), 0.01, 3))


@query(
    "gram",
    f"""WITH {sql.EMB}, lab AS (SELECT vec_id AS t, label FROM embeddings)
    SELECT CAST(label AS BIGINT) AS label, CAST(a.cell AS BIGINT) AS i, CAST(b.cell AS BIGINT) AS j,
           {r('sum(a.value * b.value)')} AS value
    FROM emb a JOIN emb b ON a.t = b.t JOIN lab ON lab.t = a.t GROUP BY 1, 2, 3""",
)
def gram_job(spark, sf_dir):
    rows = p.table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("phi")
    )
    sums = gram(rows, ["label"], y=None)
    return p.present(sums.select("label", "i", F.posexplode("row").alias("j", "value")))


# --- seeded nets: one net per supplier -------------------------------------------


def net_spec(spark, sf_dir):
    """One small net per supplier, its gain from the account balance."""
    return p.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run"), F.lit(0).alias("layer"), F.col("s_suppkey").alias("seed"),
        F.lit(20).alias("n"), F.lit(0.9).alias("g"), F.lit(5).alias("degree"),
        (F.col("s_acctbal") / 10000).alias("g_in_rec"), F.lit(0.2).alias("g_in_neigh"),
        F.lit(0.3).alias("g_in_layer"), F.lit(0.5).alias("tau"), F.lit(0.25).alias("dt"),
        F.lit(4).alias("d_rec"), F.lit(2).alias("d_neigh"), F.lit(1).alias("d_layer"),
    )


def _input_sql(mode: str) -> str:
    units = "i // 2 = c AND i < 14" if mode == "structured" else "true"
    return f"""WITH cells AS (
      SELECT s_suppkey AS run, s_acctbal / 10000 AS g, i, c FROM supplier,
        (SELECT unnest(range(20)) AS i), (SELECT unnest(range(7)) AS c))
    SELECT CAST(run AS BIGINT) AS run, CASE WHEN c < 4 THEN 'rec' WHEN c < 6 THEN 'neigh' ELSE 'layer' END AS tag,
      CAST(i AS BIGINT) AS i, CAST(CASE WHEN c < 4 THEN c WHEN c < 6 THEN c - 4 ELSE c - 6 END AS BIGINT) AS j,
      {r(f"CASE WHEN c < 4 THEN g WHEN c < 6 THEN 0.2 ELSE 0.3 END * (2 * {sql.seeded_uniform('run', 0, 11, 'i', 'c')} - 1)")} AS w
    FROM cells WHERE {units}"""


@query("input_weights_structured", _input_sql("structured"))
def input_weights_structured_job(spark, sf_dir):
    return p.present(wt.input_weights(net_spec(spark, sf_dir)).drop("layer"))


@query("input_weights_random", _input_sql("random"))
def input_weights_random_job(spark, sf_dir):
    return p.present(wt.input_weights(net_spec(spark, sf_dir), "random").drop("layer"))


RAW_NETS = f"""raw AS (
  SELECT s_suppkey AS run, i, j, {sql.seeded_normal('s_suppkey', 0, 13, 'i', 'j')} AS w
  FROM supplier, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j)
  WHERE {sql.seeded_uniform('s_suppkey', 0, 12, 'i', 'j')} < 5 / CAST(20 AS DOUBLE))"""


@query(
    "raw_recurrent_weights",
    f"""WITH {RAW_NETS} SELECT CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i,
        CAST(j AS BIGINT) AS j, {r('w')} AS w FROM raw""",
)
def raw_recurrent_weights_job(spark, sf_dir):
    return p.present(wt.raw_recurrent_weights(net_spec(spark, sf_dir)).select("run", "i", "j", "w"))


@query(
    "recurrent_weights",
    f"""WITH {RAW_NETS}, n AS (SELECT run, count(*) AS entries, max(abs(w)) AS top FROM raw GROUP BY run),
    ratio AS (
      SELECT raw.run, raw.i, raw.j, raw.w / n.top AS shape, n.entries FROM raw JOIN n ON n.run = raw.run)
    SELECT CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
           {r('shape')} AS shape, entries, true AS radius_ok FROM ratio""",
)
def recurrent_weights_job(spark, sf_dir):
    """Scaled entries in units of the largest one, and whether the radius is the asked one."""
    import numpy as np
    import pyarrow as pa

    scaled = wt.recurrent_weights(net_spec(spark, sf_dir))

    def check(batches):
        for nets, first in wt.whole_nets(batches):
            counts = np.diff(np.append(first, nets.num_rows))
            w = nets.column("w").to_numpy()
            shape = w / np.repeat(np.maximum.reduceat(np.abs(w), first), counts)
            right = np.abs(wt.spectral_radii(nets, first, np.full(len(first), 20)) - 0.9) < 1e-9
            added = {"shape": shape, "entries": np.repeat(counts, counts), "radius_ok": np.repeat(right, counts)}
            out = nets.select(["run", "i", "j"])
            for name, values in added.items():
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    return p.present(spread(scaled, "run", "layer").sortWithinPartitions("run", "layer").mapInArrow(
        check, "run long, i int, j int, shape double, entries long, radius_ok boolean"
    ))


def deep_spec(spark, sf_dir):
    """A three-level net per supplier; radius and leak differ by level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return p.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), level.alias("level")).select(
        "run", "level", F.col("run").alias("seed"), F.lit(12).alias("nr"),
        (0.9 - 0.1 * F.col("level")).alias("rho"), (1.0 - 0.2 * F.col("level")).alias("leak"),
        F.lit(0.5).alias("input_scale"), F.lit(0.25).alias("inter_scale"),
        F.lit(0.4).alias("sparsity"), F.lit(4).alias("nu"),
    )


@query(
    "deep_weights",
    f"""WITH lv AS (SELECT s_suppkey AS run, unnest(range(3)) AS level FROM supplier),
    ij AS (SELECT i, j FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(12)) AS j)),
    raw AS (
      SELECT run, level, i, j, {sql.seeded_normal('run', 'level', 13, 'i', 'j')} AS w FROM lv, ij
      WHERE {sql.seeded_uniform('run', 'level', 12, 'i', 'j')} < 0.4),
    al AS (
      SELECT run, level, 'W' AS tag, i, j, w / max(abs(w)) OVER (PARTITION BY run, level) AS w FROM raw
      UNION ALL
      SELECT run, level, 'inter', i, j, 0.25 * (2 * {sql.seeded_uniform('run', 'level', 14, 'i', 'j')} - 1)
      FROM lv, ij WHERE level > 0
      UNION ALL
      SELECT run, level, 'rec', i, j, 0.5 * (2 * {sql.seeded_uniform('run', 'level', 11, 'i', 'j')} - 1)
      FROM lv, ij WHERE level = 0 AND j < 4 AND i // 3 = j)
    SELECT CAST(run AS BIGINT) AS run, CAST(level AS BIGINT) AS level, tag, CAST(i AS BIGINT) AS i,
           CAST(j AS BIGINT) AS j, {r('w')} AS w FROM al""",
)
def deep_weights_job(spark, sf_dir):
    """Weights of every level; recurrent entries in units of the largest of their net."""
    from pyspark.sql import Window as W

    top = F.max(F.abs("w")).over(W.partitionBy("run", "layer", "tag"))
    shape = F.when(F.col("tag") == "W", F.col("w") / top).otherwise(F.col("w"))
    return p.present(wt.deep_weights(deep_spec(spark, sf_dir)).select(
        "run", F.col("layer").alias("level"), "tag", "i", "j", shape.alias("w")
    ))


# The radius in SQL: largest entries of the matrix squared 45 times over give the growth of its
# powers, and its root of order 2^45 is the radius to about 13 digits.
SCALED = f"""WITH RECURSIVE lv AS (SELECT s_suppkey AS run, unnest(range(3)) AS level FROM supplier),
    ij AS (SELECT i, j FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(12)) AS j)),
    raw AS (
      SELECT run, level, i, j, CASE WHEN {sql.seeded_uniform('run', 'level', 12, 'i', 'j')} < 0.4
        THEN {sql.seeded_normal('run', 'level', 13, 'i', 'j')} ELSE 0 END AS w FROM lv, ij),
    rows AS (SELECT run, level, i, list(w ORDER BY j) AS row, max(abs(w)) AS top FROM raw GROUP BY run, level, i),
    first AS (SELECT run, level, max(top) AS s, list(row ORDER BY i) AS m FROM rows GROUP BY run, level),
    pw AS (
      SELECT run, level, CAST(0 AS BIGINT) AS k, ln(s) AS growth,
             list_transform(m, lambda row: list_transform(row, lambda x: x / s)) AS m FROM first
      UNION ALL
      SELECT run, level, k + 1, growth + ln(s) / power(2, k + 1), list_transform(p, lambda row: list_transform(row, lambda x: x / s))
      FROM (SELECT *, list_max(list_transform(p, lambda row: list_max(list_transform(row, lambda x: abs(x))))) AS s FROM (
        SELECT run, level, k, growth, list_transform(m, lambda row: list_transform(range(1, 13), lambda j:
          list_sum(list_transform(range(1, 13), lambda q: row[q] * m[q][j])))) AS p FROM pw WHERE k < 45))),
    radius AS (SELECT run, level, exp(growth) AS radius FROM pw WHERE k = 45)
    SELECT CAST(run AS BIGINT) AS run, CAST(level AS BIGINT) AS level, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
           {r('w * (0.9 - 0.1 * level) / radius')} AS w
    FROM raw JOIN radius USING (run, level) WHERE w <> 0"""


@query("deep_weights_scaled", SCALED)
def deep_weights_scaled_job(spark, sf_dir):
    """Recurrent entries of every level at the radius that the level asks for."""
    weights = wt.deep_weights(deep_spec(spark, sf_dir)).filter("tag = 'W'")
    return p.present(weights.select("run", F.col("layer").alias("level"), "i", "j", "w"))


@query(
    "layer_params",
    f"""SELECT CAST(l_suppkey AS BIGINT) AS config_id, CAST(1 AS BIGINT) AS layer,
        {r('avg(l_discount)')} AS g, {r('avg(l_tax)')} AS ridge
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey""",
)
def layer_params_job(spark, sf_dir):
    config = p.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("config_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("layer"),
    ).agg(F.avg("l_discount").alias("g"), F.avg("l_tax").alias("ridge"))
    return p.present(wt.layer_params(config, 1))
