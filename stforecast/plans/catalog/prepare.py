"""Catalogue: sources, cleaning, regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from stforecast.operators import clean
from stforecast.operators.features import next_step_target
from stforecast.operators.regrid import regrid_1d, regrid_2d
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog.registry import query
from stforecast.plans.cleaning import Cleaning, cleaned_copies, finished
from stforecast.sources import (
    dense_time_index,
    flatten_cells,
    from_frames,
    read_panel,
    read_wide_csv,
    select_cells,
    stack_daily,
    time_slice,
    to_frames,
    unflatten_cells,
    write_panel,
    write_sweep_csv,
)

r = sql.r
PANEL = ["t", "cell", "value"]


def panel_sql(ctes: str, source: str, where: str = "", digits: int = 6) -> str:
    return (
        f"WITH {ctes} SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, "
        f"{r('value', digits)} AS value FROM {source} {where}"
    )


# --- sources and sinks ----------------------------------------------------------


def _write_wide(spark, sf_dir, with_time: bool) -> str:
    wide = p.emb_frames(spark, sf_dir).select(
        *(["t"] if with_time else []), *[F.get("values", F.lit(c)).alias(f"c{c}") for c in range(64)]
    ) if with_time else (
        p.emb_frames(spark, sf_dir).repartitionByRange(4, "t").sortWithinPartitions("t")
        .select(*[F.get("values", F.lit(c)).alias(f"c{c}") for c in range(64)])
    )
    path = f"{p.work_folder(spark)}/wide"
    wide.write.option("header", True).csv(path)
    return path


@query("read_wide_csv", panel_sql(sql.EMB, "emb"))
def read_wide_csv_job(spark, sf_dir):
    path = _write_wide(spark, sf_dir, with_time=False)
    return p.present(read_wide_csv(spark, path, 64).select(*PANEL))


@query("read_wide_csv_timed", panel_sql(sql.EMB, "emb"))
def read_wide_csv_timed_job(spark, sf_dir):
    path = _write_wide(spark, sf_dir, with_time=True)
    return p.present(read_wide_csv(spark, path, 64, time_col="t").select(*PANEL))


def _two_layers(spark, sf_dir) -> str:
    std = p.emb_panel(spark, sf_dir)
    coarse = regrid_1d(std, 8, n_cells=64, layer=1)
    path = f"{p.work_folder(spark)}/panel"
    write_panel(std.unionByName(coarse), path)
    return path


@query(
    "read_panel",
    f"WITH {sql.EMB} SELECT CAST(t AS BIGINT) AS t, CAST(cell // 8 AS BIGINT) AS cell, "
    f"{r('avg(value)')} AS value FROM emb GROUP BY t, cell // 8",
)
def read_panel_job(spark, sf_dir):
    return p.present(read_panel(spark, _two_layers(spark, sf_dir), [1]).select(*PANEL))


@query(
    "write_panel",
    f"""WITH {sql.EMB}
    SELECT CAST(0 AS BIGINT) AS layer, count(*) AS n, {r('sum(value)')} AS total FROM emb
    UNION ALL
    SELECT CAST(1 AS BIGINT), count(*), {r('sum(v)')} FROM
      (SELECT avg(value) AS v FROM emb GROUP BY t, cell // 8)""",
)
def write_panel_job(spark, sf_dir):
    back = read_panel(spark, _two_layers(spark, sf_dir))
    return p.present(back.groupBy("layer").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("panel_from_events", panel_sql(sql.EVENTS, "ev"))
def panel_from_events_job(spark, sf_dir):
    return p.present(p.event_panel(spark, sf_dir).select(*PANEL))


@query(
    "complete_panel",
    panel_sql(sql.EVENTS_FULL, "evf"),
)
def complete_panel_job(spark, sf_dir):
    return p.present(p.event_panel_full(spark, sf_dir).select(*PANEL))


@query(
    "stack_daily",
    f"""WITH {sql.DAILY}
    SELECT CAST(dense_rank() OVER (ORDER BY ts) - 1 AS BIGINT) AS t,
           CAST(cell AS BIGINT) AS cell, {r('value', 2)} AS value FROM daily""",
)
def stack_daily_job(spark, sf_dir):
    daily = p.daily_orders(spark, sf_dir)
    out = stack_daily(daily, "day", F.col("cell"), F.col("value"))
    return p.present(out.select(*PANEL), 2)


@query(
    "dense_time_index",
    """SELECT CAST(event_id AS BIGINT) AS event_id,
              CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS BIGINT) AS t
       FROM events""",
)
def dense_time_index_job(spark, sf_dir):
    events = p.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    indexed = dense_time_index(events, "ts", ["event_type"], F.date_trunc("day", "ts"))
    return p.present(indexed.select("event_id", "t"))


def _lineitem_errors(spark, sf_dir):
    """Mean discount, tax and quantity of (supplier group, line number), as error vectors."""
    return (
        p.table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 10).alias("config_id"), F.col("l_linenumber").alias("rep"))
        .agg(F.array(F.avg("l_discount"), F.avg("l_tax"), F.avg("l_quantity")).alias("errors"))
    )


@query(
    "write_sweep_csv",
    f"""SELECT CAST(l_suppkey % 10 AS BIGINT) AS config_id, CAST(l_linenumber AS BIGINT) AS rep,
        {r('avg(l_discount)')} AS first_error, CAST(3 AS BIGINT) AS n_errors
        FROM lineitem GROUP BY 1, 2""",
)
def write_sweep_csv_job(spark, sf_dir):
    path = f"{p.work_folder(spark)}/sweep"
    write_sweep_csv(_lineitem_errors(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').schema(
        "config_id long, rep int, errors string"
    ).csv(path)
    errors = F.from_json("errors", "array<double>")
    return p.present(back.select(
        "config_id", "rep", F.get(errors, F.lit(0)).alias("first_error"), F.size(errors).alias("n_errors")
    ))


# --- scalar cleaning ------------------------------------------------------------


@query(
    "decode_packed",
    f"""WITH raw AS (
      SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) % 5200 - 500 AS raw
      FROM lineitem)
    SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, raw,
      CASE WHEN raw <> -32768 AND raw BETWEEN -300 AND 4500 THEN {r('raw * 0.01 + 273.15')} END AS value
    FROM raw""",
)
def decode_packed_job(spark, sf_dir):
    raw = p.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.floor("l_extendedprice").cast("long") % 5200 - 500).alias("raw"),
    )
    return p.present(clean.decode_packed(raw, "raw"))


SPARSE = sql.EVENTS_FULL + """,
kept AS (
  SELECT t, cell, CASE WHEN count(*) OVER c - count(value) OVER c <= 0.15 * count(*) OVER c
                       THEN value END AS value
  FROM evf WINDOW c AS (PARTITION BY cell))"""


@query("drop_sparse_cells", panel_sql(SPARSE, "kept"))
def drop_sparse_cells_job(spark, sf_dir):
    return p.present(clean.drop_sparse_cells(p.event_panel_full(spark, sf_dir), n_cells=14).select(*PANEL))


VALID = """
val AS (
  SELECT cell, t, value, row_number() OVER (PARTITION BY cell ORDER BY t) - 1 AS i,
         count(*) OVER (PARTITION BY cell) AS k
  FROM kept WHERE value IS NOT NULL),
rng AS (SELECT cell, min(t) AS t0, max(t) AS t1 FROM kept GROUP BY cell)"""


def _filled_sql(x: str, target: str) -> str:
    return (
        f"WITH RECURSIVE {SPARSE}, {VALID}, "
        f"knots AS (SELECT cell, i, CAST({x} AS DOUBLE) AS x, value AS y FROM val), "
        f"targets AS (SELECT kept.cell, kept.t, {target} AS x FROM kept JOIN "
        "(SELECT DISTINCT cell, k FROM val) n ON n.cell = kept.cell JOIN rng ON rng.cell = kept.cell), "
        f"{sql.natural_spline('knots', 'targets')} "
        "SELECT CAST(kept.t AS BIGINT) AS t, CAST(kept.cell AS BIGINT) AS cell, "
        f"{r('spl.value')} AS value FROM kept LEFT JOIN spl ON spl.cell = kept.cell AND spl.t = kept.t"
    )


@query(
    "fill_gaps_compact",
    _filled_sql("i", "CAST(kept.t - t0 AS DOUBLE) * (CAST(k - 1 AS DOUBLE) / (t1 - t0))"),
)
def fill_gaps_compact_job(spark, sf_dir):
    kept = clean.drop_sparse_cells(p.event_panel_full(spark, sf_dir), n_cells=14)
    return p.present(clean.fill_gaps(kept, "compact").select(*PANEL))


@query("fill_gaps_time", _filled_sql("t", "CAST(kept.t AS DOUBLE)"))
def fill_gaps_time_job(spark, sf_dir):
    kept = clean.drop_sparse_cells(p.event_panel_full(spark, sf_dir), n_cells=14)
    return p.present(clean.fill_gaps(kept, "time", chunk=256).select(*PANEL))


@query(
    "fill_gaps_linear",
    f"""WITH {sql.EVENTS_FULL},
    near AS (
      SELECT t, cell, value,
        max(CASE WHEN value IS NOT NULL THEN t END) OVER (w ROWS UNBOUNDED PRECEDING) AS tp,
        min(CASE WHEN value IS NOT NULL THEN t END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tn
      FROM evf WINDOW w AS (PARTITION BY cell ORDER BY t))
    SELECT CAST(n.t AS BIGINT) AS t, CAST(n.cell AS BIGINT) AS cell, {r('''CASE
        WHEN n.value IS NOT NULL THEN n.value
        WHEN a.value IS NOT NULL AND b.value IS NOT NULL
          THEN a.value + CAST(n.t - tp AS DOUBLE) / (tn - tp) * (b.value - a.value)
        ELSE coalesce(a.value, b.value) END''')} AS value
    FROM near n LEFT JOIN evf a ON a.cell = n.cell AND a.t = n.tp
                LEFT JOIN evf b ON b.cell = n.cell AND b.t = n.tn""",
)
def fill_gaps_linear_job(spark, sf_dir):
    return p.present(
        clean.fill_gaps(p.event_panel_full(spark, sf_dir), "linear", chunk=64).select(*PANEL)
    )


def _mask_sql(passes: int) -> str:
    ctes = sql.EVENT_GRID + """,
    ext AS (SELECT max(lon_idx) AS lon1, max(lat_idx) AS lat1, min(t) AS t0 FROM eg),
    m0 AS (SELECT lon_idx, lat_idx FROM eg, ext WHERE t = t0 AND value IS NULL)"""
    for n in range(1, passes + 1):
        ctes += f""",
    h{n} AS (
      SELECT s.lon_idx, s.lat_idx FROM (SELECT DISTINCT lon_idx, lat_idx FROM eg) s
      JOIN m{n - 1} m ON m.lon_idx BETWEEN s.lon_idx - 1 AND s.lon_idx + 1
                     AND m.lat_idx BETWEEN s.lat_idx - 1 AND s.lat_idx + 1
      JOIN ext ON s.lon_idx BETWEEN 1 AND lon1 - 1 AND s.lat_idx BETWEEN 1 AND lat1 - 1
      GROUP BY 1, 2 HAVING count(*) >= 7),
    m{n} AS (SELECT * FROM m{n - 1} UNION SELECT * FROM h{n})"""
    hits = " UNION ".join(f"SELECT * FROM h{n}" for n in range(1, passes + 1))
    return f"""WITH {ctes}, hit AS ({hits})
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell,
      CASE WHEN hit.lon_idx IS NULL THEN {r('value')} END AS value
    FROM eg LEFT JOIN hit ON hit.lon_idx = eg.lon_idx AND hit.lat_idx = eg.lat_idx"""


@query("mask_isolated", _mask_sql(1))
def mask_isolated_job(spark, sf_dir):
    return p.present(clean.mask_isolated(p.event_grid(spark, sf_dir), n_cells=72).select(*PANEL))


@query("mask_isolated_two_passes", _mask_sql(2))
def mask_isolated_two_job(spark, sf_dir):
    return p.present(clean.mask_isolated(p.event_grid(spark, sf_dir), passes=2, n_cells=72).select(*PANEL))


# Customers on a grid with 30 latitudes: what each bought in a half-year, missing if nothing. The
# state of the SQL is one list over all cells: 0 there, 1 missing, 2 blanked.
BUYERS = """size AS (SELECT count(*) // 30 AS nlon FROM customer),
    bought AS (
      SELECT o_custkey AS cell, (year(o_orderdate) - 1995) * 2 + (month(o_orderdate) - 1) // 6 AS t,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
    bg AS (
      SELECT t, cell, value FROM (SELECT unnest(range(nlon * 30)) AS cell FROM size)
      CROSS JOIN (SELECT unnest(range(4)) AS t) LEFT JOIN bought USING (cell, t)),
    m0 AS (SELECT list(CASE WHEN value IS NULL THEN 1 ELSE 0 END ORDER BY cell) AS m FROM bg WHERE t = 0)"""
_NEAR = " + ".join(f"(m[c + {dx * 30 + dy + 1}] > 0)::INT" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
_INSIDE = "c >= 30 AND c < len(m) - 30 AND c % 30 BETWEEN 1 AND 28"
MASK_SCAN = f"""WITH RECURSIVE {BUYERS}, st AS (
      SELECT CAST(0 AS BIGINT) AS c, m FROM m0
      UNION ALL
      SELECT c + 1, CASE WHEN {_INSIDE} AND {_NEAR} >= 7 THEN list_concat(m[:c], [2], m[c + 2:]) ELSE m END FROM st WHERE c < len(m)),
    fin AS (SELECT m FROM st WHERE c = len(m))"""
MASK_STABLE = f"""WITH RECURSIVE {BUYERS}, st AS (
      SELECT CAST(0 AS BIGINT) AS k, m, CAST([] AS INT[]) AS before FROM m0
      UNION ALL
      SELECT k + 1, list_transform(range(len(m)), lambda c: CASE WHEN {_INSIDE} AND {_NEAR} >= 7 THEN 2 ELSE m[c + 1] END), m
      FROM st WHERE m <> before),
    fin AS (SELECT m FROM st ORDER BY k DESC LIMIT 1)"""
MASKED = f""" SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, CASE WHEN m[cell + 1] <> 2 THEN {r('value')} END AS value
    FROM bg, fin"""


def _buyers(spark, sf_dir):
    n_lon = p.table(spark, sf_dir, "customer").count() // 30
    half = (F.year("o_orderdate") - 1995) * 2 + F.floor((F.month("o_orderdate") - 1) / 6)
    bought = p.table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("cell"), half.cast("long").alias("t")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("t")
    grid = spark.range(n_lon * 30).select(F.col("id").alias("cell"), steps).join(bought, ["cell", "t"], "left")
    return unflatten_cells(grid.withColumns({"series": F.lit("buyers"), "layer": F.lit(0)}), 30)


@query("mask_isolated_scan", MASK_SCAN + MASKED)
def mask_isolated_scan_job(spark, sf_dir):
    """One scan over the grid; a cell blanked early counts for those after it."""
    return p.present(clean.mask_isolated(_buyers(spark, sf_dir), order="scan").select(*PANEL))


@query("mask_isolated_stable", MASK_STABLE + MASKED)
def mask_isolated_stable_job(spark, sf_dir):
    """Snapshots until no further cell changes."""
    return p.present(clean.mask_isolated(_buyers(spark, sf_dir), passes=None).select(*PANEL))


# The embeddings as an 8 x 8 grid with gaps: thirteen cells that miss a third of all steps, and
# one value in thirteen elsewhere. Two present cells between the sparse ones are blanked, the
# second only because the first one is.
HOLES = """((cell // 8 BETWEEN 2 AND 5 AND cell % 8 BETWEEN 2 AND 5 AND cell NOT IN (27, 36, 37) AND t % 3 = 0)
    OR (t * 7 + cell * 3) % 13 = 5)"""
_GRID_NEAR = " + ".join(f"(m[c + {dx * 8 + dy + 1}] > 0)::INT" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
CHAIN = f"""WITH RECURSIVE {sql.EMB},
    gap AS (SELECT t, cell, CASE WHEN NOT {HOLES} THEN value END AS value FROM emb),
    kept AS (
      SELECT t, cell, CASE WHEN count(*) OVER c - count(value) OVER c <= 0.15 * count(*) OVER c THEN value END AS value
      FROM gap WINDOW c AS (PARTITION BY cell)), {VALID},
    knots AS (SELECT cell, i, CAST(i AS DOUBLE) AS x, value AS y FROM val),
    targets AS (
      SELECT kept.cell, kept.t, CAST(kept.t - t0 AS DOUBLE) * (CAST(k - 1 AS DOUBLE) / (t1 - t0)) AS x FROM kept
      JOIN (SELECT DISTINCT cell, k FROM val) n ON n.cell = kept.cell JOIN rng ON rng.cell = kept.cell),
    {sql.natural_spline('knots', 'targets')},
    fil AS (SELECT kept.t, kept.cell, spl.value FROM kept LEFT JOIN spl ON spl.cell = kept.cell AND spl.t = kept.t),
    st AS (
      SELECT CAST(0 AS BIGINT) AS c, (SELECT list(CASE WHEN value IS NULL THEN 1 ELSE 0 END ORDER BY cell) FROM fil WHERE t = 0) AS m
      UNION ALL
      SELECT c + 1, CASE WHEN c // 8 BETWEEN 1 AND 6 AND c % 8 BETWEEN 1 AND 6 AND {_GRID_NEAR} >= 7
                    THEN list_concat(m[:c], [2], m[c + 2:]) ELSE m END FROM st WHERE c < 64),
    msk AS (SELECT t, cell, CASE WHEN m[cell + 1] <> 2 THEN value END AS value FROM fil, (SELECT m FROM st WHERE c = 64)),
    sd AS (SELECT t, cell, coalesce((value - avg(value) OVER c) / stddev_samp(value) OVER c, 0) AS value
           FROM msk WINDOW c AS (PARTITION BY cell))
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('value')} AS value FROM sd"""


@query("cleaned_copies", CHAIN)
def cleaned_copies_job(spark, sf_dir):
    """The whole chain: the first call cleans and keeps a copy, the second one reads it."""
    folder = p.work_folder(spark)
    gaps = p.emb_panel(spark, sf_dir).withColumn(
        "value", F.expr(f"CASE WHEN NOT {HOLES.replace('//', 'DIV')} THEN value END"))
    gaps.write.parquet(f"{folder}/raw")
    for _ in range(2):
        copies = cleaned_copies(spark, {0: f"{folder}/raw"}, {0: 8}, f"{folder}/clean", Cleaning())
    if copies.cleaned:
        raise ValueError("the second call has cleaned again")
    return p.present(finished(copies.panel).select(*PANEL))


STD_EVENTS = sql.EVENTS_FULL + """,
sev AS (
  SELECT t, cell, (value - avg(value) OVER c) / nullif(stddev_samp(value) OVER c, 0) AS value
  FROM evf WINDOW c AS (PARTITION BY cell))"""


@query("fill_missing", panel_sql(STD_EVENTS, "(SELECT t, cell, coalesce(value, 0) AS value FROM sev)"))
def fill_missing_job(spark, sf_dir):
    std = clean.standardise(p.event_panel_full(spark, sf_dir), n_cells=14)
    return p.present(clean.fill_missing(std).select(*PANEL))


@query("standardise", panel_sql(sql.Z, "z"))
def standardise_job(spark, sf_dir):
    return p.present(p.emb_std(spark, sf_dir).select(*PANEL))


@query(
    "standardise_fit_until",
    panel_sql(
        STD_EVENTS.split(",\nsev AS")[0] + """,
        st AS (SELECT cell, avg(value) AS m, stddev_samp(value) AS s FROM evf WHERE t < 240 GROUP BY cell)""",
        "(SELECT t, evf.cell, (value - m) / nullif(s, 0) AS value FROM evf JOIN st ON st.cell = evf.cell)",
    ),
)
def standardise_fit_until_job(spark, sf_dir):
    full = p.event_panel_full(spark, sf_dir)
    return p.present(clean.standardise(full, fit_until=240, n_cells=14).select(*PANEL))


@query("standardise_frames", panel_sql(sql.Z, "z"))
def standardise_frames_job(spark, sf_dir):
    return p.present(from_frames(p.emb_std_frames(spark, sf_dir)).select(*PANEL))


@query("unstandardise", panel_sql(sql.EMB, "emb"))
def unstandardise_job(spark, sf_dir):
    panel = p.emb_panel(spark, sf_dir)
    stats = clean.cell_stats(panel)
    return p.present(clean.unstandardise(clean.standardise(panel, stats=stats, n_cells=64), stats, n_cells=64).select(*PANEL))


@query(
    "refine_time",
    f"""WITH RECURSIVE {sql.Z8},
    knots AS (SELECT cell, CAST(t AS BIGINT) AS i, CAST(t AS DOUBLE) AS x, value AS y FROM z8),
    targets AS (
      SELECT cell, unnest(range(0, (max(t) * 4 + 1)::BIGINT)) AS t,
             unnest(range(0, (max(t) * 4 + 1)::BIGINT)) / CAST(4 AS DOUBLE) AS x FROM z8 GROUP BY cell),
    {sql.natural_spline('knots', 'targets')}
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('value')} AS value FROM spl""",
)
def refine_time_job(spark, sf_dir):
    return p.present(clean.refine_time(p.emb8(spark, sf_dir), 4, chunk=256).select(*PANEL))


@query(
    "flatten_cells",
    f"""WITH {sql.SHIP} SELECT CAST(t AS BIGINT) AS t, CAST(lon_idx * 6 + lat_idx AS BIGINT) AS cell,
        {r('value', 2)} AS value FROM ship""",
)
def flatten_cells_job(spark, sf_dir):
    return p.present(flatten_cells(p.ship_grid(spark, sf_dir), 6).select(*PANEL), 2)


@query(
    "unflatten_cells",
    f"""WITH {sql.EMB} SELECT CAST(t AS BIGINT) AS t, CAST(cell // 8 AS BIGINT) AS lon_idx,
        CAST(cell % 8 AS BIGINT) AS lat_idx, {r('value')} AS value FROM emb""",
)
def unflatten_cells_job(spark, sf_dir):
    grid = unflatten_cells(p.emb_panel(spark, sf_dir), 8)
    return p.present(grid.select("t", "lon_idx", "lat_idx", "value"))


@query(
    "to_frames",
    f"""WITH {sql.Z}
    SELECT CAST(t AS BIGINT) AS t, CAST(len(v) AS BIGINT) AS n_cells, {r('v[1]')} AS first_value,
           {r('v[-1]')} AS last_value
    FROM (SELECT t, list(value ORDER BY cell) AS v FROM z GROUP BY t)""",
)
def to_frames_job(spark, sf_dir):
    frames = to_frames(p.emb_std(spark, sf_dir))
    return p.present(frames.select(
        "t", F.size("values").alias("n_cells"), F.element_at("values", 1).alias("first_value"),
        F.element_at("values", -1).alias("last_value"),
    ))


@query("from_frames", panel_sql(sql.Z, "z"))
def from_frames_job(spark, sf_dir):
    return p.present(from_frames(p.emb_std_frames(spark, sf_dir)).select(*PANEL))


@query(
    "time_slice",
    f"""WITH {sql.EMB}, n AS (SELECT count(*) AS n FROM embeddings),
    w AS (SELECT * FROM (VALUES ('train', 0, 100), ('warmup', 80, 100), ('test', 100, 0)) v(split, lo, back))
    SELECT split, CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('value')} AS value
    FROM emb, n, w
    WHERE (split = 'train' AND t < n - 100) OR (split = 'warmup' AND t >= n - 150 AND t < n - 100)
       OR (split = 'test' AND t >= n - 100)""",
)
def time_slice_job(spark, sf_dir):
    n = p.frame_count(spark, sf_dir)
    windows = {"train": (0, n - 100), "warmup": (n - 150, n - 100), "test": (n - 100, n)}
    sliced = time_slice(p.emb_panel(spark, sf_dir), windows)
    return p.present(sliced.select("split", *PANEL))


@query(
    "select_cells",
    panel_sql(sql.DAILY + """, idx AS (
        SELECT dense_rank() OVER (ORDER BY ts) - 1 AS t, cell, value FROM daily)""",
        "idx", "WHERE cell IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey "
        "WHERE r_name IN ('ASIA', 'EUROPE'))", 2),
)
def select_cells_job(spark, sf_dir):
    nation, region = p.table(spark, sf_dir, "nation"), p.table(spark, sf_dir, "region")
    wanted = nation.join(
        region.filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("cell"))
    stacked = stack_daily(p.daily_orders(spark, sf_dir), "day", F.col("cell"), F.col("value"))
    return p.present(select_cells(stacked, wanted).select(*PANEL), 2)


# --- regridding -----------------------------------------------------------------


@query("regrid_1d", panel_sql(sql.Z8, "z8"))
def regrid_1d_job(spark, sf_dir):
    return p.present(regrid_1d(p.emb_std(spark, sf_dir), 8).select(*PANEL))


@query("regrid_1d_frames", panel_sql(sql.Z8, "z8"))
def regrid_1d_frames_job(spark, sf_dir):
    return p.present(from_frames(p.emb8_frames(spark, sf_dir)).select(*PANEL))


@query(
    "regrid_2d",
    f"""WITH {sql.SHIP}
    SELECT CAST(t AS BIGINT) AS t, CAST(lon_idx // 4 AS BIGINT) AS lon_idx,
      CAST(lat_idx // 2 AS BIGINT) AS lat_idx,
      CASE WHEN count(value) >= 6 THEN {r('avg(value)')} END AS value, count(value) AS n_valid
    FROM ship GROUP BY t, lon_idx // 4, lat_idx // 2""",
)
def regrid_2d_job(spark, sf_dir):
    coarse = regrid_2d(p.ship_grid(spark, sf_dir), 4, 2, min_valid=6)
    return p.present(coarse.select("t", "lon_idx", "lat_idx", "value", "n_valid"))


# --- neighbours in time ----------------------------------------------------------


@query(
    "next_step_target",
    f"""WITH {sql.Z}, nx AS (
      SELECT t, cell, value, lead(value) OVER (PARTITION BY cell ORDER BY t) AS target FROM z)
    SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('value')} AS value,
           {r('target')} AS target FROM nx WHERE target IS NOT NULL""",
)
def next_step_target_job(spark, sf_dir):
    out = next_step_target(p.emb_std(spark, sf_dir))
    return p.present(out.select(*PANEL, "target"))
