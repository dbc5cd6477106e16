"""Catalogue: block maps, links between layers, gathering block inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stforecast.operators import blocks as bl
from stforecast.operators.regrid import cell_count
from stforecast.plans.catalog import panels as p
from stforecast.plans.catalog import sql
from stforecast.plans.catalog.registry import query

r = sql.r

# Customers stand on a ring of cells, or on a grid with 30 latitudes.
RING = "ring AS (SELECT max(c_custkey) + 1 AS n FROM customer)"


def _ring(spark, sf_dir) -> int:
    return cell_count(p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell")))


def _with_balance(spark, sf_dir, block_map):
    """Block map rows with the balance of the customer in the cell."""
    customer = p.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("cell"), F.col("c_acctbal").alias("value")
    )
    return p.present(
        block_map.join(customer, "cell").select("block", "role", "pos", "cell", "value"), 2
    )


def _balance_sql(ctes: str, source: str) -> str:
    return f"""WITH {ctes}
    SELECT CAST(block AS BIGINT) AS block, role, CAST(pos AS BIGINT) AS pos,
           CAST(cell AS BIGINT) AS cell, {r('c_acctbal', 2)} AS value
    FROM {source} JOIN customer ON c_custkey = cell"""


def ring_blocks(n: str, blocks: str, m: int, name: str = "bm") -> str:
    """CTE of a 1-D block map; ``n`` cells and ``blocks`` are SQL scalars."""
    return f"""{name}p AS (SELECT {n} AS n, {blocks} AS nb, {n} // {blocks} AS size),
    {name} AS (
      SELECT block, 'rec' AS role, pos, block * size + pos AS cell
      FROM (SELECT unnest(range(nb)) AS block, size FROM {name}p) b,
           (SELECT unnest(range(size)) AS pos FROM {name}p) o
      UNION ALL
      SELECT block, 'neigh', pos,
        (CASE WHEN pos < {m} THEN block * size - {m} + pos ELSE block * size + size - {m} + pos END + n) % n
      FROM (SELECT unnest(range(nb)) AS block, size, n FROM {name}p) b,
           (SELECT unnest(range({2 * m})) AS pos) o)"""


CUSTOMER_BLOCKS = f"{RING}, " + ring_blocks("(SELECT n FROM ring)", "((SELECT n FROM ring) // 30)", 4)


@query("blocks_1d", _balance_sql(CUSTOMER_BLOCKS, "bm"))
def blocks_1d_job(spark, sf_dir):
    n = _ring(spark, sf_dir)
    return _with_balance(spark, sf_dir, bl.blocks_1d(spark, n, n // 30, 4))


def _linked_sql(mode: str) -> str:
    keep = {
        "exclude": "c NOT BETWEEN (block * 30) // 5 AND (block * 30 + 29) // 5",
        "include": "c BETWEEN (block * 30) // 5 AND (block * 30 + 29) // 5",
    }[mode]
    return _balance_sql(
        CUSTOMER_BLOCKS + f""",
        lk AS (
          SELECT block, 'layer' AS role,
                 row_number() OVER (PARTITION BY block ORDER BY c) - 1 AS pos, c AS cell
          FROM (SELECT block, unnest(range((block // 5) * cs, (block // 5 + 1) * cs)) AS c
                FROM (SELECT unnest(range(nb)) AS block, (n // 5) // (nb // 5) AS cs FROM bmp))
          WHERE {keep}),
        al AS (SELECT * FROM bm UNION ALL SELECT * FROM lk)""",
        "al",
    )


def _linked(spark, sf_dir, mode):
    n = _ring(spark, sf_dir)
    block_map = bl.blocks_1d_linked(spark, n, 5, n // 30, 4, n // 150, mode)
    return _with_balance(spark, sf_dir, block_map)


@query("blocks_1d_linked_exclude", _linked_sql("exclude"))
def blocks_1d_linked_exclude_job(spark, sf_dir):
    return _linked(spark, sf_dir, "exclude")


@query("blocks_1d_linked_include", _linked_sql("include"))
def blocks_1d_linked_include_job(spark, sf_dir):
    return _linked(spark, sf_dir, "include")


def grid_blocks(name: str, n_lon: str, n_lat: int, div_lon: str, div_lat: int, m: int, clamp: bool = False) -> str:
    """CTE of a 2-D block map by brute force: distinct stencil cells minus the own ones."""
    lat = (
        f"greatest(0, least({n_lat - 1}, y + dy))" if clamp else f"(y + dy + {n_lat} * 4) % {n_lat}"
    )
    return f"""{name}p AS (SELECT {n_lon} AS nlon, {n_lon} // {div_lon} AS w, {n_lat // div_lat} AS h),
    {name}c AS (
      SELECT x, y, x * {n_lat} + y AS cell, (x // w) * {div_lat} + y // h AS block, nlon
      FROM (SELECT unnest(range(nlon)) AS x, w, h, nlon FROM {name}p), (SELECT unnest(range({n_lat})) AS y)),
    {name}s AS (
      SELECT DISTINCT block, ((x + dx + nlon * 4) % nlon) * {n_lat} + {lat} AS cell
      FROM {name}c, (SELECT unnest(range(-{m}, {m + 1})) AS dx), (SELECT unnest(range(-{m}, {m + 1})) AS dy)),
    {name} AS (
      SELECT block, 'rec' AS role, row_number() OVER (PARTITION BY block ORDER BY cell) - 1 AS pos, cell
      FROM {name}c
      UNION ALL
      SELECT s.block, 'neigh', row_number() OVER (PARTITION BY s.block ORDER BY s.cell) - 1, s.cell
      FROM {name}s s LEFT JOIN {name}c c ON c.block = s.block AND c.cell = s.cell WHERE c.cell IS NULL)"""


LON = "((SELECT n FROM ring) // 30)"


def _grid_sql(clamp: bool) -> str:
    return _balance_sql(
        f"{RING}, " + grid_blocks("g", LON, 30, f"({LON} // 5)", 5, 2, clamp), "g"
    )


@query("blocks_2d", _grid_sql(False))
def blocks_2d_job(spark, sf_dir):
    n_lon = _ring(spark, sf_dir) // 30
    return _with_balance(spark, sf_dir, bl.blocks_2d(spark, n_lon, 30, n_lon // 5, 5, 2))


@query("blocks_2d_clamped", _grid_sql(True))
def blocks_2d_clamped_job(spark, sf_dir):
    n_lon = _ring(spark, sf_dir) // 30
    return _with_balance(
        spark, sf_dir, bl.blocks_2d(spark, n_lon, 30, n_lon // 5, 5, 2, lat_mode="clamp")
    )


TWO_GRIDS = (
    f"{RING}, " + grid_blocks("gc", f"({LON} // 5)", 6, f"greatest(1, {LON} // 10)", 2, 1) + ", "
    + grid_blocks("gf", LON, 30, f"({LON} // 5)", 6, 1) + """,
    up AS (
      SELECT f.block, c.block AS parent
      FROM (SELECT block, min(x) AS x, min(y) AS y FROM gfc GROUP BY block) f
      JOIN gcc c ON c.x = f.x // 5 AND c.y = f.y // 5),
    lk AS (
      SELECT up.block, 'layer' AS role, g.pos, g.cell FROM up
      JOIN gc g ON g.block = up.parent AND g.role = 'rec')"""
)


def _two_grids(spark, sf_dir):
    n_lon = _ring(spark, sf_dir) // 30
    return [(n_lon // 5, 6, max(1, n_lon // 10), 2), (n_lon, 30, n_lon // 5, 6)]


@query(
    "link_layers_2d",
    _balance_sql(TWO_GRIDS + ", al AS (SELECT * FROM gf UNION ALL SELECT * FROM lk)", "al"),
)
def link_layers_2d_job(spark, sf_dir):
    coarse, fine = _two_grids(spark, sf_dir)
    coarse_map = bl.blocks_2d(spark, *coarse, mixing=1)
    fine_map = bl.blocks_2d(spark, *fine, mixing=1, layer=1)
    linked = bl.link_layers_2d(fine_map, coarse_map, *fine[:2], *coarse[:2])
    return _with_balance(spark, sf_dir, linked)


@query(
    "blocks_2d_linked",
    f"""WITH {TWO_GRIDS}, al AS (
      SELECT 0 AS layer, * FROM gc UNION ALL SELECT 1, * FROM gf UNION ALL SELECT 1, * FROM lk)
    SELECT CAST(layer AS BIGINT) AS layer, CAST(block AS BIGINT) AS block, role,
           count(*) AS n, {r('sum(CAST(c_acctbal AS DECIMAL(18, 2)))', 2)} AS total
    FROM al JOIN customer ON c_custkey = cell GROUP BY layer, block, role""",
)
def blocks_2d_linked_job(spark, sf_dir):
    block_map = bl.blocks_2d_linked(spark, _two_grids(spark, sf_dir), 1)
    customer = p.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("cell"), "c_acctbal"
    )
    return p.present(
        block_map.join(customer, "cell").groupBy("layer", "block", "role").agg(
            F.count("*").alias("n"),
            F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"),
        ), 2,
    )


@query(
    "input_dimensions",
    f"""WITH {TWO_GRIDS}, al AS (
      SELECT 0 AS layer, * FROM gc UNION ALL SELECT 1, * FROM gf UNION ALL SELECT 1, * FROM lk),
    n AS (
      SELECT layer, block, count(*) FILTER (role = 'rec') AS a, count(*) FILTER (role = 'neigh') AS b,
             count(*) FILTER (role = 'layer') AS c FROM al GROUP BY layer, block)
    SELECT CAST(layer AS BIGINT) AS layer, min(a) AS d_rec, min(b) AS d_neigh, min(c) AS d_layer,
           count(*) AS n_blocks, min(a) = max(a) AND min(b) = max(b) AND min(c) = max(c) AS consistent
    FROM n GROUP BY layer""",
)
def input_dimensions_job(spark, sf_dir):
    return p.present(bl.input_dimensions(bl.blocks_2d_linked(spark, _two_grids(spark, sf_dir), 1)))


# --- gathering -------------------------------------------------------------------

EMB_BLOCKS = ring_blocks("64", "8", 2) + """,
    lk AS (
      SELECT block, 'layer' AS role, 0 AS pos, CASE WHEN block % 2 = 0 THEN block + 1 ELSE block - 1 END AS cell
      FROM (SELECT unnest(range(8)) AS block)),
    bml AS (SELECT * FROM bm UNION ALL SELECT * FROM lk)"""

GATHERED = f"""WITH {sql.Z8}, {EMB_BLOCKS}
    SELECT CAST(t AS BIGINT) AS t, CAST(block AS BIGINT) AS block, role, CAST(pos AS BIGINT) AS pos,
           {r('value')} AS value
    FROM (SELECT z.t, b.block, b.role, b.pos, z.value FROM bm b JOIN z ON z.cell = b.cell
          UNION ALL
          SELECT z8.t, b.block, b.role, b.pos, z8.value FROM lk b JOIN z8 ON z8.cell = b.cell)"""


def emb_map(spark):
    """Eight blocks on the 64 embedding cells, linked to the eight coarse cells."""
    return bl.blocks_1d_linked(spark, 64, 8, 8, 2, 4, "exclude", layer=0)


def _long_inputs(inputs):
    parts = None
    for role in bl.ROLES:
        part = inputs.select(
            "t", "block", F.lit(role).alias("role"), F.posexplode(f"u_{role}").alias("pos", "value")
        )
        parts = part if parts is None else parts.unionByName(part)
    return p.present(parts)


@query("gather_inputs", GATHERED)
def gather_inputs_job(spark, sf_dir):
    inputs = bl.gather_inputs(
        p.emb_std_frames(spark, sf_dir), emb_map(spark), p.emb8_frames(spark, sf_dir), map_rows=8 * 13
    )
    return _long_inputs(inputs)


@query("gather_inputs_panel", GATHERED)
def gather_inputs_panel_job(spark, sf_dir):
    inputs = bl.gather_inputs_panel(
        p.emb_std(spark, sf_dir), emb_map(spark), p.emb8(spark, sf_dir), map_rows=8 * 13
    )
    return _long_inputs(inputs)


@query(
    "merge_block_outputs",
    f"""WITH {sql.Z} SELECT CAST(t AS BIGINT) AS t, CAST(cell AS BIGINT) AS cell, {r('2 * value')} AS yhat
        FROM z""",
)
def merge_block_outputs_job(spark, sf_dir):
    block_map = bl.blocks_1d(spark, 64, 8, 2)
    inputs = bl.gather_inputs(p.emb_std_frames(spark, sf_dir), block_map, map_rows=8 * 12)
    doubled = inputs.select("layer", "block", "t", F.transform("u_rec", lambda v: 2.0 * v).alias("yhat"))
    return p.present(bl.merge_block_outputs(doubled, block_map, map_rows=96).select("t", "cell", "yhat"))
