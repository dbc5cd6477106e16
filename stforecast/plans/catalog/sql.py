"""SQL text shared by the oracle queries."""

from __future__ import annotations

PRIME = "CAST(2147483647 AS BIGINT)"
KEY_FACTORS = (7919, 104729, 1299709, 15485863, 32452843, 49979687)


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def seeded_int(*parts) -> str:
    terms = " + ".join(
        f"(CAST({p} AS BIGINT) % {PRIME}) * CAST({k} AS BIGINT)"
        for k, p in zip(KEY_FACTORS, parts, strict=False)
    )
    x = f"((CAST(12345 AS BIGINT) + {terms}) % {PRIME})"
    for shift in (48271, 69621):
        x = f"(({x} * {x} + {x} * CAST({shift} AS BIGINT) + 11) % {PRIME})"
    return x


def seeded_uniform(*parts) -> str:
    return f"((CAST({seeded_int(*parts)} AS DOUBLE) + 0.5) / CAST(2147483647 AS DOUBLE))"


def seeded_normal(*parts) -> str:
    return (
        f"(sqrt(-2.0 * ln({seeded_uniform(*parts, 1)})) "
        f"* cos(2.0 * pi() * {seeded_uniform(*parts, 2)}))"
    )


# --- panels -----------------------------------------------------------------------

EMB = """emb AS (
  SELECT vec_id AS t, unnest(range(0, len(embedding))) AS cell,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""

# standardised embeddings panel
Z = EMB + """,
z AS (
  SELECT t, cell, (value - avg(value) OVER c) / stddev_samp(value) OVER c AS value
  FROM emb WINDOW c AS (PARTITION BY cell))"""

# eight coarse cells of the standardised panel
Z8 = Z + """,
z8 AS (SELECT t, cell // 8 AS cell, avg(value) AS value FROM z GROUP BY t, cell // 8)"""

# events: two-hour buckets; errors, clicks and views on cells 0-7, the rest on 8-13
EVENTS = """ev AS (
  SELECT CAST(floor((epoch(ts) - 1704067200) / 7200) AS BIGINT) AS t,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 8 + user_id % 6 ELSE user_id % 8 END AS cell,
         avg(value) AS value
  FROM events GROUP BY 1, 2)"""

EVENTS_FULL = EVENTS + """,
span AS (SELECT min(t) AS t0, max(t) AS t1 FROM ev),
evf AS (
  SELECT g.t, g.cell, ev.value
  FROM (SELECT cell, unnest(range((SELECT t0 FROM span), (SELECT t1 FROM span) + 1)) AS t
        FROM (SELECT DISTINCT cell FROM ev)) g
  LEFT JOIN ev ON ev.t = g.t AND ev.cell = g.cell)"""

# events on a 12 x 6 grid, complete over all buckets and cells
EVENT_GRID = """eg0 AS (
  SELECT CAST(floor((epoch(ts) - 1704067200) / 7200) AS BIGINT) AS t,
         (user_id % 12) * 6 + (user_id // 12) % 6 AS cell, avg(value) AS value
  FROM events GROUP BY 1, 2),
egs AS (SELECT min(t) AS t0, max(t) AS t1 FROM eg0),
eg AS (
  SELECT g.t, g.cell, g.cell // 6 AS lon_idx, g.cell % 6 AS lat_idx, eg0.value
  FROM (SELECT cell, unnest(range((SELECT t0 FROM egs), (SELECT t1 FROM egs) + 1)) AS t
        FROM (SELECT DISTINCT cell FROM eg0)) g
  LEFT JOIN eg0 ON eg0.t = g.t AND eg0.cell = g.cell)"""

# lineitem: ship month on a 12 x 6 grid of (supplier, part)
SHIP = """ship AS (
  SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t,
         l_suppkey % 12 AS lon_idx, l_partkey % 6 AS lat_idx,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2, 3)"""

# orders: one field per order date over the customers' nations
DAILY = """daily AS (
  SELECT o_orderdate AS ts, c_nationkey AS cell,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def natural_spline(knots: str, targets: str) -> str:
    """CTEs ending in ``spl(cell, t, value)``; needs WITH RECURSIVE.

    ``knots`` is a CTE (cell, i, x, y) with i from 0, ``targets`` a CTE (cell, t, x).
    """
    return f"""
kn AS (
  SELECT cell, i, x, y,
         x - lag(x) OVER w AS hl, lead(x) OVER w - x AS hr,
         (y - lag(y) OVER w) / (x - lag(x) OVER w) AS sl,
         (lead(y) OVER w - y) / (lead(x) OVER w - x) AS sr
  FROM {knots} WINDOW w AS (PARTITION BY cell ORDER BY i)),
fw AS (
  SELECT cell, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d FROM kn WHERE i = 0
  UNION ALL
  SELECT kn.cell, CAST(kn.i AS BIGINT),
         kn.hr / (2 * (kn.hl + kn.hr) - kn.hl * fw.c),
         (6 * (kn.sr - kn.sl) - kn.hl * fw.d) / (2 * (kn.hl + kn.hr) - kn.hl * fw.c)
  FROM fw JOIN kn ON kn.cell = fw.cell AND kn.i = fw.i + 1 WHERE kn.hr IS NOT NULL),
bw AS (
  SELECT cell, CAST(i AS BIGINT) AS i, CAST(0 AS DOUBLE) AS m FROM kn WHERE hr IS NULL
  UNION ALL
  SELECT fw.cell, fw.i, CASE WHEN fw.i = 0 THEN 0 ELSE fw.d - fw.c * bw.m END
  FROM bw JOIN fw ON fw.cell = bw.cell AND fw.i = bw.i - 1),
cur AS (
  SELECT kn.cell, kn.i, kn.x, kn.y, kn.hr, kn.sr, kn.sl, kn.hl, bw.m,
         lead(kn.y) OVER w AS y1, lead(bw.m) OVER w AS m1, lag(bw.m) OVER w AS m0
  FROM kn JOIN bw ON bw.cell = kn.cell AND bw.i = kn.i
  WINDOW w AS (PARTITION BY kn.cell ORDER BY kn.i)),
lo AS (SELECT cell, x, y, sr, hr, m, m1 FROM cur WHERE i = 0),
hit AS (
  SELECT q.cell, q.t, q.x AS at, cur.* EXCLUDE (cell)
  FROM {targets} q ASOF LEFT JOIN cur ON q.cell = cur.cell AND q.x >= cur.x),
spl AS (
  SELECT hit.cell, hit.t,
    CASE
      WHEN hit.x IS NULL THEN
        lo.y + (hit.at - lo.x) * COALESCE(lo.sr - lo.hr * (2 * lo.m + lo.m1) / 6, 0)
      WHEN hit.hr IS NULL THEN
        hit.y + (hit.at - hit.x) * COALESCE(hit.sl + hit.hl * (hit.m0 + 2 * hit.m) / 6, 0)
      ELSE
        (1 - (hit.at - hit.x) / hit.hr) * hit.y + ((hit.at - hit.x) / hit.hr) * hit.y1
        + ((power(1 - (hit.at - hit.x) / hit.hr, 3) - (1 - (hit.at - hit.x) / hit.hr)) * hit.m
           + (power((hit.at - hit.x) / hit.hr, 3) - (hit.at - hit.x) / hit.hr) * hit.m1)
          * hit.hr * hit.hr / 6
    END AS value
  FROM hit JOIN lo ON lo.cell = hit.cell)"""


def solve(name: str, augmented: str, n: int | str) -> str:
    """CTEs ending in ``name(key, m)``: rows of [A | B] reduced to [I | A^-1 B].

    ``augmented`` is a CTE (key, i, r) with i from 1 and r the row as a list. Pivots stay
    on the diagonal, which is safe for a Gram matrix plus a positive ridge.
    """
    return f"""
{name}_0 AS (SELECT key, list(r ORDER BY i) AS m FROM {augmented} GROUP BY key),
{name}_s AS (
  SELECT key, CAST(0 AS BIGINT) AS k, m FROM {name}_0
  UNION ALL
  SELECT key, k + 1, list_transform(m, lambda row, i:
    CASE WHEN i = k + 1 THEN list_transform(row, lambda p: p / m[k + 1][k + 1])
    ELSE list_transform(row, lambda p, c: p - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END)
  FROM {name}_s WHERE k < {n}),
{name} AS (SELECT key, m FROM {name}_s WHERE k = {n})"""
