"""SQL text of whole models: state recursion, ridge fit, free run (recursive CTEs)."""

from __future__ import annotations

from dataclasses import dataclass

from stforecast.plans.catalog import sql
from stforecast.plans.catalog.structure import grid_blocks, ring_blocks

LAST = 20  # the test span: the last steps of the embeddings
SPAN = f"pr AS (SELECT count(*) AS n, count(*) - {LAST} AS stop FROM embeddings)"


@dataclass
class Reservoir:
    """A block model of one layer; CTE names start with ``p``."""

    p: str
    panel: str  # CTE (t, cell, value)
    cells: int
    blocks: int
    mixing: int
    n: int
    seed: int
    layer: int = 0
    gains: tuple[float, float, float] = (0.5, 0.4, 0.3)
    damp: float = 0.3
    leak: float = 0.5
    ridge: float = 0.1
    washout: int = 30
    quadratic: bool = True
    coarse: str | None = None  # CTE (t, cell, value) of the layer above
    n_layer: int = 0
    linked: str = ""  # SELECT block, pos, cell of the layer inputs
    ahead: str | None = None  # CTE (origin, t, cell, value): the layer above from each origin on
    structured: bool = True  # inputs feed units of their own, or all units

    @property
    def size(self) -> int:
        return self.cells // self.blocks

    @property
    def halo(self) -> int:
        return 2 * self.mixing

    @property
    def d(self) -> int:
        return self.size + self.halo + self.n_layer

    def net(self) -> str:
        p, n, d, q = self.p, self.n, self.d, self.n // self.d
        a, b = self.size, self.size + self.halo
        own = f"i // {q} = c AND i < {q * d}" if self.structured else "true"
        gain = f"CASE WHEN c < {a} THEN {self.gains[0]} WHEN c < {b} THEN {self.gains[1]} ELSE {self.gains[2]} END"
        return f"""
        {p}wr AS (
          SELECT i, list(w ORDER BY j) AS row FROM (
            SELECT i, j, CASE WHEN {sql.seeded_uniform(self.seed, self.layer, 12, 'i', 'j')} < 0.5
              THEN {self.damp} * {sql.seeded_normal(self.seed, self.layer, 13, 'i', 'j')} ELSE 0 END AS w
            FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n})) AS j)) GROUP BY i),
        {p}wi AS (
          SELECT i, list(w ORDER BY c) AS row FROM (
            SELECT i, c, CASE WHEN {own}
              THEN {gain} * (2 * {sql.seeded_uniform(self.seed, self.layer, 11, 'i', 'c')} - 1) ELSE 0 END AS w
            FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({d})) AS c)) GROUP BY i),
        {p}nt AS (
          SELECT (SELECT list(CAST(row AS DOUBLE[]) ORDER BY i) FROM {p}wr) AS wm,
                 (SELECT list(CAST(row AS DOUBLE[]) ORDER BY i) FROM {p}wi) AS wn)"""

    def block_cells(self) -> str:
        """CTE ``{p}b(block, role, pos, cell)``."""
        return ring_blocks(str(self.cells), str(self.blocks), self.mixing, self.p + "b")

    def inputs(self) -> str:
        p = self.p
        links = f"UNION ALL SELECT block, 'layer', pos, cell FROM ({self.linked})" if self.linked else ""
        upper = (
            f"UNION ALL SELECT b.block, c.t, 2, b.pos, c.value FROM {p}bm b JOIN {self.coarse} c "
            "ON c.cell = b.cell WHERE b.role = 'layer'" if self.coarse else ""
        )
        return f"""
        {self.block_cells()},
        {p}bm AS (SELECT block, role, pos, cell FROM {p}b {links}),
        {p}in AS (
          SELECT block, t, list(value ORDER BY ro, pos) AS u, list(value ORDER BY pos) FILTER (ro = 0) AS y
          FROM (
            SELECT b.block, z.t, CASE WHEN b.role = 'rec' THEN 0 ELSE 1 END AS ro, b.pos, z.value
            FROM {p}bm b JOIN {self.panel} z ON z.cell = b.cell WHERE b.role <> 'layer'
            {upper})
          GROUP BY block, t)"""

    def _cell_step(self, x: str, u: str, net: str) -> str:
        return (
            f"list_transform(range(1, {self.n + 1}), lambda k: {1 - self.leak} * {x}[k] + {self.leak} * "
            f"tanh(list_dot_product({net}.wm[k], {x}) + list_dot_product({net}.wn[k], {u})))"
        )

    def features(self, x: str) -> str:
        if not self.quadratic:
            return x
        return f"list_transform({x}, lambda e, j: CASE WHEN j % 2 = 0 THEN e * e ELSE e END)"

    def states(self) -> str:
        """``{p}st(block, t, x)`` over all steps."""
        p = self.p
        zero = f"CAST(list_transform(range({self.n}), lambda e: 0.0) AS DOUBLE[])"
        return f"""
        {p}st AS (
          SELECT block, CAST(0 AS BIGINT) AS t, {zero} AS x FROM (SELECT unnest(range({self.blocks})) AS block)
          UNION ALL
          SELECT s.block, s.t + 1, {self._cell_step('s.x', 'i.u', 'nt')}
          FROM {p}st s JOIN {p}in i ON i.block = s.block AND i.t = s.t AND len(i.u) = {self.d},
               {p}nt nt, pr WHERE s.t + 1 < pr.n)"""

    def fit(self, until: str = "stop") -> str:
        """``{p}g(key, m)``: solved readout of every block; ``{p}wo(w)``: w[block][out][unit]."""
        p, n, d = self.p, self.n, self.size
        return f"""
        {p}fe AS (SELECT block, t, {self.features('x')} AS z FROM {p}st),
        {p}zz AS (SELECT block, t, unnest(range(1, {n + 1})) AS i, unnest(z) AS v
                  FROM {p}fe, pr WHERE t >= {self.washout} AND t < {until}),
        {p}yy AS (SELECT block, t, unnest(range({n + 1}, {n + d + 1})) AS i, unnest(y) AS v FROM {p}in),
        {p}au AS (
          SELECT block AS key, i, list(v ORDER BY j) AS r FROM (
            SELECT a.block, a.i, b.i AS j,
                   sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {self.ridge} ELSE 0 END AS v
            FROM {p}zz a JOIN {p}zz b ON b.block = a.block AND b.t = a.t GROUP BY 1, 2, 3
            UNION ALL
            SELECT a.block, a.i, y.i, sum(a.v * y.v)
            FROM {p}zz a JOIN {p}yy y ON y.block = a.block AND y.t = a.t GROUP BY 1, 2, 3)
          GROUP BY block, i),
        {sql.solve(p + 'g', p + 'au', n)},
        {p}wo AS (
          SELECT list(list_transform(range(1, {d + 1}), lambda o:
            list_transform(range(1, {n + 1}), lambda i: m[i][{n} + o])) ORDER BY key) AS w FROM {p}g)"""

    def fitted(self) -> str:
        """``{p}ft(t, cell, value)``: one-step outputs for every step."""
        p, d = self.p, self.size
        return f"""
        {p}ft AS (
          SELECT t, block * {d} + o - 1 AS cell, list_dot_product(w[block + 1][o], z) AS value
          FROM {p}fe, {p}wo, (SELECT unnest(range(1, {d + 1})) AS o))"""

    def after_last(self) -> str:
        """``{p}nx(t, cell, value)``: the output for the step after the last."""
        p, d = self.p, self.size
        return f"""
        {p}ls AS (
          SELECT s.block, s.t + 1 AS t, {self._cell_step('s.x', 'i.u', 'nt')} AS x
          FROM {p}st s JOIN {p}in i ON i.block = s.block AND i.t = s.t, {p}nt nt, pr WHERE s.t = pr.n - 1),
        {p}nx AS (
          SELECT t, block * {d} + o - 1 AS cell, list_dot_product(w[block + 1][o], {self.features('x')}) AS value
          FROM {p}ls, {p}wo, (SELECT unnest(range(1, {d + 1})) AS o))"""

    def by_cell(self, flat: str) -> str:
        """Values listed block by block, as a list over the cells."""
        return flat

    def rollout(self, origins: str, warmup: int, steps: int) -> str:
        """``{p}fc(origin, t, cell, value)``; ``origins`` is a SELECT of ``origin``."""
        p, n, d, b = self.p, self.n, self.size, self.blocks
        upper = f"JOIN {p}cf cf ON cf.t = ro.t" if self.coarse else ""
        if self.ahead:
            upper += " AND cf.origin = ro.origin"
        step = self._cell_step("xs[b]", "list_transform(ix.ix[b], lambda c: v[c + 1])", "nt")
        out = (
            f"flatten(list_transform(range(1, {b + 1}), lambda b: list_transform(range(1, {d + 1}), "
            f"lambda o: list_dot_product(wo.w[b][o], {self.features('xs2[b]')}))))"
        )
        coarse = (
            f"{p}cf AS (SELECT t, list(value ORDER BY cell) AS v FROM {self.coarse} GROUP BY t)," if self.coarse else ""
        )
        if self.ahead:
            coarse = f"""{p}cf AS (
              SELECT origin, t, list(value ORDER BY cell) AS v FROM (
                SELECT q.origin, c.t, cell, value FROM {self.coarse} c JOIN ({origins}) q
                  ON c.t >= q.origin - {warmup} AND c.t < q.origin
                UNION ALL SELECT origin, t, cell, value FROM {self.ahead} WHERE t >= origin)
              GROUP BY origin, t),"""
        out = self.by_cell(out)
        now = "CASE WHEN ro.t < ro.origin THEN fr.v ELSE ro.y END"
        if self.coarse:
            now = f"list_concat({now}, cf.v)"
        return f"""
        {p}fr AS (SELECT t, list(value ORDER BY cell) AS v FROM {self.panel} GROUP BY t), {coarse}
        {p}ix AS (
          SELECT list(ix ORDER BY block) AS ix FROM (
            SELECT block, list(CASE WHEN role = 'layer' THEN {self.cells} + cell ELSE cell END
                               ORDER BY CASE role WHEN 'rec' THEN 0 WHEN 'neigh' THEN 1 ELSE 2 END, pos) AS ix
            FROM {p}bm GROUP BY block)),
        {p}ro AS (
          SELECT CAST(origin AS BIGINT) AS origin, CAST(origin - {warmup} AS BIGINT) AS t,
            CAST(list_transform(range({b}), lambda e: list_transform(range({n}), lambda f: 0.0)) AS DOUBLE[][]) AS xs,
            CAST(list_transform(range({self.cells}), lambda e: 0.0) AS DOUBLE[]) AS y
          FROM ({origins})
          UNION ALL
          SELECT origin, t + 1, xs2, {out}
          FROM (
            SELECT q.origin, q.t, list_transform(range(1, {b + 1}), lambda b: {step}) AS xs2
            FROM (SELECT ro.origin, ro.t, ro.xs, {now} AS v
                  FROM {p}ro ro LEFT JOIN {p}fr fr ON fr.t = ro.t {upper}
                  WHERE ro.t < ro.origin + {steps} - 1) q, {p}nt nt, {p}ix ix) s, {p}wo wo),
        {p}fc AS (
          SELECT origin, t, unnest(range({self.cells})) AS cell, unnest(y) AS value FROM {p}ro)"""


@dataclass
class GridReservoir(Reservoir):
    """Blocks on a grid: cells of a block do not follow each other."""

    grid: tuple[int, int, int, int] = (1, 1, 1, 1)  # longitudes, latitudes, parts of either
    n_neigh: int = 0

    @property
    def halo(self) -> int:
        return self.n_neigh

    def block_cells(self) -> str:
        n_lon, n_lat, div_lon, div_lat = self.grid
        return grid_blocks(self.p + "b", str(n_lon), n_lat, str(div_lon), div_lat, self.mixing)

    def fitted(self) -> str:
        p = self.p
        return f"""
        {p}ft AS (
          SELECT t, m.cell, list_dot_product(w[f.block + 1][m.pos + 1], z) AS value
          FROM {p}fe f JOIN {p}b m ON m.block = f.block AND m.role = 'rec', {p}wo)"""

    def by_cell(self, flat: str) -> str:
        place = f"SELECT list(block * {self.size} + pos + 1 ORDER BY cell) FROM {self.p}b WHERE role = 'rec'"
        return f"list_select({flat}, ({place}))"


def deep_states(nr: int, nu: int, seed: int, panel: str, p: str = "d", scale: float = 0.5) -> str:
    """``{p}st(t, x1, x2)``: two-level states after step t; nets as in the deep query."""
    q = nr // nu

    def recurrent(level: int) -> str:
        return f"""SELECT list(row ORDER BY i) FROM (SELECT i, CAST(list(w ORDER BY j) AS DOUBLE[]) AS row FROM (
          SELECT i, j, CASE WHEN {sql.seeded_uniform(seed, level, 12, 'i', 'j')} < 0.4
            THEN 0.3 * {sql.seeded_normal(seed, level, 13, 'i', 'j')} ELSE 0 END AS w
          FROM (SELECT unnest(range({nr})) AS i), (SELECT unnest(range({nr})) AS j)) GROUP BY i)"""

    return f"""
    {p}n AS (SELECT
      ({recurrent(0)}) AS w1, ({recurrent(1)}) AS w2,
      (SELECT list(row ORDER BY i) FROM (SELECT i, CAST(list(w ORDER BY c) AS DOUBLE[]) AS row FROM (
         SELECT i, c, CASE WHEN i // {q} = c THEN {scale} * (2 * {sql.seeded_uniform(seed, 0, 11, 'i', 'c')} - 1)
                      ELSE 0 END AS w
         FROM (SELECT unnest(range({nr})) AS i), (SELECT unnest(range({nu})) AS c)) GROUP BY i)) AS v1,
      (SELECT list(row ORDER BY i) FROM (SELECT i, CAST(list(w ORDER BY j) AS DOUBLE[]) AS row FROM (
         SELECT i, j, 0.25 * (2 * {sql.seeded_uniform(seed, 1, 14, 'i', 'j')} - 1) AS w
         FROM (SELECT unnest(range({nr})) AS i), (SELECT unnest(range({nr})) AS j)) GROUP BY i)) AS v2),
    {p}fr AS (SELECT t, list(value ORDER BY cell) AS u FROM {panel} GROUP BY t),
    {p}st AS (
      SELECT CAST(-1 AS BIGINT) AS t, {zeros(nr)} AS x1, {zeros(nr)} AS x2
      UNION ALL
      SELECT t + 1, y1, {deep_step(nr, 1, 'x2', 'y1')}
      FROM (SELECT s.t, s.x2, {deep_step(nr, 0, 's.x1', 'f.u')} AS y1, {p}n.*
            FROM {p}st s JOIN {p}fr f ON f.t = s.t + 1, {p}n))"""


def zeros(n: int) -> str:
    return f"CAST(list_transform(range({n}), lambda e: 0.0) AS DOUBLE[])"


DEEP_LEAKS = (1.0, 0.8)


def deep_step(nr: int, level: int, x: str, u: str) -> str:
    a = DEEP_LEAKS[level]
    return (
        f"list_transform(range(1, {nr + 1}), lambda k: {round(1 - a, 6)} * {x}[k] + {a} * "
        f"tanh(list_dot_product(w{level + 1}[k], {x}) + list_dot_product(v{level + 1}[k], {u})))"
    )


def squared(x: str) -> str:
    return f"list_transform({x}, lambda e, j: CASE WHEN j % 2 = 0 THEN e * e ELSE e END)"


def ridge_fit(name: str, features: str, targets: str, n: int, d: int, ridge: float) -> str:
    """``{name}(key, m)`` and ``{name}w(w)`` from CTEs (t, z list) and (t, y list), one key."""
    return f"""
    {name}z AS (SELECT t, unnest(range(1, {n + 1})) AS i, unnest(z) AS v FROM {features}),
    {name}y AS (SELECT t, unnest(range({n + 1}, {n + d + 1})) AS i, unnest(y) AS v FROM {targets}),
    {name}a AS (
      SELECT 0 AS key, i, list(v ORDER BY j) AS r FROM (
        SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {ridge} ELSE 0 END AS v
        FROM {name}z a JOIN {name}z b ON b.t = a.t GROUP BY 1, 2
        UNION ALL
        SELECT a.i, y.i, sum(a.v * y.v) FROM {name}z a JOIN {name}y y ON y.t = a.t GROUP BY 1, 2)
      GROUP BY i),
    {sql.solve(name, name + 'a', n)},
    {name}w AS (
      SELECT list_transform(range(1, {d + 1}), lambda o:
        list_transform(range(1, {n + 1}), lambda i: m[i][{n} + o])) AS w FROM {name})"""


@dataclass
class RunsReservoir(Reservoir):
    """Nets of several seeds on every series of ``panel`` (series, t, v), refitted for each window.

    ``run`` is series * nets + net; ``windows`` is a SELECT of series, origin, first, last.
    """

    nets: int = 2
    windows: str = ""

    def runs(self, warmup: int, steps: int) -> str:
        """``{p}fc(run, origin, t, cell, value)``."""
        p, n, d, b, k = self.p, self.n, self.size, self.blocks, self.nets
        parts = [Reservoir(f"{p}{j}", "", self.cells, b, self.mixing, n, seed=j, gains=self.gains).net() for j in range(k)]
        every = " UNION ALL ".join(f"SELECT {j} AS net, wm, wn FROM {p}{j}nt" for j in range(k))
        out = (
            f"flatten(list_transform(range(1, {b + 1}), lambda b: list_transform(range(1, {d + 1}), "
            f"lambda o: list_dot_product(w[b][o], {self.features('xs2[b]')}))))"
        )
        step = self._cell_step("xs[b]", "list_transform(ix[b], lambda c: v[c + 1])", "q")
        return f"""
        {', '.join(parts)}, {p}ns AS ({every}),
        {ring_blocks(str(self.cells), str(b), self.mixing, p + 'b')},
        {p}ix AS (SELECT block, list(cell ORDER BY CASE role WHEN 'rec' THEN 0 ELSE 1 END, pos) AS ix FROM {p}b GROUP BY block),
        {p}in AS (SELECT series, block, t, list_transform(ix, lambda c: v[c + 1]) AS u FROM {self.panel}, {p}ix),
        {p}st AS (
          SELECT series, net, block, CAST(0 AS BIGINT) AS t, {zeros(n)} AS x
          FROM (SELECT DISTINCT series FROM {self.panel}), {p}ns, (SELECT unnest(range({b})) AS block)
          UNION ALL
          SELECT s.series, s.net, s.block, s.t + 1, {self._cell_step('s.x', 'i.u', 'q')}
          FROM {p}st s JOIN {p}in i ON i.series = s.series AND i.block = s.block AND i.t = s.t
          JOIN {p}ns q ON q.net = s.net),
        {p}wn AS ({self.windows}),
        {p}fe AS (
          SELECT s.series * {k} + net AS run, origin, s.block, s.t, {self.features('x')} AS z, u[:{d}] AS y
          FROM {p}st s JOIN {p}wn w ON w.series = s.series AND s.t >= w.first AND s.t < w.last
          JOIN {p}in i ON i.series = s.series AND i.block = s.block AND i.t = s.t WHERE s.t >= {self.washout}),
        {p}zz AS (SELECT (run * 1000000 + origin) * {b} + block AS key, t, unnest(range(1, {n + 1})) AS i, unnest(z) AS v FROM {p}fe),
        {p}yy AS (SELECT (run * 1000000 + origin) * {b} + block AS key, t, unnest(range({n + 1}, {n + d + 1})) AS i, unnest(y) AS v
                  FROM {p}fe),
        {p}au AS (
          SELECT key, i, list(v ORDER BY j) AS r FROM (
            SELECT a.key, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {self.ridge} ELSE 0 END AS v
            FROM {p}zz a JOIN {p}zz b ON b.key = a.key AND b.t = a.t GROUP BY 1, 2, 3
            UNION ALL
            SELECT a.key, a.i, y.i, sum(a.v * y.v) FROM {p}zz a JOIN {p}yy y ON y.key = a.key AND y.t = a.t GROUP BY 1, 2, 3)
          GROUP BY key, i),
        {sql.solve(p + 'g', p + 'au', n)},
        {p}wo AS (
          SELECT key // {b} AS key, list(list_transform(range(1, {d + 1}), lambda o:
            list_transform(range(1, {n + 1}), lambda i: m[i][{n} + o])) ORDER BY key) AS w FROM {p}g GROUP BY key // {b}),
        {p}ro AS (
          SELECT w.series, net, CAST(origin AS BIGINT) AS origin, CAST(origin - {warmup} AS BIGINT) AS t,
            CAST(list_transform(range({b}), lambda e: list_transform(range({n}), lambda f: 0.0)) AS DOUBLE[][]) AS xs,
            {zeros(self.cells)} AS y
          FROM {p}wn w, {p}ns
          UNION ALL
          SELECT series, net, origin, t + 1, xs2, {out}
          FROM (
            SELECT series, net, origin, t, w, list_transform(range(1, {b + 1}), lambda b: {step}) AS xs2
            FROM (SELECT r.series, r.net, r.origin, r.t, r.xs, CASE WHEN r.t < r.origin THEN f.v ELSE r.y END AS v, o.w, x.ix, wm, wn
                  FROM {p}ro r LEFT JOIN {self.panel} f ON f.series = r.series AND f.t = r.t
                  JOIN {p}wo o ON o.key = (r.series * {k} + r.net) * 1000000 + r.origin
                  JOIN {p}ns s ON s.net = r.net, (SELECT list(ix ORDER BY block) AS ix FROM {p}ix) x
                  WHERE r.t < r.origin + {steps} - 1) q)),
        {p}fc AS (
          SELECT series * {k} + net AS run, origin, t, unnest(range({self.cells})) AS cell, unnest(y) AS value FROM {p}ro)"""
