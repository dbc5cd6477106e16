"""Scalar cleaning of panels: decoding, gaps, masks, standardising, time refinement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stforecast.functions.numeric import natural_spline
from stforecast.session import broadcast_within, settle
from stforecast.sources.panel import KEYS, chunked_rank

# Fixed values of the packed sea-surface-temperature format.
PACKED_SCALE = 0.01
PACKED_OFFSET = 273.15
PACKED_VALID_RANGE = (-300, 4500)
PACKED_FILL = -32768

# A natural spline's dependence on a knot shrinks at least by half per knot, so knots
# this far away change nothing in double precision.
SPLINE_HALO = 64

# Upper bound of one row of per-cell statistics.
CELL_ROW_BYTES = 128


def decode_packed(
    df: DataFrame,
    raw: str,
    name: str = "value",
    scale: float = PACKED_SCALE,
    offset: float = PACKED_OFFSET,
    valid: tuple[int, int] = PACKED_VALID_RANGE,
    fill: int = PACKED_FILL,
) -> DataFrame:
    """Packed integers to physical values; fill and out-of-range become NULL."""
    col = F.col(raw)
    ok = (col != fill) & col.between(*valid)
    return df.withColumn(name, F.when(ok, col * F.lit(scale) + F.lit(offset)))


def drop_sparse_cells(
    panel: DataFrame, max_missing: float = 0.15, keys: Sequence[str] = KEYS,
    n_cells: int | None = None,
) -> DataFrame:
    """Blank the whole series of a cell that misses more than the given share.

    The panel must be complete (see ``complete_panel``). Missing counts are aggregated
    before any shuffle, and only the dropped cells travel to the join; with ``n_cells``
    (over all keys) given and small, the panel itself is not shuffled.
    """
    cell = [*keys, "cell"]
    dropped = (
        panel.groupBy(*cell)
        .agg(F.count("*").alias("_nt"), F.count("value").alias("_k"))
        .filter(F.col("_nt") - F.col("_k") > F.lit(max_missing) * F.col("_nt"))
        .select(*cell, F.lit(True).alias("_dropped"))
    )
    value = F.when(F.col("_dropped").isNull(), F.col("value"))
    dropped = broadcast_within(dropped, n_cells, CELL_ROW_BYTES)
    return panel.join(dropped, cell, "left").withColumn("value", value).drop("_dropped")


# Neighbours of a grid position, itself included, and those that a scan along latitude inside
# longitude meets after it.
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
SCANNED_LATER = [(dx, dy) for dx, dy in AROUND if (dx, dy) > (0, 0)]


def mask_isolated(
    panel: DataFrame,
    n_missing: int = 7,
    passes: int | None = 1,
    keys: Sequence[str] = KEYS,
    at_t: int | None = None,
    n_cells: int | None = None,
    order: str = "snapshot",
) -> DataFrame:
    """Blank interior cells with >= ``n_missing`` missing in their 3x3 neighbourhood.

    The status is taken at one time step (default: the first of the key).
    ``snapshot``: each pass uses one snapshot of the statuses; ``passes=None`` goes on until no
    cell changes. ``scan``: one scan, longitude by longitude, in which a cell blanked early counts
    as missing for those after it.

    Rounds work on a table with one row per interior cell, which is settled between two rounds:
    only cells blanked in a round add to the counts of their neighbours, so the plan does not
    grow from round to round. The panel is only joined with the blanked cells at the end.
    """
    if order not in ("snapshot", "scan"):
        raise ValueError(f"order must be snapshot or scan, got {order!r}")
    if passes is None and order == "scan":
        raise ValueError("a scan is one pass")
    if passes is not None and (passes < 1 or (order == "scan" and passes > 1)):
        raise ValueError("passes must be at least 1, and 1 for a scan")
    pos = [*keys, "lon_idx", "lat_idx"]
    if at_t is None:
        first = panel.groupBy(*keys).agg(F.min("t").alias("_t0"))
        start = panel.join(first, list(keys)).filter(F.col("t") == F.col("_t0"))
    else:
        start = panel.filter(F.col("t") == at_t)
    status = start.select(*pos, F.col("value").isNull().alias("_missing"))
    extent = status.groupBy(*keys).agg(
        F.max("lon_idx").alias("_lon1"), F.max("lat_idx").alias("_lat1")
    )
    interior = (
        (F.col("lon_idx") >= 1) & (F.col("lon_idx") < F.col("_lon1"))
        & (F.col("lat_idx") >= 1) & (F.col("lat_idx") < F.col("_lat1"))
    )

    def counted(cells: DataFrame, offsets: list[tuple[int, int]], name: str) -> DataFrame:
        """How many of the cells each position has at the other end of these offsets."""
        near = F.array(*[
            F.struct((F.col("lon_idx") + dx).alias("x"), (F.col("lat_idx") + dy).alias("y")) for dx, dy in offsets
        ])
        met = cells.select(*keys, F.explode(near).alias("_p")).select(
            *keys, F.col("_p.x").alias("lon_idx"), F.col("_p.y").alias("lat_idx"))
        return met.groupBy(*pos).agg(F.count("*").alias(name))

    hit = F.col("_n") >= n_missing
    cells = (
        status.join(extent, list(keys)).filter(interior)
        .join(counted(status.filter("_missing"), AROUND, "_k"), pos, "left")
        .select(*pos, "_missing", F.coalesce("_k", F.lit(0)).alias("_n"))
    )
    offsets = SCANNED_LATER if order == "scan" else AROUND
    rounds = passes if order == "snapshot" else None
    masked, done = None, 0
    while True:
        done += 1
        if rounds != done:  # a further round reads the table twice more
            cells = settle(cells)
        found = cells.filter(hit).select(*pos)
        masked = found if masked is None else masked.unionByName(found)
        fresh = cells.filter(hit & ~F.col("_missing"))
        if rounds == done or (rounds is None and fresh.isEmpty()):
            break
        cells = (
            cells.filter(~hit).join(counted(fresh, offsets, "_k"), pos, "left")
            .select(*pos, "_missing", (F.col("_n") + F.coalesce("_k", F.lit(0))).alias("_n"))
        )
    masked = broadcast_within(masked.withColumn("_masked", F.lit(True)), n_cells, CELL_ROW_BYTES)
    flagged = panel.join(masked, pos, "left")
    return flagged.withColumn(
        "value", F.when(F.col("_masked").isNull(), F.col("value"))
    ).drop("_masked")


def fill_missing(panel: DataFrame, value: float = 0.0) -> DataFrame:
    """Missing values to a constant (0 = the mean, after standardising)."""
    return panel.withColumn("value", F.coalesce(F.col("value"), F.lit(value)))


def cell_stats(
    panel: DataFrame, fit_until: int | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean and sample standard deviation per cell, optionally of the training part only."""
    part = panel if fit_until is None else panel.filter(F.col("t") < fit_until)
    return part.groupBy(*keys, "cell").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def standardise(
    panel: DataFrame,
    fit_until: int | None = None,
    keys: Sequence[str] = KEYS,
    stats: DataFrame | None = None,
    n_cells: int | None = None,
) -> DataFrame:
    """(value - mean) / sd per cell; a cell with no spread becomes missing.

    With ``n_cells`` (over all keys) given and small, only the statistics are shuffled.
    """
    stats = cell_stats(panel, fit_until, keys) if stats is None else stats
    stats = broadcast_within(stats, n_cells, CELL_ROW_BYTES)
    scaled = F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))
    return panel.join(stats, [*keys, "cell"]).withColumn("value", scaled).drop("mean", "sd")


def standardise_frames(
    frames: DataFrame,
    fit_until: int | None = None,
    keys: Sequence[str] = KEYS,
    n_series: int | None = None,
    n_cells: int = 0,
) -> DataFrame:
    """As :func:`standardise` on frames: sums per cell are shuffled, the frames are not.

    ``n_series`` and ``n_cells`` bound the two statistics arrays per key.
    """
    panel = frames.select(*keys, "t", F.posexplode("values").alias("cell", "value"))
    listed = F.array_sort(F.collect_list(F.struct("cell", "mean", "sd")))
    arrays = cell_stats(panel, fit_until, keys).groupBy(*keys).agg(listed.alias("_s"))
    joined = frames.join(broadcast_within(arrays, n_series, 32 * n_cells + 64), list(keys))
    scaled = F.zip_with("values", "_s", lambda v, s: F.try_divide(v - s["mean"], s["sd"]))
    return joined.withColumn("values", scaled).drop("_s")


def unstandardise(
    panel: DataFrame, stats: DataFrame, column: str = "value", keys: Sequence[str] = KEYS,
    n_cells: int | None = None,
) -> DataFrame:
    """Back to physical units with the stats of :func:`cell_stats`."""
    stats = broadcast_within(stats, n_cells, CELL_ROW_BYTES)
    back = F.col(column) * F.col("sd") + F.col("mean")
    return panel.join(stats, [*keys, "cell"]).withColumn(column, back).drop("mean", "sd")


def _spline_chunks(knots: DataFrame, chunk: int) -> DataFrame:
    """Give every knot to its own chunk and, near an edge, to the neighbour chunk too."""
    at = F.pmod(F.col("rank"), F.lit(chunk))
    own = F.floor(F.col("rank") / chunk)
    homes = F.array_compact(F.array(
        own,
        F.when((at < SPLINE_HALO) & (own > 0), own - 1),
        F.when((at >= chunk - SPLINE_HALO), own + 1),
    ))
    return knots.withColumn("chunk", F.explode(homes))


def _valid_knots(panel: DataFrame, cell: list[str], chunk: int) -> DataFrame:
    """Non-missing values with their rank in the cell, the cell's count and span."""
    span = panel.groupBy(*cell).agg(
        F.count("value").alias("k"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    valid = panel.filter(F.col("value").isNotNull()).select(*cell, "t", "value")
    ranked = chunked_rank(valid, cell, "t", F.floor(F.col("t") / chunk), "rank")
    return ranked.join(span, cell)


def fill_gaps(
    panel: DataFrame, mode: str = "compact", keys: Sequence[str] = KEYS, chunk: int = 4096
) -> DataFrame:
    """Fill the gaps of every cell that has any value.

    ``compact``: the k valid samples count as equally spaced over the whole span and are
    resampled on all time steps by a natural cubic spline (observation times play no
    part). ``time``: natural cubic spline with knots at the true times. ``linear``:
    straight lines between neighbours, first/last value beyond them, in window functions.

    Splines are solved in chunks of at most ``chunk`` knots plus a halo so wide that the
    result equals the whole-series spline to double precision; a group never holds a
    whole long series. Cells with no value stay missing.
    """
    cell = [*keys, "cell"]
    if mode == "linear":
        return _fill_linear(panel, cell, chunk)
    if mode not in ("compact", "time"):
        raise ValueError(f"mode must be compact, time or linear, got {mode!r}")
    if chunk <= 2 * SPLINE_HALO:
        raise ValueError("chunk must exceed twice the halo")
    compact = mode == "compact"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        head = pdf.iloc[0]
        k, t0, t1, c = int(head.k), int(head.t0), int(head.t1), int(head.chunk)
        lo, hi = c * chunk, min((c + 1) * chunk, k)
        first, last = c == 0, hi == k
        if compact:
            steps = t1 - t0
            x = pdf["rank"].to_numpy(float)
            unit = (k - 1) / steps if steps else 0.0
            at = np.arange(
                0 if first else int(np.floor((lo - 1) / unit)),
                (steps if last else int(np.ceil((hi + 1) / unit))) + 1,
            )
            at = at[(at >= 0) & (at <= steps)]
            where = at * unit
            # every step belongs to exactly one chunk: the one of its left knot
            owner = np.minimum(np.floor(where), k - 1) // chunk
            at, where = at[owner == c], where[owner == c]
            t_out = t0 + at
        else:
            x = pdf["t"].to_numpy(float)
            rank = pdf["rank"].to_numpy()
            from_t = t0 if first else int(x[rank == lo][0])
            to_t = t1 + 1 if last else int(x[rank == hi][0])
            t_out = np.arange(from_t, to_t)
            where = t_out.astype(float)
        values = natural_spline(x, pdf["value"].to_numpy(float), where)
        out = pd.DataFrame({name: head[name] for name in cell}, index=range(len(t_out)))
        return out.assign(t=t_out, value=values)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*cell).schema)
    knots = _spline_chunks(_valid_knots(panel, cell, chunk), chunk)
    # a chunk that holds only halo knots has nothing of its own to give
    owned = knots.filter(F.col("chunk") * chunk < F.col("k"))
    filled = owned.groupBy(*cell, "chunk").applyInPandas(
        solve, f"{schema}, t long, value double"
    )
    return (
        panel.drop("value").join(filled, [*cell, "t"], "left").select(*panel.columns)
    )


def _fill_linear(panel: DataFrame, cell: list[str], chunk: int) -> DataFrame:
    """Linear filling from each row's nearest known neighbours.

    A row looks inside its own time chunk first; the edges of the other chunks come from
    a table with two rows per (cell, chunk), so no task sorts a whole long series.
    """
    tagged = panel.withColumn("_c", F.floor(F.col("t") / chunk))
    known = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    edges = tagged.groupBy(*cell, "_c").agg(
        F.min(known).alias("_first"), F.max(known).alias("_last")
    )
    by_chunk = W.partitionBy(*cell).orderBy("_c")
    carried = edges.select(
        *cell, "_c",
        F.last("_last", True).over(by_chunk.rowsBetween(W.unboundedPreceding, -1)).alias("_prev_c"),
        F.first("_first", True).over(by_chunk.rowsBetween(1, W.unboundedFollowing)).alias("_next_c"),
    )
    inner = W.partitionBy(*cell, "_c").orderBy("t")
    near = tagged.withColumn(
        "_prev", F.last(known, True).over(inner.rowsBetween(W.unboundedPreceding, 0))
    ).withColumn("_next", F.first(known, True).over(inner.rowsBetween(0, W.unboundedFollowing)))
    both = near.join(carried, [*cell, "_c"]).withColumn(
        "_p", F.coalesce("_prev", "_prev_c")
    ).withColumn("_n", F.coalesce("_next", "_next_c"))
    share = F.try_divide(
        (F.col("t") - F.col("_p.t")).cast("double"), (F.col("_n.t") - F.col("_p.t")).cast("double")
    )
    between = F.col("_p.value") + share * (F.col("_n.value") - F.col("_p.value"))
    return both.withColumn(
        "value", F.coalesce(F.col("value"), between, F.col("_p.value"), F.col("_n.value"))
    ).select(*panel.columns)


def refine_time(
    panel: DataFrame, refinement: int, keys: Sequence[str] = KEYS, chunk: int = 4096
) -> DataFrame:
    """Natural cubic spline per cell from step 1 to step 1/refinement.

    A gap-free cell of n steps becomes (n-1) * refinement + 1 steps; the new ``t``
    counts fine steps. A cell with missing values becomes missing as a whole.
    """
    if refinement < 1:
        raise ValueError("refinement must be at least 1")
    if chunk <= 2 * SPLINE_HALO:
        raise ValueError("chunk must exceed twice the halo")
    if refinement == 1:
        return panel
    cell = [*keys, "cell"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        head = pdf.iloc[0]
        k, c = int(head.k), int(head.chunk)
        lo, hi = c * chunk, min((c + 1) * chunk, k)
        stop = (hi - 1) * refinement + 1 if hi == k else hi * refinement
        at = np.arange(lo * refinement, stop)
        values = natural_spline(
            pdf["rank"].to_numpy(float), pdf["value"].to_numpy(float), at / refinement
        )
        out = pd.DataFrame({name: head[name] for name in cell}, index=range(len(at)))
        return out.assign(t=int(head.t0) * refinement + at, value=values)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*cell).schema)
    # t is dense in a gap-free cell, so the rank is arithmetic: no sort, no window
    span = panel.groupBy(*cell).agg(
        F.count("value").alias("k"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    whole = F.col("k") == F.col("t1") - F.col("t0") + 1
    knots = panel.join(span.filter(whole).drop("t1"), cell).select(
        *cell, "value", "k", "t0", (F.col("t") - F.col("t0")).alias("rank")
    )
    chunks = _spline_chunks(knots, chunk).filter(F.col("chunk") * chunk < F.col("k"))
    fine = chunks.groupBy(*cell, "chunk").applyInPandas(solve, f"{schema}, t long, value double")
    broken = span.filter(~whole).select(
        *cell,
        F.explode(F.sequence(F.col("t0") * refinement, F.col("t1") * refinement)).alias("t"),
        F.lit(None).cast("double").alias("value"),
    )
    return fine.unionByName(broken).select(*keys, "t", "cell", "value")
