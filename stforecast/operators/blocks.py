"""Block maps: which cells a block models, sees as halo, and reads from a coarser layer.

A block map has rows ``(layer, block, role, pos, cell)`` with role ``rec`` (modelled),
``neigh`` (halo) or ``layer`` (cells of the next coarser layer). ``pos`` keeps the input
order. Maps are pure arithmetic on a block range, so building one shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stforecast.functions.columns import pick
from stforecast.session import broadcast_within, fits_broadcast

ROLES = ("rec", "neigh", "layer")


def _role_rows(blocks: DataFrame, role: str, cells: Column, layer: int) -> DataFrame:
    return blocks.select(
        F.lit(layer).alias("layer"), "block", F.lit(role).alias("role"),
        F.posexplode(cells).alias("pos", "cell"),
    ).withColumn("cell", F.col("cell").cast("int"))


def _span(lo: Column, hi: Column) -> Column:
    """Integers lo..hi, empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _block_range(spark: SparkSession, n_blocks: int) -> DataFrame:
    return spark.range(n_blocks).select(F.col("id").cast("int").alias("block"))


def blocks_1d(
    spark: SparkSession, n_cells: int, n_blocks: int, mixing: int, layer: int = 0
) -> DataFrame:
    """Contiguous blocks on a ring, each with ``mixing`` halo cells on either side."""
    if n_blocks < 1 or n_cells % n_blocks:
        raise ValueError(f"{n_cells} cells do not split into {n_blocks} equal blocks")
    size = n_cells // n_blocks
    if size + 2 * mixing > n_cells:
        raise ValueError("the halo meets itself or the block: too much mixing")
    blocks = _block_range(spark, n_blocks)
    lo, hi = F.col("block") * size, F.col("block") * size + (size - 1)
    halo = F.transform(
        F.concat(_span(lo - mixing, lo - 1), _span(hi + 1, hi + mixing)),
        lambda c: F.pmod(c, F.lit(n_cells)),
    )
    return _role_rows(blocks, "rec", _span(lo, hi), layer).unionByName(
        _role_rows(blocks, "neigh", halo, layer)
    )


def blocks_1d_linked(
    spark: SparkSession,
    n_cells: int,
    divisor: int,
    n_fine: int,
    mixing: int,
    n_coarse: int,
    overlap_mode: str,
    layer: int = 1,
) -> DataFrame:
    """Fine blocks of :func:`blocks_1d` plus inputs from the coarse layer.

    ``exclude``: the parent coarse block's cells without those under the fine block.
    ``include``: only the coarse cells under the fine block.
    """
    if overlap_mode not in ("exclude", "include"):
        raise ValueError(f"overlap_mode must be exclude or include, got {overlap_mode!r}")
    if n_cells % divisor or n_fine % n_coarse or (n_cells // divisor) % n_coarse:
        raise ValueError("divisor, fine and coarse blocks must divide evenly")
    size, coarse_size = n_cells // n_fine, n_cells // divisor // n_coarse
    blocks = _block_range(spark, n_fine)
    under_lo = F.floor(F.col("block") * size / divisor).cast("int")
    under_hi = F.floor((F.col("block") * size + (size - 1)) / divisor).cast("int")
    if overlap_mode == "include":
        linked = F.sequence(under_lo, under_hi)
    else:
        parent = F.floor(F.col("block") / (n_fine // n_coarse)).cast("int")
        own = F.sequence(parent * coarse_size, parent * coarse_size + (coarse_size - 1))
        linked = F.filter(own, lambda c: ~c.between(under_lo, under_hi))
    return blocks_1d(spark, n_cells, n_fine, mixing, layer).unionByName(
        _role_rows(blocks, "layer", linked, layer)
    )


def blocks_2d(
    spark: SparkSession,
    n_lon: int,
    n_lat: int,
    div_lon: int,
    div_lat: int,
    mixing: int = 0,
    lat_mode: str = "wrap",
    layer: int = 0,
) -> DataFrame:
    """Rectangular blocks with a square halo; longitude wraps, latitude by ``lat_mode``."""
    if lat_mode not in ("wrap", "clamp"):
        raise ValueError(f"lat_mode must be wrap or clamp, got {lat_mode!r}")
    if n_lon % div_lon or n_lat % div_lat:
        raise ValueError(f"a {n_lon} x {n_lat} grid does not split into {div_lon} x {div_lat}")
    w, h = n_lon // div_lon, n_lat // div_lat
    blocks = _block_range(spark, div_lon * div_lat)
    lon0 = F.floor(F.col("block") / div_lat).cast("int") * w
    lat0 = F.pmod(F.col("block"), F.lit(div_lat)) * h
    lon1, lat1 = lon0 + (w - 1), lat0 + (h - 1)

    def wrapped(lo: Column, hi: Column, n: int) -> Column:
        ring = F.transform(F.sequence(lo - mixing, hi + mixing), lambda c: F.pmod(c, F.lit(n)))
        return F.array_distinct(ring)

    lons = wrapped(lon0, lon1, n_lon)
    lats = wrapped(lat0, lat1, n_lat) if lat_mode == "wrap" else F.sequence(
        F.greatest(lat0 - mixing, F.lit(0)), F.least(lat1 + mixing, F.lit(n_lat - 1))
    )

    def ids(xs: Column, ys: Column, keep=None) -> Column:
        def column_of(x: Column) -> Column:
            rows = ys if keep is None else F.filter(ys, lambda y: keep(x, y))
            return F.transform(rows, lambda y: x * n_lat + y)

        return F.array_sort(F.flatten(F.transform(xs, column_of)))

    own = ids(F.sequence(lon0, lon1), F.sequence(lat0, lat1))
    halo = ids(lons, lats, lambda x, y: ~(x.between(lon0, lon1) & y.between(lat0, lat1)))
    return _role_rows(blocks, "rec", own, layer).unionByName(
        _role_rows(blocks, "neigh", halo, layer)
    )


def link_layers_2d(
    fine: DataFrame, coarse: DataFrame, n_lon_f: int, n_lat_f: int, n_lon_c: int, n_lat_c: int
) -> DataFrame:
    """Fine map plus the cells of the coarse block above each fine block's first cell."""
    if n_lon_f % n_lon_c or n_lat_f % n_lat_c:
        raise ValueError("the fine grid must be a multiple of the coarse grid")
    up_lon = F.floor(F.floor(F.col("cell") / n_lat_f) / (n_lon_f // n_lon_c))
    up_lat = F.floor(F.pmod(F.col("cell"), F.lit(n_lat_f)) / (n_lat_f // n_lat_c))
    first = fine.filter((F.col("role") == "rec") & (F.col("pos") == 0)).select(
        "layer", "block", (up_lon * n_lat_c + up_lat).cast("int").alias("_above")
    )
    owner = coarse.filter("role = 'rec'").select(
        F.col("cell").alias("_above"), F.col("block").alias("_parent")
    )
    members = coarse.filter("role = 'rec'").select(F.col("block").alias("_parent"), "pos", "cell")
    linked = (
        first.join(owner, "_above").join(members, "_parent")
        .select("layer", "block", F.lit("layer").alias("role"), "pos", "cell")
    )
    return fine.unionByName(linked)


def blocks_2d_linked(
    spark: SparkSession,
    layers: Sequence[tuple[int, int, int, int]],
    mixing: int,
    lat_mode: str = "wrap",
) -> DataFrame:
    """Block maps of several layers, coarse first: ``(n_lon, n_lat, div_lon, div_lat)`` each."""
    maps = [
        blocks_2d(spark, *spec, mixing=mixing, lat_mode=lat_mode, layer=l)
        for l, spec in enumerate(layers)
    ]
    out = maps[0]
    for l in range(1, len(maps)):
        out = out.unionByName(link_layers_2d(maps[l], maps[l - 1], *layers[l][:2], *layers[l - 1][:2]))
    return out


def input_dimensions(block_map: DataFrame) -> DataFrame:
    """Input counts per layer and role, and whether all blocks of the layer agree."""
    per_block = block_map.groupBy("layer", "block").agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES]
    )
    same = [F.min(f"n_{r}") == F.max(f"n_{r}") for r in ROLES]
    return per_block.groupBy("layer").agg(
        *[F.min(f"n_{r}").alias(f"d_{r}") for r in ROLES],
        F.count("*").alias("n_blocks"),
        (same[0] & same[1] & same[2]).alias("consistent"),
    )


def layer_sizes(block_map: DataFrame) -> dict[int, Row]:
    """The row of :func:`input_dimensions` per layer; an error if blocks differ or are none."""
    rows = input_dimensions(block_map).collect()  # one row per layer
    if not rows:
        raise ValueError("the block map is empty")
    for row in rows:
        if not row.consistent:
            raise ValueError(f"blocks of layer {row.layer} differ in their input counts")
    return {row.layer: row for row in rows}


def check_dimensions(block_map: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Input counts (rec, neigh, layer) per layer, or an error if blocks differ or are none."""
    return {l: (row.d_rec, row.d_neigh, row.d_layer) for l, row in layer_sizes(block_map).items()}


def pack_blocks(block_map: DataFrame) -> DataFrame:
    """One row per block: ``rec_cells, neigh_cells, layer_cells`` as ordered arrays."""

    def cells(role: str) -> Column:
        pairs = F.collect_list(F.when(F.col("role") == role, F.struct("pos", "cell")))
        return F.array_sort(pairs).getField("cell").alias(f"{role}_cells")

    return block_map.groupBy("layer", "block").agg(*[cells(r) for r in ROLES])


def gather_inputs(
    frames: DataFrame,
    block_map: DataFrame,
    coarse_frames: DataFrame | None = None,
    keys: Sequence[str] = ("series",),
    map_rows: int | None = None,
) -> DataFrame:
    """Inputs of every block at every step, from frames: ``u_rec, u_neigh, u_layer``.

    ``keys`` name what the steps belong to (a series or a run). The packed map is sent to
    the frames, so these are neither shuffled nor sorted, and the same code serves a
    stream. The map's size is checked first (``map_rows``, counted if not given); a map
    too large for that takes the long form, :func:`gather_inputs_panel`, with the same rows.
    With coarse frames, a step that either side lacks is left out.
    """
    keys = list(keys)
    if map_rows is None:
        map_rows = block_map.count()
    if not fits_broadcast(map_rows, 8):
        coarse = None if coarse_frames is None else _long(coarse_frames, keys)
        return gather_inputs_panel(_long(frames, [*keys, "layer"]), block_map, coarse, keys, map_rows)
    empty = F.array().cast("array<double>")
    joined = frames
    if coarse_frames is not None:
        upper = coarse_frames.select(*keys, "t", F.col("values").alias("_coarse"))
        joined = joined.join(upper, [*keys, "t"])
    joined = joined.join(F.broadcast(pack_blocks(block_map)), "layer")  # size checked above
    return joined.select(
        *keys, "layer", "block", "t",
        pick(F.col("values"), F.col("rec_cells")).alias("u_rec"),
        pick(F.col("values"), F.col("neigh_cells")).alias("u_neigh"),
        (empty if coarse_frames is None else pick(F.col("_coarse"), F.col("layer_cells"))).alias("u_layer"),
    )


def _long(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.select(*keys, "t", F.posexplode("values").alias("cell", "value"))


def gather_inputs_panel(
    panel: DataFrame,
    block_map: DataFrame,
    coarse_panel: DataFrame | None = None,
    keys: Sequence[str] = ("series",),
    map_rows: int | None = None,
) -> DataFrame:
    """As :func:`gather_inputs` from long rows: a join on the cell, a grouping per step.

    The grouping key includes the step, so one long series spreads over all tasks. A batch
    operator: a grouping per step has no place in a stream without a watermark.
    """
    keys = list(keys)
    mapped = broadcast_within(block_map, map_rows, 40)
    if coarse_panel is not None:  # only steps that both sides have, as with frames
        panel = panel.join(coarse_panel.select(*keys, "t").distinct(), [*keys, "t"], "left_semi")
    own = panel.join(mapped.filter("role <> 'layer'"), ["layer", "cell"])
    rows = own.select(*keys, "layer", "block", "t", "role", "pos", "value")
    if coarse_panel is not None:
        # coarse values go to every layer that the step has, as the map links it
        steps = panel.select(*keys, "layer", "t").distinct()
        upper = coarse_panel.select(*keys, "t", "cell", "value").join(steps, [*keys, "t"])
        linked = upper.join(mapped.filter("role = 'layer'"), ["layer", "cell"])
        rows = rows.unionByName(linked.select(*rows.columns))

    def values(role: str) -> Column:
        pairs = F.collect_list(F.when(F.col("role") == role, F.struct("pos", "value")))
        return F.array_sort(pairs).getField("value").alias(f"u_{role}")

    return rows.groupBy(*keys, "layer", "block", "t").agg(*[values(r) for r in ROLES])


def merge_block_outputs(
    outputs: DataFrame, block_map: DataFrame, value: str = "yhat", map_rows: int | None = None
) -> DataFrame:
    """Per-block output arrays back to one row per cell (the block's own cells)."""
    keys = [c for c in outputs.columns if c not in (value, "block")]
    own = broadcast_within(block_map.filter("role = 'rec'"), map_rows, 40)
    long = outputs.select(*keys, "block", F.posexplode(value).alias("pos", value))
    return long.join(own.select("layer", "block", "pos", "cell"), ["layer", "block", "pos"]).select(
        *keys, "cell", value
    )
