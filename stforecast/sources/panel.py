"""Panels: long tables ``(series, layer, t, cell, value)``, and their frame form.

A *frame* is one row per time step with an ``array<double>`` over the cells. Missing
values are NULL throughout; NaN is turned into NULL when a table is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["series", "layer"]


def clean_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value).cast("double")


def running_offsets(counts: DataFrame, keys: Sequence[str], bucket: str, count: str) -> DataFrame:
    """Per bucket, how many rows lie in the earlier buckets of the same key.

    ``counts`` has one row per (key, bucket), already aggregated, so this window is
    over a small table.
    """
    w = W.partitionBy(*[F.col(k) for k in keys]).orderBy(bucket)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *keys, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long").alias("ahead")
    )


def chunked_rank(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, name: str = "rank"
) -> DataFrame:
    """0-based rank by ``order`` within ``keys`` without sorting a whole key in one task.

    ``bucket`` must be monotone in ``order``. Rows are ranked inside (keys, bucket) and
    shifted by the number of rows in earlier buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = running_offsets(counts, keys, "_bucket", "_n")
    inner = W.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_rn") + F.col("ahead")).cast("long"))
        .drop("_rn", "ahead", "_bucket")
    )


def time_chunks(df: DataFrame, chunk: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Cut a series into time chunks that also hold the steps just around them.

    Adds ``_chunk`` and ``_own`` (false on a copied row). A window function over
    (keys, _chunk) then sees ``back`` earlier and ``ahead`` later steps, and no task has
    to sort a whole long series. Steps must be dense.
    """
    if max(back, ahead) >= chunk:
        raise ValueError("the neighbourhood must be shorter than a chunk")
    own = F.floor(F.col("t") / chunk)
    at = F.pmod(F.col("t"), F.lit(chunk))
    homes = F.array_compact(F.array(
        own,
        F.when(at >= chunk - back, own + 1) if back else F.lit(None).cast("long"),
        F.when(at < ahead, own - 1) if ahead else F.lit(None).cast("long"),
    ))
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_own", F.col("_chunk") == own)


def dense_time_index(
    df: DataFrame, ts: str = "ts", keys: Sequence[str] = KEYS, bucket: Column | None = None
) -> DataFrame:
    """Add ``t``: 0-based position of ``ts`` among the distinct times of its key.

    Times with no row at all get no index, so the index is dense over existing times.
    Works on the distinct times only, ranked bucket by bucket.
    """
    bucket = F.date_trunc("hour", F.col(ts)) if bucket is None else bucket
    times = df.select(*keys, ts).distinct()
    index = chunked_rank(times, keys, ts, bucket, "t")
    return df.join(index, [*keys, ts])


def panel_from_events(
    events: DataFrame,
    ts: str,
    cell: Column,
    value: Column,
    bucket_seconds: int,
    agg: str = "avg",
    series: Column | None = None,
    layer: int = 0,
    origin_seconds: int = 0,
) -> DataFrame:
    """Long records to a panel: bucket the time, aggregate per (bucket, cell).

    ``t`` counts buckets from ``origin_seconds``, so no pass for the smallest time is
    needed. One shuffle, with partial aggregation before it.
    """
    functions = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    if agg not in functions:
        raise ValueError(f"agg must be one of {sorted(functions)}, got {agg!r}")
    if dict(events.dtypes)[ts] == "timestamp_ntz":  # the session time zone plays no part
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    else:
        micros = F.unix_micros(F.col(ts))
    since = micros - F.lit(origin_seconds * 1_000_000).cast("long")
    width = F.lit(bucket_seconds * 1_000_000).cast("long")
    return (
        events.select(
            (F.lit("events") if series is None else series).alias("series"),
            F.lit(layer).alias("layer"),
            ((since - F.pmod(since, width)) / width).cast("long").alias("t"),
            cell.cast("int").alias("cell"),
            value.alias("_v"),
        )
        .groupBy(*KEYS, "t", "cell")
        .agg(functions[agg]("_v").cast("double").alias("value"))
    )


def stack_daily(
    daily: DataFrame, date: str, cell: Column, value: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Daily fields in date order on a dense index: days without a field are skipped."""
    fields = daily.select(
        *keys, F.col(date).alias("ts"), cell.cast("int").alias("cell"),
        clean_nan(value.cast("double")).alias("value"),
    )
    return dense_time_index(fields, "ts", keys).select(*keys, "t", "ts", "cell", "value")


def read_wide_csv(
    spark: SparkSession,
    path: str,
    n_cells: int,
    time_col: str | None = None,
    series: str = "csv",
    layer: int = 0,
    column_names: Sequence[str] | None = None,
) -> DataFrame:
    """Header CSV with one row per time step and one column per cell, as a panel.

    With ``time_col`` the index is the dense rank of that column. Without it the line
    order of the file is the time: lines are numbered inside each input split and the
    splits are put in (file, offset) order, so partition order plays no part.
    """
    names = list(column_names) if column_names else [f"c{i}" for i in range(n_cells)]
    fields = ([f"`{time_col}` long"] if time_col else []) + [f"`{c}` double" for c in names]
    raw = (
        spark.read.option("header", True).option("enforceSchema", True)
        .schema(", ".join(fields)).csv(path)
    )
    if time_col:
        times = raw.select(F.col(time_col).alias("_time")).distinct()
        index = chunked_rank(
            times.withColumn("_k", F.lit(0)), ["_k"], "_time", F.floor(F.col("_time") / 65536), "t"
        ).drop("_k")
        indexed = raw.withColumnRenamed(time_col, "_time").join(index, "_time")
    else:
        lines = raw.select(
            *[F.col(f"`{c}`") for c in names],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )
        split = ["_file", "_start"]
        counts = lines.groupBy(*split).agg(F.count("*").alias("_n"))
        order = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select(*split, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_ahead"))
        inner = W.partitionBy(*split).orderBy("_line")
        indexed = (
            lines.withColumn("_rn", F.row_number().over(inner) - 1)
            .join(offsets, split)
            .withColumn("t", (F.col("_rn") + F.col("_ahead")).cast("long"))
        )
    return (
        indexed.select("t", F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("cell", "_v"))
        .select(
            F.lit(series).alias("series"), F.lit(layer).alias("layer"), "t", "cell",
            clean_nan(F.col("_v")).alias("value"),
        )
    )


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per layer so that a read of one layer prunes the others."""
    panel.write.mode(mode).partitionBy("layer").parquet(path)


def read_panel(spark: SparkSession, path: str, layers: Sequence[int] | None = None) -> DataFrame:
    """Panel of the asked resolutions; other layers are pruned before the scan."""
    panel = spark.read.parquet(path)
    if layers is not None:
        panel = panel.filter(F.col("layer").isin([int(v) for v in layers]))
    return panel


def write_sweep_csv(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sweep table as CSV with header; an array parameter stays in one cell."""
    columns = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map")
        else F.col(f.name)
        for f in result.schema.fields
    ]
    result.select(*columns).write.mode(mode).option("header", True).csv(path)


def complete_panel(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Make absent (t, cell) rows explicit: every cell gets every t of its key's span.

    Rows are generated per cell with ``sequence``; there is no cross join.
    """
    span = panel.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    cells = panel.select(*keys, "cell").distinct()
    grid = cells.join(span, list(keys)).select(
        *keys, "cell", F.explode(F.sequence("_t0", "_t1")).alias("t")
    )
    return grid.join(panel.select(*keys, "t", "cell", "value"), [*keys, "t", "cell"], "left")


def to_frames(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per time step, values ordered by cell."""
    pairs = F.array_sort(F.collect_list(F.struct("cell", "value")))
    return panel.groupBy(*keys, "t").agg(pairs.getField("value").alias("values"))


def from_frames(frames: DataFrame, keys: Sequence[str] = KEYS, values: str = "values") -> DataFrame:
    """Inverse of :func:`to_frames` for frames that hold every cell."""
    return frames.select(*keys, "t", F.posexplode(values).alias("cell", "value"))


def flatten_cells(df: DataFrame, n_lat: int, lon: str = "lon_idx", lat: str = "lat_idx") -> DataFrame:
    """Cell id of a grid position, latitude varying fastest."""
    return df.withColumn("cell", (F.col(lon) * n_lat + F.col(lat)).cast("int"))


def unflatten_cells(df: DataFrame, n_lat: int) -> DataFrame:
    """Grid position of a cell id."""
    return df.withColumn("lon_idx", F.floor(F.col("cell") / n_lat).cast("int")).withColumn(
        "lat_idx", F.pmod(F.col("cell"), F.lit(n_lat)).cast("int")
    )


def time_slice(df: DataFrame, splits: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Label rows by named half-open index windows; rows outside all windows go.

    Overlapping windows (a warm-up inside the training span) give one row per window.
    """
    labels = F.array_compact(
        F.array(*[
            F.when((F.col("t") >= lo) & (F.col("t") < hi), F.lit(name))
            for name, (lo, hi) in splits.items()
        ])
    )
    first = min(lo for lo, _ in splits.values())
    last = max(hi for _, hi in splits.values())
    inside = df.filter((F.col("t") >= first) & (F.col("t") < last))
    return inside.withColumn("split", F.explode(labels))


def select_cells(df: DataFrame, cells: DataFrame | Sequence[int]) -> DataFrame:
    """Keep the given cells: a literal list, or a table of cells as a semi join."""
    if isinstance(cells, DataFrame):
        return df.join(cells.select("cell"), "cell", "left_semi").select(*df.columns)
    return df.filter(F.col("cell").isin([int(c) for c in cells]))
