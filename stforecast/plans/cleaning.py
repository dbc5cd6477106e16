"""The cleaning chain of gridded layers as one call, with cleaned copies that later reads use."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.operators.clean import (
    drop_sparse_cells,
    fill_gaps,
    fill_missing,
    mask_isolated,
    refine_time,
    standardise,
)
from stforecast.session import settle
from stforecast.sources.panel import KEYS, complete_panel, unflatten_cells

COLUMNS = [*KEYS, "t", "cell", "value"]
MANIFEST = "layer int, copy string, folder string, parameters string"


@dataclass(frozen=True)
class Cleaning:
    """Parameters of the chain; two different ones never share a copy."""

    max_missing: float = 0.15
    fill: str = "compact"
    n_missing: int = 7
    passes: int | None = 1
    order: str = "scan"
    chunk: int = 4096


@dataclass
class Copies:
    """The cleaned panel of all layers, and the layers that this call had to clean."""

    panel: DataFrame
    cleaned: list[int]


def clean_layer(panel: DataFrame, n_lat: int, how: Cleaning = Cleaning()) -> DataFrame:
    """Drop sparse cells, fill the gaps of the others, blank isolated ones.

    ``panel`` is ``(series, layer, t, cell, value)`` with cells numbered latitude first; a cell
    that no row names is no part of the grid. The table is settled before the gaps are filled
    and before the mask, because both read it several times.
    """
    kept = settle(drop_sparse_cells(complete_panel(panel), how.max_missing))
    filled = settle(fill_gaps(kept, how.fill, chunk=how.chunk))
    grid = unflatten_cells(filled, n_lat)
    return mask_isolated(grid, how.n_missing, how.passes, order=how.order).select(*COLUMNS)


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of a table's files; the files themselves are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    row = sizes.agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return f"{row.n}:{row.h}"


def _manifest(spark: SparkSession, place: str) -> str | None:
    """Folder of the committed copy in this place, if there is one."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{place}/manifest").agg(F.min("folder")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0]


def cleaned_copies(
    spark: SparkSession, sources: Mapping[int, str], n_lat: Mapping[int, int], folder: str,
    how: Cleaning = Cleaning(),
) -> Copies:
    """Cleaned panels of the layers' Parquet tables, cleaned once and read from then on.

    A copy belongs to the files of its layer and to the parameters: if either changes, that layer
    alone is cleaned again. It is written to a folder of its own, and counts only when its row
    in the manifest is written, so neither a job that stops half-way nor two jobs at once leave
    a copy that is not whole. ``folder`` lies on storage that all executors share.
    """
    parts, cleaned = [], []
    for layer, path in sorted(sources.items()):  # a few resolutions
        stated = json.dumps({**asdict(how), "n_lat": n_lat[layer]}, sort_keys=True)
        copy = hashlib.sha256(f"{path} {files_fingerprint(spark, path)} {stated}".encode()).hexdigest()
        place = f"{folder.rstrip('/')}/layer-{layer}/{copy}"
        found = _manifest(spark, place)
        if found is None:
            found = f"{place}/panel-{uuid.uuid4().hex}"
            raw = spark.read.parquet(path).withColumn("layer", F.lit(layer))
            clean_layer(raw, n_lat[layer], how).write.parquet(found)
            row = spark.range(1).select(
                F.lit(layer).alias("layer"), F.lit(copy).alias("copy"), F.lit(found).alias("folder"),
                F.lit(stated).alias("parameters"))
            row.coalesce(1).write.mode("append").parquet(f"{place}/manifest")
            cleaned.append(layer)
        parts.append(spark.read.parquet(found).select(*COLUMNS))
    panel = parts[0]
    for part in parts[1:]:
        panel = panel.unionByName(part)
    return Copies(panel, cleaned)


def finished(panel: DataFrame, refinement: int = 1, fit_until: int | None = None, missing: float = 0.0) -> DataFrame:
    """Cleaned panels ready for a model: finer time, unit variance, nothing missing."""
    return fill_missing(standardise(refine_time(panel, refinement), fit_until), missing).select(*COLUMNS)
