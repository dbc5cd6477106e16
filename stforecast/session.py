"""Session defaults and the small pieces of run-time policy the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# One task may hold a broadcast table of this many bytes without trouble on a
# default executor; larger sides go through a shuffle join.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stforecast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_LIMIT_BYTES


def broadcast_within(df: DataFrame, rows: int | None, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` only if its size is known to be within the limit.

    ``rows`` comes from the model's own arithmetic (cells x roles, runs x blocks ...);
    ``None`` means "not known", and then Spark's statistics decide.
    """
    if rows is not None and fits_broadcast(rows, row_bytes):
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place rows by key for a step that is heavy on CPU but light on bytes.

    The partition number is given, so adaptive execution does not merge the partitions
    of a few small rows that each start a long computation.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def filled(df: DataFrame, *names: str) -> DataFrame:
    """Rows on their way to a Python task, with empty arrays for null ones in the named columns.

    Spark measures a batch after every row, and a list column then walks all nulls since its last
    value: thousands of rows behind the one that carries a net would cost the square of their number.
    """
    return df.withColumns({
        f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType))
        for f in df.schema.fields if f.name in names and isinstance(f.dataType, ArrayType)
    })


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later stages read.

    Uses the reliable checkpoint folder the cluster names in ``spark.checkpoint.dir``.
    Only a local master may fall back to a scratch folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
