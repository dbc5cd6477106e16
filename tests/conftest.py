import os
import sys

for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(name, "1")
sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

import numpy as np
import pytest
from pyspark.sql import functions as F

from stforecast.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def panel_of(spark):
    """A cells x time array as a panel, in scrambled row order over several partitions."""

    def make(values: np.ndarray, series: str = "s", layer: int = 0):
        rows = [
            (series, layer, t, c, None if np.isnan(values[c, t]) else float(values[c, t]))
            for c in range(values.shape[0]) for t in range(values.shape[1])
        ]
        df = spark.createDataFrame(rows, "series string, layer int, t long, cell int, value double")
        return df.repartition(5, F.xxhash64("t", "cell"))

    return make


@pytest.fixture
def matrix_of():
    """A result table back to a cells x time array."""

    def make(df, value: str = "value") -> np.ndarray:
        pdf = df.select("cell", "t", value).toPandas()
        return pdf.pivot(index="cell", columns="t", values=value).to_numpy(float)

    return make
