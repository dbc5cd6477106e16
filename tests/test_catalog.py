"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from compare import compare, duck

from stforecast.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["pca_fit_leading", "pca_restore_leading"])
def test_leading_components_lie_close(spark, tmp_path, name):
    """Eight coarse cells with variances one part in some thousand apart: none is the leading one."""
    rows = np.ones((1, 1))
    while len(rows) < 128:
        rows = np.block([[rows, rows], [rows, -rows]])
    values = rows[:, 1:65] + 2e-3 * np.random.default_rng(3).normal(size=(128, 64))
    spark.createDataFrame(
        [(t, [float(x) for x in v], 0) for t, v in enumerate(values)],
        "vec_id long, embedding array<float>, label int",
    ).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
