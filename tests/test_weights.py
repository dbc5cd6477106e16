import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stforecast.operators import weights as wt


def test_whole_nets_over_batches():
    run = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, None, None, 4]
    rows = pa.table({"run": pa.array(run, pa.int64()), "layer": pa.array([0] * 6 + [1] * 7, pa.int32()), "at": range(13)})
    want = [[0, 1, 2], [3, 4], [5], [6, 7, 8, 9], [10, 11], [12]]
    for size in (1, 2, 3, 5, 20):
        got = []
        for nets, first in wt.whole_nets(iter(rows.to_batches(max_chunksize=size))):
            got += [x.tolist() for x in np.split(nets.column("at").to_numpy(), first[1:])]
        assert got == want
    assert list(wt.whole_nets(iter([]))) == []


def test_nets_of_several_sizes_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(wt, "STACK_BYTES", 5000)  # some stacks of several matrices, some of one
    entries = spark.range(400).select(
        (F.col("id") % 40).alias("run"), F.lit(0).alias("layer"), F.lit("W").alias("tag"),
        F.expr("CAST(hash(id) % 5 + 5 AS int)").alias("i"), F.expr("CAST(hash(id, 1) % 5 + 5 AS int)").alias("j"),
        F.expr("CAST(id % 7 + 1 AS double) / 3").alias("w"), F.lit(0.7).alias("radius"),
    ).withColumn("size", F.expr("CAST(10 + run % 3 + 20 * (run % 2) AS int)")).dropDuplicates(["run", "i", "j"])
    rows = entries.toPandas().sort_values(["run", "i", "j"])
    scaled = wt.scale_to_radius(entries)
    assert "InPandas" not in scaled._jdf.queryExecution().toString()  # no call a net
    got = scaled.toPandas().set_index(["run", "i", "j"])["w"]
    for _, net in rows.groupby("run"):
        m = np.zeros((net["size"].iloc[0],) * 2)
        m[net["i"], net["j"]] = net["w"]
        rho = np.abs(np.linalg.eigvals(m)).max()
        want = net["w"] * (0.7 / rho if rho > 0 else 0.0)
        assert np.allclose(got.loc[list(zip(net["run"], net["i"], net["j"], strict=True))], want)
    assert len(got) == len(rows)
