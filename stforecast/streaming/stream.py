"""Panels and one-step forecasts from unbounded input."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stforecast.functions.numeric import squared_evens
from stforecast.operators.states import NET, check_mode, net_from_row
from stforecast.session import BROADCAST_LIMIT_BYTES

STATE_KEYS = ["run", "layer", "block"]


def stream_panel(
    events: DataFrame,
    ts: str,
    cell: Column,
    value: Column,
    bucket: str,
    late: str,
    series: str = "events",
    layer: int = 0,
) -> DataFrame:
    """Streaming events to a bucketed panel ``(series, layer, ts, cell, value)``.

    A bucket is given out once, when the watermark has passed its end; events later than
    ``late`` behind the newest one are not counted. State is one partial average per open
    (bucket, cell), so it is bounded by the watermark, not by the stream.
    """
    return (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", bucket).alias("_w"), cell.cast("int").alias("cell"))
        .agg(F.avg(value).alias("value"))
        .select(
            F.lit(series).alias("series"), F.lit(layer).alias("layer"),
            F.col("_w.start").alias("ts"), "cell", "value",
        )
    )


def load_models(nets: DataFrame, readouts: DataFrame) -> dict[tuple[int, int, int], dict]:
    """Nets and readouts of the served runs, for the workers of a stream.

    These are model tables of known small size; their bytes are checked before they are
    fetched.
    """
    size = F.size("coef") * 8 + F.size("w_w") * 32
    joined = readouts.join(nets, ["run", "layer"])
    total = joined.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total > BROADCAST_LIMIT_BYTES:
        raise ValueError(f"{total} bytes of models; serve fewer runs per stream")
    return {
        (row.run, row.layer, row.block): {"coef": list(row.coef), **{c: row[c] for c in NET}}
        for row in joined.select(*STATE_KEYS, "coef", *NET).collect()
    }


def stream_one_step(
    inputs: DataFrame, models: dict[tuple[int, int, int], dict], mode: str = "quadratic",
    max_early: int = 10_000,
) -> DataFrame:
    """Next-step forecasts of every block as its inputs arrive.

    ``inputs`` is the streaming ``(run, layer, block, t, u_rec, u_neigh, u_layer)`` of
    ``gather_inputs``. The state of a block is its net state, the next step it waits for
    (0 at first) and the inputs that came early; a step seen before is ignored. After
    step t the output is the forecast for t + 1. If a step does not come while more than
    ``max_early`` later ones wait, the stream fails rather than let the state grow.
    """
    check_mode(mode)

    def serve(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model = models[tuple(int(k) for k in key)]
        net = net_from_row(model)
        coef = np.asarray(model["coef"]).reshape(-1, sum(net.sizes))
        bounds = np.cumsum([0, *net.sizes])
        x, due, waiting = net.start(), 0, {}
        if state.exists:
            due, flat, early_t, early_u = state.get
            x = [np.asarray(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            waiting = dict(zip(early_t, np.reshape(early_u, (len(early_t), model["n_inputs"])), strict=True))
        for pdf in batches:
            for t, u in zip(pdf["t"], pdf["u"], strict=True):
                if t >= due:
                    waiting[int(t)] = np.asarray(u)
        times, outputs = [], []
        while due in waiting:
            x = net.advance(x, net.drive(waiting.pop(due)))
            due += 1
            z = np.concatenate(x)
            times.append(due)
            outputs.append(coef @ (squared_evens(z) if mode == "quadratic" else z))
        if len(waiting) > max_early:
            raise ValueError(f"step {due} of {key} is missing while {len(waiting)} later steps wait")
        early = sorted(waiting)
        state.update((
            due, np.concatenate(x).tolist(), early,
            [float(v) for t in early for v in waiting[t]],
        ))
        if times:
            out = pd.DataFrame({n: [int(k)] * len(times) for n, k in zip(STATE_KEYS, key, strict=True)})
            yield out.assign(t=times, yhat=outputs)

    rows = inputs.select(*STATE_KEYS, "t", F.concat("u_rec", "u_neigh", "u_layer").alias("u"))
    return rows.groupBy(*STATE_KEYS).applyInPandasWithState(
        serve,
        "run long, layer int, block int, t long, yhat array<double>",
        "due long, x array<double>, early_t array<long>, early_u array<double>",
        "append", "NoTimeout",
    )


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available and give back what it wrote."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
