"""Recurrent state passes over long input histories.

A pass needs its steps in order, so the unit of work is one (run, layer, block, segment):
its rows are placed and sorted once, with the net's weights as the row in front, and a
grouped task streams over them batch by batch. A task holds one batch, one state vector
and the net, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.functions.numeric import LeakyNet, squared_evens
from stforecast.session import broadcast_within, filled, spread

GROUP = ["run", "layer", "block", "segment"]
NET = ["sizes", "leaks", "n_inputs", "w_level", "w_kind", "w_i", "w_j", "w_w"]
MODES = ("linear", "quadratic")


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def attach_runs(df: DataFrame, runs: DataFrame, n_runs: int | None = None) -> DataFrame:
    """Give every row of a series to each run on that series.

    The run table is counted if its size is not given, so that a series with many rows
    is not gathered in one task by a shuffle on ``series``.
    """
    table = runs.select("run", "series")
    return df.join(broadcast_within(table, table.count() if n_runs is None else n_runs, 40), "series")


def net_from_row(row) -> LeakyNet:
    return LeakyNet(*[row[c] for c in NET])


def segment_rows(rows: DataFrame, start: int, stop: int, segment: int | None, overlap: int, known: bool = False) -> DataFrame:
    """Window the rows and give each to its segment, and to the next one's warm-up.

    Without ``segment`` the history is one exact segment. With it the pass runs as
    several parallel segments, each preceded by ``overlap`` steps that only let the
    state forget its start; ``keep`` is false on those. Segments whose start is ``known``
    (see ``operators/segments``) need no such steps.
    """
    window = rows.filter((F.col("t") >= start) & (F.col("t") < stop))
    if segment is None or segment >= stop - start:
        return window.withColumn("segment", F.lit(0)).withColumn("keep", F.lit(True))
    if not (overlap == 0 if known else 0 < overlap <= segment):
        raise ValueError("the overlap must lie between 1 and the segment length")
    own = F.floor((F.col("t") - start) / segment).cast("int")
    last = (stop - start - 1) // segment
    at = F.pmod(F.col("t") - start, F.lit(segment))
    homes = F.array_compact(F.array(
        own, F.when((at >= segment - overlap) & (own < last), own + 1)
    ))
    return window.withColumn("_own", own).withColumn("segment", F.explode(homes)).withColumn(
        "keep", F.col("segment") == F.col("_own")
    ).drop("_own")


def _placed(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    segment: int | None,
    overlap: int,
    readouts: DataFrame | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Inputs behind their net, placed and sorted for the grouped pass.

    ``starts`` (GROUP, x0, x0_t) holds the state of each segment before its step x0_t; an empty x0
    is a start from zero.
    """
    data = segment_rows(inputs, start, stop, segment, overlap, starts is not None).select(
        *GROUP, "t", F.concat("u_rec", "u_neigh", "u_layer").alias("u"),
        (F.col("y") if "y" in inputs.columns else F.col("u_rec")).alias("y"), "keep",
    )
    n_segments = 1 if segment is None else -(-(stop - start) // segment)
    blocks = block_map.select("layer", "block").distinct()
    heads = nets.join(blocks, "layer").withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1)))
    )
    extra = []
    if readouts is not None:
        heads = heads.join(readouts.select("run", "layer", "block", "coef"), ["run", "layer", "block"])
        extra = ["coef"]
    if starts is not None:
        heads = heads.join(starts.select(*GROUP, "x0", "x0_t"), GROUP)
        extra += ["x0", "x0_t"]
    heads = heads.select(*GROUP, F.lit(None).cast("long").alias("t"), *NET, *extra)
    rows = data.unionByName(heads, allowMissingColumns=True)
    rows = spread(rows, *GROUP).sortWithinPartitions(*GROUP, F.col("t").asc_nulls_first())
    return filled(rows, *NET, *extra)


def _start(net: LeakyNet, head) -> list[np.ndarray]:
    if "x0" not in head or not len(head["x0"]):
        return net.start()
    return np.split(np.asarray(head["x0"], float), np.cumsum(net.sizes)[:-1])


def _run_net(batches: Iterator[pd.DataFrame], after: bool):
    """Stream (head, batch, recorded states) over one sorted group."""
    head = net = state = last = None
    for pdf in batches:
        if net is None:
            head = pdf.iloc[0]
            if not pd.isna(head["t"]):
                raise ValueError("inputs without a net: check run, layer and block keys")
            net, pdf = net_from_row(head), pdf.iloc[1:]
            state = _start(net, head)
            if not pd.isna(head.get("x0_t")):
                last = int(head["x0_t"]) - 1
        if pdf.empty:
            continue
        t = pdf["t"].to_numpy(np.int64)
        steps = np.diff(t, prepend=t[0] - 1 if last is None else last)
        if (steps != 1).any():
            raise ValueError("a state pass needs one row per step, without gaps")
        last = t[-1]
        drive = net.drive(np.stack(pdf["u"].to_numpy()))
        x = np.empty((len(t), sum(net.sizes)))
        for k in range(len(t)):
            if after:
                state = net.advance(state, drive[k])
                x[k] = np.concatenate(state)
            else:
                x[k] = np.concatenate(state)
                state = net.advance(state, drive[k])
        yield head, pdf, x


def _key_frame(key, n: int) -> dict:
    return {name: np.full(n, value) for name, value in zip(GROUP, key, strict=True)}


KEY_SCHEMA = "run long, layer int, block int, segment int"


def leaky_tanh_states(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    segment: int | None = None,
    overlap: int = 0,
    after: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """States ``(run, layer, block, t, x)``, x <- (1-a)x + a tanh(Wx + W_in u), x = 0 first.

    The state at t is the one before it consumes the input of t (``after=True``: after).
    ``starts`` gives each segment its state to begin with, instead of an overlap.
    """

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, pdf, x in _run_net(batches, after):
            keep = pdf["keep"].to_numpy(bool)
            out = pd.DataFrame(_key_frame(key, int(keep.sum())))
            out["t"] = pdf["t"].to_numpy(np.int64)[keep]
            out["x"] = list(x[keep])
            yield out

    rows = _placed(inputs, nets, block_map, start, stop, segment, overlap, starts=starts)
    return rows.groupBy(*GROUP).applyInPandas(
        emit, f"{KEY_SCHEMA}, t long, x array<double>"
    ).drop("segment")


def end_states(inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int, segment: int,
               starts: DataFrame) -> DataFrame:
    """The state each segment of ``starts`` leaves: its keys, x0, x1, and its steps t_first and t_last.

    Only the inputs of these segments are shuffled; no state in between is kept.
    """

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for head, pdf, x in _run_net(batches, True):
            first = pdf["t"].iloc[0] if first is None else first
            last, end = pdf["t"].iloc[-1], x[-1]
        if first is not None:
            x0 = head["x0"] if len(head["x0"]) else np.zeros(len(end))
            yield pd.DataFrame(_key_frame(key, 1)).assign(t_first=int(first), t_last=int(last), x0=[x0], x1=[end])

    wanted = broadcast_within(starts.select(*GROUP), starts.count(), 20)
    data = segment_rows(inputs, start, stop, segment, 0, True).join(wanted, GROUP, "left_semi").drop("segment", "keep")
    rows = _placed(data, nets, block_map, start, stop, segment, 0, starts=starts)
    return rows.groupBy(*GROUP).applyInPandas(
        emit, f"{KEY_SCHEMA}, t_first long, t_last long, x0 array<double>, x1 array<double>"
    )


def deep_states(inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int,
                segment: int | None = None, overlap: int = 0) -> DataFrame:
    """States of a deep net, recorded after each step; levels side by side in ``x``."""
    return leaky_tanh_states(inputs, nets, block_map, start, stop, segment, overlap, after=True)


def state_gram(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    washout: int,
    mode: str = "quadratic",
    segment: int | None = None,
    overlap: int = 0,
    after: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Partial Gram rows of the readout features, with the states never stored.

    Rows ``(run, layer, block, part, i, row)``: row i of [X X' | X Y'] of one segment.
    """
    check_mode(mode)
    first = start + washout

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for _, pdf, x in _run_net(batches, after):
            use = pdf["keep"].to_numpy(bool) & (pdf["t"].to_numpy(np.int64) >= first)
            if not use.any():
                continue
            z = squared_evens(x[use]) if mode == "quadratic" else x[use]
            y = np.stack(pdf["y"].to_numpy()[use])
            add = z.T @ np.hstack([z, y])
            total = add if total is None else total + add
        if total is not None:
            out = pd.DataFrame(_key_frame(key, len(total)))
            yield out.assign(i=np.arange(len(total)), row=list(total))

    rows = _placed(inputs, nets, block_map, start, stop, segment, overlap, starts=starts)
    return rows.groupBy(*GROUP).applyInPandas(
        emit, f"{KEY_SCHEMA}, i int, row array<double>"
    ).withColumnRenamed("segment", "part")


def score_one_step(
    inputs: DataFrame,
    nets: DataFrame,
    readouts: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    mode: str = "quadratic",
    segment: int | None = None,
    overlap: int = 0,
    after: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """One-step predictions under true inputs: ``(run, layer, block, t, yhat)``.

    ``t`` is the step the prediction is for.
    """
    check_mode(mode)

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for head, pdf, x in _run_net(batches, after):
            keep = pdf["keep"].to_numpy(bool)
            z = squared_evens(x[keep]) if mode == "quadratic" else x[keep]
            coef = np.asarray(head["coef"]).reshape(-1, x.shape[1])
            out = pd.DataFrame(_key_frame(key, len(z)))
            out["t"] = pdf["t"].to_numpy(np.int64)[keep] + (1 if after else 0)
            out["yhat"] = list(z @ coef.T)
            yield out

    rows = _placed(inputs, nets, block_map, start, stop, segment, overlap, readouts, starts)
    return rows.groupBy(*GROUP).applyInPandas(
        emit, f"{KEY_SCHEMA}, t long, yhat array<double>"
    ).drop("segment")
