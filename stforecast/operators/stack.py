"""State passes of many nets over one history.

The inputs of a (series, block) are placed once and serve all its nets: a group is one (series,
layer, block, segment, chunk of nets) with the nets as the rows in front, and the whole chunk
advances by stacked products. Only when the nets of a series are too large for one task are
they split into several chunks, each of which gets the inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stforecast.functions.numeric import NetStack, ridge_solutions, squared_evens
from stforecast.operators.states import NET, check_mode, net_from_row, segment_rows
from stforecast.session import broadcast_within, filled, spread

STACK = ["series", "layer", "block", "segment", "chunk"]
# Weights of the nets that advance together in one task; their Gram sums are as large again.
CHUNK_BYTES = 64 * 1024 * 1024
# States of all nets that a task holds at a time.
SLICE_BYTES = 32 * 1024 * 1024


def chunk_counts(nets: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(series, layer, chunks)``: as many chunks as the bytes of a series' nets need."""
    units = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n)
    need = F.ceil(F.sum(8 * units * units) / chunk_bytes)
    return nets.groupBy("series", "layer").agg(F.least(F.count("*"), need).cast("int").alias("chunks"))


def _placed(inputs, nets, block_map, start, stop, segment, overlap, chunk_bytes, extra: Sequence[str]) -> DataFrame:
    """Inputs behind the nets of their chunk, placed and sorted for the grouped pass."""
    chunks = chunk_counts(nets, chunk_bytes)
    small = broadcast_within(chunks, chunks.count(), 64)
    each = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk")
    data = segment_rows(inputs, start, stop, segment, overlap).join(small, ["series", "layer"], "left").select(
        "series", "layer", "block", "segment", each, "t", F.concat("u_rec", "u_neigh", "u_layer").alias("u"),
        (F.col("y") if "y" in inputs.columns else F.col("u_rec")).alias("y"), "keep",
    )
    # nets are dealt out in turn, by numbers that do not carry the weights
    order = Window.partitionBy("series", "layer").orderBy("run")
    dealt = nets.select("series", "layer", "run", (F.row_number().over(order) - 1).alias("_k")).join(
        small, ["series", "layer"]).select("series", "layer", "run", F.pmod("_k", "chunks").alias("chunk"))
    n_segments = 1 if segment is None else -(-(stop - start) // segment)
    heads = nets.join(dealt, ["series", "layer", "run"]).join(block_map.select("layer", "block").distinct(), "layer").withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1)))
    ).select(
        "series", "layer", "block", "segment", "chunk", F.lit(None).cast("long").alias("t"), "run", *NET, *extra)
    rows = data.unionByName(heads, allowMissingColumns=True)
    rows = spread(rows, *STACK).sortWithinPartitions(*STACK, F.col("t").asc_nulls_first(), "run")
    return filled(rows, *NET, *extra)


def _stacks(heads: pd.DataFrame) -> list[tuple[list[int], NetStack]]:
    """Nets of equal sizes side by side, with their runs."""
    alike: dict[tuple, list] = {}
    for row in heads.to_dict("records"):
        alike.setdefault(tuple(int(s) for s in row["sizes"]), []).append(row)
    return [([int(r["run"]) for r in rows], NetStack([net_from_row(r) for r in rows])) for rows in alike.values()]


def _run_stacks(batches: Iterator[pd.DataFrame], after: bool):
    """Stream (first head, runs, slice of inputs, states (runs, steps, units)) over one sorted group."""
    waiting, stacks, states, last, head = [], None, None, None, None
    for pdf in batches:
        if stacks is None:
            ahead = pdf["t"].isna()
            waiting.append(pdf[ahead])
            pdf = pdf[~ahead]
            if pdf.empty:
                continue
            heads = pd.concat(waiting)
            if heads.empty:
                raise ValueError("inputs without a net: check series, layer and block keys")
            head, stacks = heads.iloc[0], _stacks(heads)
            states = [stack.start() for _, stack in stacks]
            units = sum(len(runs) * stack.units for runs, stack in stacks)
            size = max(1, SLICE_BYTES // (8 * units))
        for at in range(0, len(pdf), size):
            part = pdf.iloc[at : at + size]
            t = part["t"].to_numpy(np.int64)
            if (np.diff(t, prepend=t[0] - 1 if last is None else last) != 1).any():
                raise ValueError("a state pass needs one row per step, without gaps")
            last = t[-1]
            u = np.stack(part["u"].to_numpy())
            for k, (runs, stack) in enumerate(stacks):
                x = np.empty((len(t), len(runs), stack.units))
                drive = stack.drive(u)
                for step in range(len(t)):
                    if after:
                        states[k] = stack.advance(states[k], drive[step])
                        x[step] = np.concatenate(states[k], axis=1)
                    else:
                        x[step] = np.concatenate(states[k], axis=1)
                        states[k] = stack.advance(states[k], drive[step])
                yield head, runs, part, x.transpose(1, 0, 2)


def stack_states(
    inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int, segment: int | None = None,
    overlap: int = 0, after: bool = False, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """States ``(run, layer, block, t, x)`` of all nets, as ``leaky_tanh_states`` gives them.

    ``inputs`` is ``(series, layer, block, t, u_rec, u_neigh, u_layer)``, ``nets`` has the columns
    of a packed net and the ``series`` it runs on.
    """

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, runs, part, x in _run_stacks(batches, after):
            keep = part["keep"].to_numpy(bool)
            n = int(keep.sum())
            for k, run in enumerate(runs if n else []):
                yield pd.DataFrame({
                    "run": np.full(n, run), "layer": np.full(n, key[1]), "block": np.full(n, key[2]),
                    "t": part["t"].to_numpy(np.int64)[keep], "x": list(x[k][keep]),
                })

    rows = _placed(inputs, nets, block_map, start, stop, segment, overlap, chunk_bytes, ())
    return rows.groupBy(*STACK).applyInPandas(emit, "run long, layer int, block int, t long, x array<double>")


GRAM = "run long, layer int, block int, bucket int, part int, i int, row array<double>"


def stack_gram(
    inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int, washout: int,
    mode: str = "quadratic", segment: int | None = None, overlap: int = 0, after: bool = False,
    chunk_bytes: int = CHUNK_BYTES, edges: DataFrame | None = None,
) -> DataFrame:
    """Partial Gram rows ``(run, layer, block, bucket, part, i, row)`` of the readout features of all nets.

    Without ``edges`` there is one bucket, 0. With a table ``(series, edges)`` of ascending steps a
    row of time t belongs to the bucket of the last edge up to t; steps before the first edge or
    from the last edge on are not summed. A bucket's sums leave the task when its last step is
    done, so the task holds one sum a net however many buckets there are.
    """
    check_mode(mode)
    first, in_buckets = start + washout, edges is not None

    def emit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, ...], tuple[int, np.ndarray]] = {}

        def out(runs: tuple[int, ...], bucket: int, total: np.ndarray) -> Iterator[pd.DataFrame]:
            n = total.shape[1]
            for run, rows in zip(runs, total, strict=True):
                yield pd.DataFrame({
                    "run": np.full(n, run), "layer": np.full(n, key[1]), "block": np.full(n, key[2]),
                    "bucket": np.full(n, bucket), "part": np.full(n, key[3]), "i": np.arange(n), "row": list(rows),
                })

        for head, runs, part, x in _run_stacks(batches, after):
            t = part["t"].to_numpy(np.int64)
            bucket = np.zeros(len(t), int)
            use = part["keep"].to_numpy(bool) & (t >= first)
            if in_buckets:
                known = np.asarray(head["edges"], dtype=np.int64)
                bucket = np.searchsorted(known, t, side="right") - 1
                use &= (bucket >= 0) & (bucket < len(known) - 1)
            if not use.any():
                continue
            z = squared_evens(x[:, use]) if mode == "quadratic" else x[:, use]
            y, bucket = np.stack(part["y"].to_numpy()[use]), bucket[use]
            for b in np.unique(bucket):
                zb, yb = z[:, bucket == b], y[bucket == b]
                across = zb.transpose(0, 2, 1)
                add = np.concatenate([across @ zb, across @ yb], axis=2)
                name = tuple(runs)
                if name in sums and sums[name][0] == b:
                    sums[name] = b, sums[name][1] + add
                    continue
                if name in sums:
                    yield from out(name, *sums[name])
                sums[name] = b, add
        for name, held in sums.items():
            yield from out(name, *held)

    if in_buckets:
        nets = nets.join(edges, "series")
    extra = ("edges",) if in_buckets else ()
    rows = _placed(inputs, nets, block_map, start, stop, segment, overlap, chunk_bytes, extra)
    return rows.groupBy(*STACK).applyInPandas(emit, GRAM)


def window_edges(windows: DataFrame) -> DataFrame:
    """``(series, edges)``: the ends of all training windows ``(series, origin, first, last)`` in order."""
    ends = F.flatten(F.collect_list(F.array("first", "last")))
    return windows.groupBy("series").agg(F.array_sort(F.array_distinct(ends)).alias("edges"))


def window_readouts(grams: DataFrame, windows: DataFrame, nets: DataFrame, ridges: Sequence[float]) -> DataFrame:
    """Ridge readouts of every training window: ``(run, layer, block, origin, ridge, n_out, coef)``.

    ``grams`` has one summed row per (run, layer, block, bucket, i), the buckets of
    :func:`window_edges`; ``windows`` is ``(series, origin, first, last)`` with training steps
    first <= t < last. A block's buckets come in order, so running sums up to each edge are at
    hand: a window that starts at the first edge is the sum up to its end, any other the
    difference of two. Only sums that a later window starts from are kept. A window without steps
    gives zeros (with a positive ridge).
    """
    values = [float(r) for r in ridges]
    edges = window_edges(windows)
    place = lambda name: (F.array_position("edges", F.col(name)) - 1).cast("int")
    listed = windows.join(edges, "series").groupBy("series").agg(F.array_sort(F.collect_list(
        F.struct(place("last").alias("hi"), place("first").alias("lo"), "origin"))).alias("windows"))
    per_run = nets.select("run", "series").distinct().join(listed, "series").select("run", "windows")
    blocks = grams.select("run", "layer", "block").distinct()
    # one row in front of each block's sums
    heads = blocks.join(per_run, "run").withColumn("bucket", F.lit(-1)).withColumn("i", F.lit(-1))
    keys = ["run", "layer", "block"]
    rows = grams.select(*keys, "bucket", "i", "row").unionByName(heads, allowMissingColumns=True)
    rows = filled(spread(rows, *keys).sortWithinPartitions(*keys, "bucket", "i"), "windows")

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
        at, held = None, []
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket", sort=True):
                if at is not None and bucket != at:
                    yield at, held
                    held = []
                at = bucket
                held += part["windows" if bucket < 0 else "row"].tolist()
        if at is not None:
            yield at, held

    def solve(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, wanted, starts, done = None, [], {}, 0

        def solved(upto: int) -> Iterator[pd.DataFrame]:
            """Windows that end at this edge."""
            while wanted and wanted[0]["hi"] <= upto:
                one = wanted.pop(0)
                whole = total - starts.get(one["lo"], total)  # no start: no step since that edge
                n = len(whole)
                coefs = ridge_solutions(whole[:, :n], whole[:, n:].T, values)
                yield pd.DataFrame({
                    **{name: [v] * len(values) for name, v in zip(keys, key, strict=True)},
                    "origin": [int(one["origin"])] * len(values), "ridge": values,
                    "n_out": [whole.shape[1] - n] * len(values), "coef": [w.ravel() for w in coefs],
                })

        for bucket, held in buckets(batches):
            if bucket < 0:
                wanted = sorted(held[0], key=lambda w: (w["hi"], w["lo"], w["origin"]))
                continue
            add = np.stack(held)
            if total is None:
                total = np.zeros_like(add)
            yield from solved(bucket)  # windows that end here or at an edge since the last sums
            for lo in {w["lo"] for w in wanted if done <= w["lo"] <= bucket}:
                starts[lo] = total.copy()
            total = total + add
            done = bucket + 1
            for lo in [k for k in starts if all(w["lo"] != k for w in wanted)]:
                del starts[lo]
        if total is not None:
            yield from solved(1 << 30)

    return rows.groupBy(*keys).applyInPandas(
        solve, "run long, layer int, block int, origin long, ridge double, n_out int, coef array<double>")
