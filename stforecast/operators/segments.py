"""State passes in parallel segments with certified starts, and states to continue from.

Every segment needs the state its predecessor leaves. All segments first run from zero at the
same time; a segment then runs again, from the end its predecessor now has, as long as the two
differ by more than a tolerance. Nets forget, so this ends after a round or two for segments
longer than a net's memory. It ends for any net: after k rounds the first k segments are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stforecast.operators.readout import BLOCK
from stforecast.operators.states import GROUP, end_states, leaky_tanh_states
from stforecast.session import broadcast_within, settle


def segment_starts(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    start: int,
    stop: int,
    segment: int,
    tolerance: float = 1e-9,
) -> DataFrame:
    """The state every segment starts from: ``(run, layer, block, segment, x0_t, x0, gap, round)``.

    ``x0`` is the state before step ``x0_t``; ``gap``, the certificate, is its largest difference
    from the state the segment before leaves (at most ``tolerance``; with 0 the starts are those
    of one pass), and ``round`` the round in which the segment last ran. Only segments whose gap
    is too large are read again: two passes over the history if segments outlast the memory, at
    worst as many rounds as segments. Between rounds only one row a segment is kept. A history
    with a step missing between two segments is refused, one without rows has no starts.
    """
    if segment < 1 or tolerance < 0:
        raise ValueError("a segment has one step or more, and the tolerance is not negative")
    n_segments = -(-(stop - start) // segment)
    own = F.lit(start) + F.col("segment").cast("long") * segment
    zero = nets.select("run", "layer").join(block_map.select("layer", "block").distinct(), "layer").select(
        *BLOCK, F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1))).alias("segment"),
        F.lit(None).cast("array<double>").alias("x0"), F.lit(None).cast("long").alias("x0_t"))
    ends = settle(end_states(inputs, nets, block_map, start, stop, segment, zero).withColumn("round", F.lit(1)))
    for turn in range(2, n_segments + 3):
        left = ends.select(*BLOCK, (F.col("segment") + 1).alias("segment"), F.col("x1").alias("given"), F.col("t_last").alias("t_left"))
        # what is no number counts as far apart
        apart = F.array_max(F.zip_with("x0", "given", lambda a, b: F.coalesce(F.abs(a - b), F.lit(float("nan")))))
        checked = ends.join(left, GROUP, "left").withColumn("gap", F.when(F.col("segment") == 0, F.lit(0.0)).otherwise(apart))
        if turn == 2:
            torn = checked.where("segment > 0").where(~F.col("t_left").eqNullSafe(F.col("t_first") - 1)).first()
            if torn is not None:
                raise ValueError(f"a state pass needs one row per step, without gaps: none just before step {torn['t_first']}")
        again = settle(checked.where(F.col("gap") > tolerance).select(*GROUP, F.col("given").alias("x0"), own.alias("x0_t")))
        if again.isEmpty():
            return checked.select(*GROUP, own.alias("x0_t"), "x0", "gap", "round")
        new = end_states(inputs, nets, block_map, start, stop, segment, again).withColumn("round", F.lit(turn))
        ends = settle(ends.join(again.select(*GROUP), GROUP, "left_anti").unionByName(new))
    raise ValueError("the states do not settle: an input or a weight is not a number")


def certified_states(inputs: DataFrame, nets: DataFrame, block_map: DataFrame, start: int, stop: int, segment: int,
                     tolerance: float = 1e-9, after: bool = False) -> DataFrame:
    """``leaky_tanh_states`` of the whole history from parallel segments with certified starts."""
    starts = starts_of(segment_starts(inputs, nets, block_map, start, stop, segment, tolerance))
    return leaky_tanh_states(inputs, nets, block_map, start, stop, segment, after=after, starts=starts)


def starts_of(starts: DataFrame) -> DataFrame:
    """Starts as the passes take them. The first segment may begin later than its window, from zero."""
    return starts.select(*GROUP, "x0", F.when(F.col("segment") > 0, F.col("x0_t")).alias("x0_t"))


def resumed_states(
    inputs: DataFrame,
    nets: DataFrame,
    block_map: DataFrame,
    kept: DataFrame,
    begin: int,
    stop: int,
    after: bool = False,
) -> DataFrame:
    """States of the steps from ``begin`` to before ``stop``, continued from kept states.

    ``kept`` has (run, layer, block, x0_t, x0), such as ``segment_starts`` returns and later runs
    add to. Each block goes on from its latest state at or before ``begin``, so the cost is the
    distance of kept states and not the length of the history. A block without one is left out;
    inputs that do not begin at the kept step are refused.
    """
    near = settle(kept.where(F.col("x0_t") <= begin).groupBy(*BLOCK).agg(F.max("x0_t").alias("x0_t"), F.max_by("x0", "x0_t").alias("x0")))
    first = near.agg(F.min("x0_t")).first()[0]
    known = broadcast_within(near.select(*BLOCK, "x0_t"), near.count(), 24)
    rows = inputs.join(known, BLOCK).where(F.col("t") >= F.col("x0_t")).drop("x0_t")
    at = near.withColumn("segment", F.lit(0))
    states = leaky_tanh_states(rows, nets, block_map, begin if first is None else first, stop, after=after, starts=at)
    return states.where(F.col("t") >= begin)
