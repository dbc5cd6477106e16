"""Segments with certified starts, and continued states, against one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import DATA, B, L, T, spec

from stforecast.operators import blocks as bl
from stforecast.operators import readout as ro
from stforecast.operators import segments as sg
from stforecast.operators import states as st
from stforecast.operators import weights as wt
from stforecast.sources import to_frames


@pytest.fixture
def histories(spark, panel_of):
    """One history, block map, and nets that forget fast (run 0) and slowly (run 1)."""
    frames = to_frames(panel_of(DATA)).withColumn("run", F.explode(F.expr("array(0L, 1L)")))
    m = bl.blocks_1d(spark, L, B, 1)
    inputs = bl.gather_inputs(frames, m, keys=["run"]).cache()
    specs = spec(spark).withColumn("dt", F.when(F.col("run") == 0, 0.25).otherwise(0.01))
    nets = wt.pack_reservoir(specs, wt.reservoir_weights(specs)).cache()
    return inputs, nets, m


def states(df):
    rows = df.select("run", "layer", "block", "t", "x").orderBy("run", "layer", "block", "t").collect()
    return [tuple(r)[:4] for r in rows], np.array([r.x for r in rows])


def test_certified_segments_are_one_pass(histories):
    inputs, nets, m = histories
    starts = sg.segment_starts(inputs, nets, m, 0, T, 40, 1e-8).cache()
    rows = starts.collect()
    assert {(r.run, r.block, r.segment, r.x0_t) for r in rows} == {(q, b, s, 40 * s) for q in range(2) for b in range(B) for s in range(4)}
    assert max(r.gap for r in rows) <= 1e-8
    # the slow net needs every round, each segment's predecessor first; the first segment never runs again
    assert {(r.segment, r["round"]) for r in rows if r.run == 1} >= {(0, 1), (1, 2), (2, 3), (3, 4)}
    parts = st.leaky_tanh_states(inputs, nets, m, 0, T, 40, starts=sg.starts_of(starts))
    keys, want = states(st.leaky_tanh_states(inputs, nets, m, 0, T))
    got_keys, got = states(parts)
    assert got_keys == keys and np.allclose(got, want, rtol=0, atol=1e-7)
    whole = ro.sum_gram(st.state_gram(inputs, nets, m, 0, 120, 10), ro.BLOCK).orderBy("run", "block", "i").collect()
    cut = ro.sum_gram(st.state_gram(inputs, nets, m, 0, 120, 10, segment=40, starts=sg.starts_of(starts)), ro.BLOCK)
    cut = cut.orderBy("run", "block", "i").collect()
    assert np.allclose([r["row"] for r in whole], [r["row"] for r in cut], atol=1e-5)


def test_states_continue_from_the_latest_kept_one(histories):
    inputs, nets, m = histories
    kept = sg.segment_starts(inputs, nets, m, 0, 100, 30, 0.0)
    # kept before 0, 30, 60 and 90: steps from 70 on need the inputs from 60 on only
    got_keys, got = states(sg.resumed_states(inputs.where("t >= 60"), nets, m, kept, 70, T))
    keys, want = states(st.leaky_tanh_states(inputs, nets, m, 0, T).where("t >= 70"))
    assert got_keys == keys and np.allclose(got, want, rtol=0, atol=1e-12)
    none = kept.where(F.lit(False))
    assert sg.resumed_states(inputs, nets, m, none, 70, T).count() == 0
    with pytest.raises(Exception, match="without gaps"):
        sg.resumed_states(inputs.where("t >= 65"), nets, m, kept, 70, T).count()


def test_torn_histories_and_bad_values(histories):
    inputs, nets, m = histories
    with pytest.raises(ValueError, match="without gaps"):
        sg.segment_starts(inputs.where("t <> 79"), nets, m, 0, T, 40)
    with pytest.raises(ValueError, match="without gaps"):
        sg.segment_starts(inputs.where("t < 40 OR t >= 80"), nets, m, 0, T, 40)
    bad = F.transform("u_rec", lambda x: F.when(F.col("t") == 3, float("nan")).otherwise(x))
    with pytest.raises(ValueError, match="not settle"):
        sg.segment_starts(inputs.where("run = 0 AND block = 0").withColumn("u_rec", bad), nets, m, 0, T, 80)
    assert sg.segment_starts(inputs.where(F.lit(False)), nets, m, 0, T, 40).count() == 0
    with pytest.raises(ValueError):
        sg.segment_starts(inputs, nets, m, 0, T, 0)
