import pytest

from stforecast.operators import blocks as bl


def role(block_map, block, name):
    rows = block_map.filter(f"block = {block} and role = '{name}'").orderBy("pos").collect()
    return [r.cell for r in rows]


def test_ring_blocks_have_left_then_right_halo(spark):
    m = bl.blocks_1d(spark, 12, 3, 1)
    assert bl.check_dimensions(m) == {0: (4, 2, 0)}
    assert role(m, 0, "rec") == [0, 1, 2, 3]
    assert role(m, 0, "neigh") == [11, 4]
    assert role(m, 2, "neigh") == [7, 0]


def test_ring_blocks_reject_bad_sizes(spark):
    with pytest.raises(ValueError):
        bl.blocks_1d(spark, 10, 3, 1)
    with pytest.raises(ValueError):
        bl.blocks_1d(spark, 12, 3, 5)


def test_no_halo(spark):
    assert bl.check_dimensions(bl.blocks_1d(spark, 12, 3, 0)) == {0: (4, 0, 0)}


def test_linked_modes(spark):
    exclude = bl.blocks_1d_linked(spark, 12, 2, 4, 1, 2, "exclude")
    include = bl.blocks_1d_linked(spark, 12, 2, 4, 1, 2, "include")
    # block 1 holds fine cells 3..5, over coarse 1 and 2; its parent holds 0..2
    assert role(exclude, 1, "layer") == [0]
    assert role(include, 1, "layer") == [1, 2]
    with pytest.raises(ValueError):
        bl.blocks_1d_linked(spark, 12, 2, 4, 1, 2, "both")


def test_grid_blocks_wrap_and_clamp(spark):
    wrap = bl.blocks_2d(spark, 6, 6, 2, 2, 1)
    assert bl.check_dimensions(wrap) == {0: (9, 16, 0)}
    clamp = bl.blocks_2d(spark, 6, 6, 2, 2, 1, lat_mode="clamp")
    assert bl.check_dimensions(clamp) == {0: (9, 11, 0)}
    assert bl.check_dimensions(bl.blocks_2d(spark, 6, 6, 2, 2)) == {0: (9, 0, 0)}
    # brute force of one halo: block 0 holds lon 0..2, lat 0..2
    own = {(x, y) for x in range(3) for y in range(3)}
    halo = {((x + a) % 6, (y + b) % 6) for x, y in own for a in (-1, 0, 1) for b in (-1, 0, 1)} - own
    assert role(wrap, 0, "neigh") == sorted(x * 6 + y for x, y in halo)


def test_small_grid_halo_counts_cells_once(spark):
    m = bl.blocks_2d(spark, 3, 3, 1, 1, 2)
    assert bl.check_dimensions(m) == {0: (9, 0, 0)}


def test_two_layers(spark):
    m = bl.blocks_2d_linked(spark, [(2, 2, 1, 1), (4, 4, 2, 2)], 0)
    assert bl.check_dimensions(m) == {0: (4, 0, 0), 1: (4, 0, 4)}
    assert [r.cell for r in m.filter("layer = 1 and block = 3 and role = 'layer'").orderBy("pos").collect()] == [0, 1, 2, 3]


def test_dimension_errors(spark):
    good = bl.blocks_1d(spark, 4, 2, 0)
    extra = spark.createDataFrame([(0, 1, "neigh", 0, 0)], "layer int, block int, role string, pos int, cell int")
    with pytest.raises(ValueError):
        bl.check_dimensions(good.unionByName(extra))
    with pytest.raises(ValueError):
        bl.check_dimensions(good.filter("false"))


def test_large_map_takes_the_long_path(spark, panel_of, monkeypatch):
    import numpy as np

    from stforecast.sources import to_frames

    values = np.arange(48.0).reshape(12, 4)
    frames = to_frames(panel_of(values))
    m = bl.blocks_1d(spark, 12, 3, 1)
    small = bl.gather_inputs(frames, m).orderBy("block", "t").collect()
    monkeypatch.setattr(bl, "fits_broadcast", lambda rows, row_bytes: False)
    large = bl.gather_inputs(frames, m).orderBy("block", "t").collect()
    assert [(r.block, r.t, r.u_rec, r.u_neigh) for r in small] == [
        (r.block, r.t, r.u_rec, r.u_neigh) for r in large
    ]
    assert small[0].u_rec == [0.0, 4.0, 8.0, 12.0]


def test_both_forms_leave_out_steps_without_coarse_values(spark, panel_of, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from stforecast.sources import to_frames

    fine = panel_of(np.arange(32.0).reshape(8, 4), layer=1)
    coarse = panel_of(100 + np.arange(16.0).reshape(4, 4)).filter("t IN (1, 3)")
    m = bl.blocks_1d_linked(spark, 8, 2, 4, 1, 2, "include")
    three = m.unionByName(m.withColumn("layer", F.lit(2)).withColumn("cell", F.col("cell") * 0))
    frames = to_frames(fine)

    def rows(block_map):
        out = bl.gather_inputs(frames, block_map, to_frames(coarse)).orderBy("layer", "block", "t").collect()
        return [(r.layer, r.block, r.t, r.u_rec, r.u_neigh, r.u_layer) for r in out]

    small, small_three = rows(m), rows(three)
    monkeypatch.setattr(bl, "fits_broadcast", lambda rows, row_bytes: False)
    assert rows(m) == small and rows(three) == small_three
    assert len(small) == 8 and all(len(r[5]) == 1 for r in small)
