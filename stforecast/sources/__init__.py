"""Readers and writers of panels, frames and sweep results."""

from stforecast.sources.panel import (
    complete_panel,
    dense_time_index,
    flatten_cells,
    from_frames,
    panel_from_events,
    read_panel,
    read_wide_csv,
    select_cells,
    stack_daily,
    time_slice,
    to_frames,
    unflatten_cells,
    write_panel,
    write_sweep_csv,
)

__all__ = [
    "complete_panel", "dense_time_index", "flatten_cells", "from_frames",
    "panel_from_events", "read_panel", "read_wide_csv", "select_cells", "stack_daily",
    "time_slice", "to_frames", "unflatten_cells", "write_panel", "write_sweep_csv",
]
