"""The checked queries, by operator name."""

from stforecast.plans.catalog import (  # noqa: F401
    features,
    models,
    origins,
    prepare,
    scores,
    streams,
    structure,
)
from stforecast.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
