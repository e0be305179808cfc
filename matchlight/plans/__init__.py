"""All queries on the given tables, by name."""

from . import catalog, cells, conclusions, evaluation, hypothesis, pixels, resampling, statistics, streams, telemetry, udfs, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
