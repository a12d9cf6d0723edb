"""All named queries and their SQL twins."""

from tabloom.plans.catalog import (  # noqa: F401
    generation,
    learning,
    profiling,
    scoring,
    tables,
    texts,
    validation,
)
from tabloom.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
