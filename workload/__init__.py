"""Queries over the shared test tables, each with its SQL equivalent."""

from workload import (  # noqa: F401
    controls, loads, monitoring, rules, tables, validation,
)
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
