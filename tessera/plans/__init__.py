"""Importing this package registers all queries."""

from . import aggregates, cases, graphs, pipelines, relations, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
