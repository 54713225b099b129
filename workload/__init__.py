"""Registered queries: every operator on the given tables, with SQL to compare."""

from workload.registry import ORACLES, QUERIES  # noqa: F401
from workload import basics, retrieval, scoring, selection, texts  # noqa: F401
