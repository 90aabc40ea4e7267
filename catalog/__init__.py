"""The registered queries: one entry per job, with its DuckDB counterpart where SQL can express it."""

from catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
