"""Registration of queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datasets.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "urls", "content", "headers", "attachments", "reputation", "facts", "reports", "health",
    "features", "ensemble", "respond", "behaviour", "threads", "sources", "sinks", "access",
    "ml", "streams", "extensions",
]


def plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(CASE WHEN x THEN 1 END)``, which DuckDB types as BIGINT."""
    mark = "count_if("
    while (at := sql.find(mark)) >= 0:
        end, depth = at + len(mark), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len(mark):end - 1]} THEN 1 END){sql[end:]}"
    return sql


def register(key: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register a query under ``key``; ``oracle`` may use any derived view by name."""

    def wrap(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            done = oracle.lstrip().startswith("WITH")
            ORACLES[key] = plain_counts(oracle if done else with_views("duckdb", oracle, ctes))
        return fn

    return wrap


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")


def plain(df: DataFrame, digits: int = 8) -> DataFrame:
    """Report form: doubles rounded, integers as bigint, dates as text, arrays joined by '|'."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        columns.append(c.alias(f.name))
    return df.select(columns)
