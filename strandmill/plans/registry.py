"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.sources.panels import ctes

#: Modules of queries beside this one.
MODULES = ("panel_queries", "signal_queries", "ledger_queries", "statistics_queries")
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, panels: tuple = (), sql: str | None = None, more: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame, and SQL over panels, after further expressions."""

    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            head = ctes(*panels).replace("WITH ", "WITH RECURSIVE ", 1) if panels else ""
            head += (", " if head else "WITH RECURSIVE ") + more if more else ""
            _SQL[name] = f"{head} {sql}"
        return f

    return keep


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Keys as they are, other columns of floating point rounded, without negative zero."""
    def r(c: str) -> Column:
        return F.col(c) if c in keys or dict(df.dtypes)[c] != "double" else (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)

    return df.select(*(r(c) for c in df.columns))


def _load() -> None:
    for m in MODULES:
        import_module(f"strandmill.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
