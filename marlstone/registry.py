"""Named queries and their SQL twins, gathered from the plans."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS = ("retrieval", "chunking", "incremental", "lookup", "graph", "ledger", "temporal", "scanning", "streams")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader: columns are pruned and filters pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new(name: str) -> None:
    if name in _queries:
        raise ValueError(f"two queries are called {name}")


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, and its SQL where there is one."""

    def keep(f):
        _new(name)
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def portable(key: str, text: str, /, **changes: str) -> None:
    """Register a query whose SQL both engines read; ``{table}`` names a table, ``[[key]]`` is replaced by the engine's own form.

    ``changes`` has, by key, "Spark's form ~~ the other's form".
    """
    ours, theirs = text, text
    for change, both in changes.items():
        a, b = both.split("~~")
        ours, theirs = ours.replace(f"[[{change}]]", a.strip()), theirs.replace(f"[[{change}]]", b.strip())
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(ours, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = key
    _new(key)
    _queries[key] = run
    _sql[key] = re.sub(r"\{(\w+)\}", r"\1", theirs)


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"marlstone.plans.{plan}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
