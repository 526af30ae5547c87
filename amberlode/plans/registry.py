"""The table of registered queries; importing a module of this package fills it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader `t(name)`; `sql` is DuckDB SQL with the same columns and rows."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
