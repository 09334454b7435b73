"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; ``sql`` has those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Registers a function; ``longs`` are columns given as BIGINT, as SQL counts and places are."""

        def keep(f: Query) -> Query:
            @wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                df = f(spark, d)
                return df.select(*[F.col(c).cast("bigint").alias(c) if c in longs else F.col(c) for c in df.columns])

            self.queries[f.__name__] = run if longs else f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
