"""A registry of named queries, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects query functions and their oracle statements under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""

        def add(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to all shuffle partitions by its key, before Python runs over its rows: a table of few bytes is read as one or two splits however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
