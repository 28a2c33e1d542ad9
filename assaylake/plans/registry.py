"""The named queries: a Spark callable, and the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assaylake.session import pin_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class NamedQuery:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, NamedQuery] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = NamedQuery(fn, sql)
        return fn

    return register


def spark_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: NamedQuery):
        return lambda spark, folder: q.run(Tables(pin_session(spark), folder))

    return {name: bind(q) for name, q in CATALOG.items()}


def sql_texts() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOG.items() if q.sql is not None}
