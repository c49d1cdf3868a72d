"""Named queries: each binds an operator to the driver tables, most with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillmesh.session import tune

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


class Tables:
    """The parquet tables of one folder as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register ``build(tables)`` under ``key``; ``sql`` is its oracle, if one exists."""

    def register(build: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, build, sql)
        return build

    return register
