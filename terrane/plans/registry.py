"""Where query functions and their SQL twins are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(t)``, where ``t("table")`` reads a table of the data folder."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(Tables(spark, sf_dir))

        run.__doc__, run.__name__ = function.__doc__, name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return function

    return add


class Tables:
    """Reads ``<folder>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
