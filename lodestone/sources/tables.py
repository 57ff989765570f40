"""Readers of operational tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.errors import invalid

NAME = re.compile(r"[A-Za-z0-9_]+")


def checked(name: str) -> str:
    if not NAME.fullmatch(name or ""):
        raise invalid(f"not a table name: {name!r}")
    return name


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{checked(name)}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, properties: dict | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table over JDBC; with a numeric key and its bounds, read in parallel ranges."""
    if key and bounds:
        return spark.read.jdbc(url, checked(name), column=checked(key), lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties or {})
    return spark.read.jdbc(url, checked(name), properties=properties or {})
