"""Reconciliation of a source table with its projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_scalar, values_equal


def reconcile(source: DataFrame, projection: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, status, fields): missing in the projection, orphan in it, or mismatched in some fields. One full join."""
    columns = [c for c in (columns or source.columns) if c != key]
    kinds = dict(source.dtypes)
    s = source.select(key, F.struct(*(normalize_scalar(F.col(c), kinds[c]).alias(c) for c in columns)).alias("s"))
    p = projection.select(key, F.struct(*((normalize_scalar(F.col(c), dict(projection.dtypes)[c]) if c in projection.columns else F.lit(None).cast("string")).alias(c) for c in columns)).alias("p"))
    both = s.join(p, key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~values_equal(F.col(f"s.{c}"), F.col(f"p.{c}")), F.lit(c)) for c in columns))) if columns else F.array().cast("array<string>")
    status = F.when(F.col("p").isNull(), "missing").when(F.col("s").isNull(), "orphan").when(F.size(differ) > 0, "mismatched")
    fields = F.when(F.col("s").isNotNull() & F.col("p").isNotNull(), differ).otherwise(F.array().cast("array<string>"))
    return both.select(key, status.alias("status"), fields.alias("fields")).where("status is not null")


def repair(source: DataFrame, projection: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """The projection with orphans gone and missing and mismatched rows taken from the source."""
    kept = projection.join(report.select(key), key, "left_anti")
    fixed = source.join(report.where("status != 'orphan'").select(key), key, "left_semi")
    return kept.unionByName(fixed.select(*kept.columns))


def missing(source: DataFrame, projection: DataFrame, key: str) -> DataFrame:
    return source.select(key).join(projection.select(key), key, "left_anti")


def orphans(source: DataFrame, projection: DataFrame, key: str) -> DataFrame:
    return missing(projection, source, key)
