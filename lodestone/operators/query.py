"""Single-entity queries: filter, project, sort, page, total."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import is_list, predicates
from lodestone.operators.govern import guard, mask, scope
from lodestone.plans.errors import NOT_FOUND, RequestError, invalid
from lodestone.plans.requests import QueryRequest
from lodestone.plans.schema import EntitySchema

MOST_ROWS, MOST_BYTES = 50, 32 * 1024


@dataclass(frozen=True)
class Plan:
    """Lazy frames: the page, and all that matches."""

    page: DataFrame
    matched: DataFrame

    def total(self) -> int:
        return self.matched.count()


def ordering(schema: EntitySchema, field: str | None, desc: bool) -> list[Column]:
    """One key, nulls last ascending and first descending; the primary key breaks ties and is the default."""
    pk = F.col(schema.primary_key).asc_nulls_last()
    if not field:
        return [pk]
    col = F.col(schema.need(field).name)
    return [col.desc_nulls_first() if desc else col.asc_nulls_last(), pk]


def plan_query(schema: EntitySchema, request: QueryRequest, df: DataFrame) -> Plan:
    """All conditions always apply, whatever access path Catalyst takes. Unknown fields are errors."""
    for name in request.fields:
        schema.need(name)
    guard(schema, request.tags, request.sort_field, *request.filters, *(r.field for r in request.ranges), *request.text)
    matched = df.where(scope(schema, request) & predicates(schema, df, request.filters, request.ranges, request.text))
    columns = mask(schema, list(request.fields) or df.columns, request.tags)
    columns = [c for c in columns if c in df.columns]
    page = matched.orderBy(*ordering(schema, request.sort_field, request.sort_desc))
    page = page.offset((request.page - 1) * request.page_size).limit(request.page_size).select(*columns)
    return Plan(page, matched)


def lookup(schema: EntitySchema, request: QueryRequest, df: DataFrame) -> DataFrame:
    """A row by its primary key. A key without a row is an error; every other condition is checked too."""
    key = request.filters.get(schema.primary_key)
    if key is None or is_list(key):
        raise invalid("a lookup needs the primary key")
    found = plan_query(schema, request, df)
    if found.matched.isEmpty():
        raise RequestError(NOT_FOUND, f"{schema.entity} {key}")
    return found.page


def multi_get(df: DataFrame, key: str, values: list[Any]) -> DataFrame:
    """Rows by keys in the order asked for, and a row of nulls where there is none."""
    if len(values) > 10_000:
        raise invalid("too many keys for one request")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {key} {dict(df.dtypes)[key]}")
    kept = df.where(F.col(key).isin(values))
    return wanted.join(kept, key, "left").orderBy("ord").drop("ord")


def trim(rows: list[dict], total: int | None = None, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[list[dict], str | None]:
    """What an agent is shown: at most so many rows, then rows from the end off until the bytes fit."""
    out = rows[:most]
    while out and len(json.dumps(out, default=str).encode()) > most_bytes:
        out = out[:-1]
    shown = None if len(out) == len(rows) and (total is None or total <= len(out)) else f"showing {len(out)} of {total if total is not None else len(rows)} rows; narrow the filters"
    return out, shown
