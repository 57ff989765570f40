"""Predicates of requests as columns."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import has_tokens
from lodestone.plans.errors import invalid
from lodestone.plans.requests import RangeFilter
from lodestone.plans.schema import EntitySchema, FieldSchema


def is_list(value: Any) -> bool:
    return isinstance(value, list | tuple | set | frozenset)


def number(value: Any) -> float | None:
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def pushable(f: FieldSchema | None, value: Any) -> bool:
    """Can an index answer this filter? Aggregates take no others."""
    if f is None or f.kind is None:
        return False
    if is_list(value):
        return f.kind == "tag" and len(value) > 0
    return f.kind != "numeric" or number(value) is not None


def equality(f: FieldSchema | None, name: str, value: Any) -> Column:
    """Scalar or any-of. Null never matches. Text fields contain all tokens; numeric ones compare as numbers, and
    what isn't a number is compared as text."""
    col = F.col(name)
    if is_list(value):
        if f is not None and f.kind == "numeric" and all(number(v) is not None for v in value):
            return col.isin([_typed(f, v) for v in value]) if value else F.lit(False)
        return col.cast("string").isin([str(v) for v in value]) if value else F.lit(False)
    if f is not None and f.kind == "text":
        return has_tokens(col, str(value)) & col.isNotNull()
    if f is not None and f.type in ("INT", "LONG", "DOUBLE") and number(value) is not None:
        return col == F.lit(_typed(f, value))
    if f is not None and f.type == "BOOLEAN" and str(value).lower() in ("true", "false"):
        return col == F.lit(str(value).lower() == "true")
    return col == F.lit(str(value)) if f is not None and f.type == "STRING" else col.cast("string") == F.lit(str(value))


def _typed(f: FieldSchema, value: Any):
    """The literal in the column's own type where that loses nothing, so that it reaches the scan."""
    if isinstance(value, str) and f.type in ("INT", "LONG"):
        try:
            return int(value)
        except ValueError:
            pass
    n = float(value)
    return int(value) if f.type in ("INT", "LONG") and n == int(n) and abs(n) < 2**53 else n


def in_range(f: FieldSchema, r: RangeFilter, kind: str) -> Column:
    """Closed; ends of instants are milliseconds since the epoch, turned into literals that reach the scan."""
    lo, hi = r.ends()
    col = F.col(r.field)
    if kind.startswith("timestamp"):
        lo, hi = (None if x is None else instant(int(x), kind) for x in (lo, hi))
    elif kind == "date":
        day = lambda ms: F.date_from_unix_date(F.lit(int(ms // 86_400_000)))
        lo, hi = (None if x is None else day(x) for x in (lo, hi))
    parts = ([col >= lo] if lo is not None else []) + ([col <= hi] if hi is not None else [])
    return reduce(lambda a, b: a & b, parts)


def instant(ms: int, kind: str) -> Column:
    """A literal of the column's kind; one without a zone is in UTC, whatever the session's zone is."""
    if kind == "timestamp_ntz":
        at = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
        return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ', timespec='milliseconds')}'")
    return F.timestamp_millis(F.lit(ms))


def predicates(schema: EntitySchema, df: DataFrame, filters: dict, ranges: tuple, text: dict, strict: bool = False) -> Column:
    """All of a request's conditions together; none is met by every row. ``strict`` refuses what no index answers."""
    kinds = dict(df.dtypes)
    out = []
    for name, value in filters.items():
        f = schema.need(name)
        if strict and not pushable(f, value):
            raise invalid(f"{name} can't be filtered in an aggregate")
        out.append(equality(f, name, value))
    for r in ranges:
        f = schema.need(r.field)
        if f.kind != "numeric" and not kinds[r.field].startswith(("timestamp", "date")):
            raise invalid(f"{r.field} has no numeric index")
        out.append(in_range(f, r, kinds[r.field]))
    for name, wanted in text.items():
        if schema.need(name).kind != "text":
            raise invalid(f"{name} has no text index")
        out.append(has_tokens(F.col(name), wanted) & F.col(name).isNotNull())
    return reduce(lambda a, b: a & b, out, F.lit(True))
