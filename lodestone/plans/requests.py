"""Structured requests: validated once, then turned into plans."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, time, timedelta
from typing import Any

from lodestone.plans.errors import invalid
from lodestone.plans.schema import DimensionPath, EntitySchema

PAGE_SIZE, MOST_PAGE, MOST_IN = 20, 200, 200
GROUPS, MOST_GROUPS, MOST_INPUT_GROUPS = 20, 100, 20_000
OPS = ("count", "sum", "avg", "min", "max")
UNKNOWN = "UNKNOWN"
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
END_OF_DAY = timedelta(days=1) - timedelta(milliseconds=1)


def to_epoch_ms(literal: Any, is_max: bool = False) -> int | float:
    """Milliseconds since the epoch of a range's end. Numbers stand for themselves. A date is its first
    millisecond in UTC, or its last one at the upper end; a date and time without an offset is UTC."""
    if isinstance(literal, bool):
        raise invalid(f"not a range end: {literal!r}")
    if isinstance(literal, int | float):
        return literal
    try:
        if isinstance(literal, str) and not DATE.fullmatch(literal.strip()):
            text = literal.strip()
            try:
                return float(text) if "." in text and "T" not in text and ":" not in text else int(text)
            except ValueError:
                literal = datetime.fromisoformat(text.replace("Z", "+00:00"))
        elif isinstance(literal, str):
            literal = date.fromisoformat(literal.strip())
    except ValueError:
        raise invalid(f"not a number, date or time: {literal!r}") from None
    if isinstance(literal, datetime):
        at = literal if literal.tzinfo else literal.replace(tzinfo=UTC)
    elif isinstance(literal, date):
        at = datetime.combine(literal, time(), UTC) + (END_OF_DAY if is_max else timedelta())
    else:
        raise invalid(f"not a range end: {literal!r}")
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


@dataclass(frozen=True)
class RangeFilter:
    """Closed range; an end that is None is open."""

    field: str
    min: Any = None
    max: Any = None

    def __post_init__(self):
        if not self.field or not str(self.field).strip():
            raise invalid("a range needs a field")
        if self.min is None and self.max is None:
            raise invalid(f"range of {self.field} has no end")
        lo, hi = self.ends()
        if lo is not None and hi is not None and lo > hi:
            raise invalid(f"range of {self.field} is empty: {self.min} > {self.max}")

    def ends(self) -> tuple[int | float | None, int | float | None]:
        return (None if self.min is None else to_epoch_ms(self.min), None if self.max is None else to_epoch_ms(self.max, True))


def _ranges(ranges: Any) -> tuple[RangeFilter, ...]:
    if isinstance(ranges, Mapping):
        return tuple(RangeFilter(k, v.get("min"), v.get("max")) for k, v in ranges.items())
    return tuple(ranges or ())


def _filters(filters: Mapping[str, Any] | None) -> dict[str, Any]:
    out = dict(filters or {})
    for name, value in out.items():
        if isinstance(value, Sequence | set | frozenset) and not isinstance(value, str | bytes) and len(value) > MOST_IN:
            raise invalid(f"{name} lists more than {MOST_IN} values")
    return out


def _named(namespace: str, entity: str) -> None:
    if not (namespace or "").strip() or not (entity or "").strip():
        raise invalid("namespace and entity are required")


@dataclass(frozen=True)
class QueryRequest:
    namespace: str
    entity: str
    filters: Mapping[str, Any] = field(default_factory=dict)
    ranges: tuple[RangeFilter, ...] = ()
    text: Mapping[str, str] = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    sort_field: str | None = None
    sort_desc: bool = False
    page: int = 1
    page_size: int | None = None
    tenant: str | None = None
    tags: frozenset[str] | None = None
    fresh: bool = False

    def __post_init__(self):
        _named(self.namespace, self.entity)
        put = lambda k, v: object.__setattr__(self, k, v)
        put("filters", _filters(self.filters))
        put("ranges", _ranges(self.ranges))
        put("text", {k: v for k, v in (self.text or {}).items() if v and v.strip()})
        put("fields", tuple(self.fields or ()))
        put("page", self.page if isinstance(self.page, int) and self.page >= 1 else 1)
        size = PAGE_SIZE if self.page_size is None or self.page_size < 1 else self.page_size
        if size > MOST_PAGE:
            raise invalid(f"a page has {MOST_PAGE} rows at most")
        put("page_size", size)
        put("tags", None if self.tags is None else frozenset(self.tags))


@dataclass(frozen=True)
class Metric:
    op: str
    field: str | None = None

    def __post_init__(self):
        if self.op not in OPS:
            raise invalid(f"unknown metric {self.op}")
        if self.op != "count" and not self.field:
            raise invalid(f"{self.op} needs a field")

    @property
    def alias(self) -> str:
        return "count" if self.op == "count" else f"{self.op}_{self.field}"


@dataclass(frozen=True)
class AggregateRequest:
    namespace: str
    entity: str
    group_by: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    ranges: tuple[RangeFilter, ...] = ()
    text: Mapping[str, str] = field(default_factory=dict)
    sort_by: str | None = None
    sort_desc: bool = True
    limit: int | None = None
    unknown: str = "keep"
    tenant: str | None = None
    tags: frozenset[str] | None = None
    dimension: DimensionPath | None = None

    def __post_init__(self):
        _named(self.namespace, self.entity)
        put = lambda k, v: object.__setattr__(self, k, v)
        put("filters", _filters(self.filters))
        put("ranges", _ranges(self.ranges))
        put("text", {k: v for k, v in (self.text or {}).items() if v and v.strip()})
        paths = [g for g in self.group_by if "->" in g]
        plain = tuple(g for g in self.group_by if "->" not in g)
        if len(paths) > 1:
            raise invalid("one dimension path at most")
        if paths and plain:
            raise invalid("a dimension path can't be mixed with plain group columns")
        if paths:
            put("dimension", DimensionPath.parse(paths[0]))
        put("group_by", plain)
        metrics = tuple(m if isinstance(m, Metric) else Metric(*m) for m in self.metrics) or (Metric("count"),)
        put("metrics", tuple(dict.fromkeys(metrics)))
        limit = GROUPS if self.limit is None or self.limit < 1 else self.limit
        if limit > MOST_GROUPS:
            raise invalid(f"{MOST_GROUPS} groups at most")
        put("limit", limit)
        if self.unknown not in ("keep", "discard", "error"):
            raise invalid(f"unknown policy {self.unknown}")
        put("tags", None if self.tags is None else frozenset(self.tags))


def canonical(request: QueryRequest, schema: EntitySchema | None = None, semantic: bool = False) -> str:
    """Key text that doesn't depend on the order of filters or listed values. In semantic mode the scalar values
    of string fields are left out: those are matched by meaning."""

    def shown(name: str, value: Any) -> str:
        if isinstance(value, Sequence | set | frozenset) and not isinstance(value, str | bytes):
            return "[" + ",".join(sorted(map(str, value))) + "]"
        if semantic and schema is not None and (f := schema.find(name)) is not None and f.type == "STRING":
            return "?"
        return str(value)

    parts = [
        f"{request.namespace}/{request.entity}",
        "f:" + "&".join(f"{k}={shown(k, v)}" for k, v in sorted(request.filters.items())),
        "r:" + "&".join(sorted(f"{r.field}=[{r.ends()[0]},{r.ends()[1]}]" for r in request.ranges)),
        "t:" + "&".join(f"{k}={' '.join(sorted(v.split()))}" for k, v in sorted(request.text.items())),
        "p:" + ",".join(request.fields),
        f"s:{request.sort_field or ''}{'-' if request.sort_desc else '+'}",
        f"g:{request.page}/{request.page_size}",
        f"w:{request.tenant or ''}|{','.join(sorted(request.tags)) if request.tags is not None else '-'}",
    ]
    return ";".join(parts)
