"""Declared entities: named, keyed tables with governed fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from lodestone.plans.errors import UNKNOWN_FIELD, RequestError, invalid

#: Declared types and the Spark types they stand for; instants are kept as timestamps and compared in UTC.
TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType()}
KINDS = ("tag", "numeric", "text")


@dataclass(frozen=True)
class FieldSchema:
    """A column. ``index``: tag, numeric or text; ``indexed`` alone means tag for strings and booleans and numeric
    otherwise. ``related``: the entity that a foreign key points at. ``carried``: ``fk->entity.column`` copied
    from a parent. ``tags``: who may see it; empty means everyone."""

    name: str
    type: str = "STRING"
    indexed: bool = False
    index: str | None = None
    tags: frozenset[str] = frozenset()
    related: str | None = None
    carried: str | None = None
    values: str | None = None
    description: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise invalid(f"unknown type {self.type} of {self.name}")

    @property
    def kind(self) -> str | None:
        """The effective index; text on anything but strings is a tag, and an unknown kind is ignored."""
        if self.index in KINDS:
            return "tag" if self.index == "text" and self.type != "STRING" else self.index
        if self.indexed:
            return "tag" if self.type in ("STRING", "BOOLEAN") else "numeric"
        return None

    def visible(self, tags: frozenset[str] | None) -> bool:
        return not self.tags or bool(tags and ("*" in tags or self.tags & tags))

    def carried_path(self) -> tuple[str, str, str] | None:
        if not self.carried:
            return None
        path = DimensionPath.parse(self.carried)
        return path.fk, path.entity, path.column


@dataclass(frozen=True)
class DimensionPath:
    """``fk->entity.column``, one hop."""

    fk: str
    entity: str
    column: str

    @staticmethod
    def parse(text: str) -> DimensionPath:
        fk, arrow, rest = text.partition("->")
        entity, dot, column = rest.partition(".")
        parts = [p.strip() for p in (fk, entity, column)]
        if not arrow or not dot or not all(parts) or "->" in rest or "." in column:
            raise invalid(f"a dimension path is fk->entity.column, not {text!r}")
        return DimensionPath(*parts)


@dataclass(frozen=True)
class EntitySchema:
    namespace: str
    entity: str
    primary_key: str
    fields: tuple[FieldSchema, ...] = field(default_factory=tuple)
    tenant_field: str | None = None
    access_field: str | None = None
    description: str | None = None

    def __post_init__(self):
        if not (self.namespace or "").strip() or not (self.entity or "").strip() or not (self.primary_key or "").strip():
            raise invalid("namespace, entity and primary key are required")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise invalid(f"{self.entity} declares a field twice")
        # what requests filter by implicitly, and what joins go by, must be indexed
        for role, name in (("primary key", self.primary_key), ("tenant field", self.tenant_field), ("access field", self.access_field)):
            if name is not None and (self.find(name) is None or self.find(name).kind is None):
                raise invalid(f"{role} {name} of {self.entity} must be declared and indexed")
        for f in self.fields:
            if f.related and f.kind is None:
                raise invalid(f"foreign key {f.name} of {self.entity} must be indexed")
            if path := f.carried_path():
                if f.kind is None or self.find(path[0]) is None or self.find(path[0]).kind is None:
                    raise invalid(f"carried field {f.name} and its key must be indexed")

    def find(self, name: str) -> FieldSchema | None:
        return next((f for f in self.fields if f.name == name), None)

    def need(self, name: str) -> FieldSchema:
        if (f := self.find(name)) is None:
            raise RequestError(UNKNOWN_FIELD, f"{self.entity} has no field {name}")
        return f

    def visible(self, tags: frozenset[str] | None) -> list[str]:
        return [f.name for f in self.fields if f.visible(tags)]

    def foreign_keys(self) -> dict[str, str]:
        return {f.name: f.related for f in self.fields if f.related}

    def with_field(self, changed: FieldSchema) -> EntitySchema:
        return replace(self, fields=tuple(changed if f.name == changed.name else f for f in self.fields))

    def struct(self) -> T.StructType:
        """Spark's schema, with the governance attributes in the fields' metadata."""
        return T.StructType([
            T.StructField(f.name, TYPES[f.type], True, {k: v for k, v in {"index": f.kind, "tags": sorted(f.tags), "related": f.related, "carried": f.carried, "values": f.values, "comment": f.description}.items() if v})
            for f in self.fields
        ])
