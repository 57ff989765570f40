"""Schema registry: YAML files of declared entities, with reload, edits and generation from a catalogue."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.plans.errors import NOT_FOUND, RequestError, invalid
from lodestone.plans.schema import EntitySchema, FieldSchema

try:
    import yaml
except ImportError:
    yaml = None

Key = tuple[str, str]
MOST_INDEXED = 15


def parse(text: str) -> EntitySchema:
    if yaml is None:
        raise invalid("reading schemas needs a YAML parser")
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise invalid("a schema file holds one mapping")
    keys = raw.get("primaryKeys") or []
    if not keys:
        raise invalid("primaryKeys is empty")
    fields = []
    for f in raw.get("fields") or []:
        values = f.get("values")
        index = f.get("index")
        fields.append(FieldSchema(
            name=f["name"], type=str(f.get("type", "STRING")).upper(), indexed=bool(f.get("indexed", False)), index=index.lower() if isinstance(index, str) else None,
            tags=frozenset(f.get("tags") or ()), related=f.get("relatedEntity"), carried=f.get("carriedFrom"),
            values="; ".join(map(str, values)) if isinstance(values, list) else values, description=f.get("description"),
        ))
    return EntitySchema(raw.get("namespace", ""), raw.get("entity", ""), keys[0], tuple(fields), raw.get("tenantField"), raw.get("accessTagField"), raw.get("description"))


def render(schema: EntitySchema) -> str:
    def shown(f: FieldSchema) -> dict:
        pairs = {"name": f.name, "type": f.type, "indexed": f.indexed or None, "index": f.index, "tags": sorted(f.tags) or None, "relatedEntity": f.related, "carriedFrom": f.carried, "values": f.values, "description": f.description}
        return {k: v for k, v in pairs.items() if v is not None}

    raw = {"namespace": schema.namespace, "entity": schema.entity, "primaryKeys": [schema.primary_key], "tenantField": schema.tenant_field, "accessTagField": schema.access_field, "description": schema.description}
    return yaml.safe_dump({k: v for k, v in raw.items() if v is not None} | {"fields": [shown(f) for f in schema.fields]}, sort_keys=False, allow_unicode=True)


@dataclass
class Registry:
    """Schemas by namespace and entity: a baseline, overlaid by the files of a folder. The set in use is replaced as
    a whole, and stays if any changed file is broken; the first load skips broken files and reports them."""

    baseline: dict[Key, EntitySchema] = field(default_factory=dict)
    folder: str | None = None
    errors: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self._times: dict[str, float] = {}
        self._current = dict(self.baseline)
        self.reloads = 0
        if self.folder:
            self._load(strict=False)

    def _files(self) -> dict[str, float]:
        return {str(p): p.stat().st_mtime_ns for p in sorted(Path(self.folder).glob("*.y*ml"))} if self.folder and Path(self.folder).is_dir() else {}

    def _load(self, strict: bool) -> None:
        times, found, errors = self._files(), dict(self.baseline), {}
        for path in times:
            try:
                schema = parse(Path(path).read_text(encoding="utf-8"))
                found[schema.namespace, schema.entity] = schema
            except Exception as e:  # any fault of a file is the file's
                errors[path] = str(e)
        self._times, self.errors = times, errors
        if errors and strict:
            return
        self._current = found

    def poll(self) -> bool:
        """Reloads if a file is new, gone or changed; True if the set in use was replaced."""
        if self._files() == self._times:
            return False
        self._load(strict=True)
        self.reloads += not self.errors
        return not self.errors

    def get(self, namespace: str, entity: str) -> EntitySchema:
        found = self._current.get((namespace, entity))
        if found is None:
            raise RequestError(NOT_FOUND, f"{namespace}.{entity}")
        return found

    def list(self, namespace: str | None = None) -> list[EntitySchema]:
        return [s for k, s in sorted(self._current.items()) if namespace in (None, k[0])]

    def status(self) -> dict:
        return {"schemas": len(self._current), "files": len(self._times), "reloads": self.reloads, "errors": dict(self.errors)}

    def relate(self, namespace: str, entity: str, name: str, target: str | None) -> EntitySchema:
        """Sets or clears a foreign key, indexing the field if it must be, and writes the file."""
        schema = self.get(namespace, entity)
        f = schema.need(name)
        if target is not None and not any(s.entity == target for s in self.list(namespace)):
            raise RequestError(NOT_FOUND, f"{namespace}.{target}")
        changed = replace(f, related=target, indexed=f.indexed or (target is not None and f.kind is None))
        return self.write(schema.with_field(changed))

    def write(self, schema: EntitySchema) -> EntitySchema:
        if not self.folder:
            raise invalid("the registry has no folder to write to")
        path = Path(self.folder) / f"{schema.namespace}.{schema.entity}.yml"
        fd, temp = tempfile.mkstemp(dir=self.folder, suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            out.write(render(schema))
        os.replace(temp, path)
        self._load(strict=True)
        if (stored := self.get(schema.namespace, schema.entity)) != schema:
            raise invalid(f"{path} doesn't read back as written")
        return stored


def declared(t: T.DataType) -> str:
    """The declared type of a column: integers, decimals and instants have one each, and the rest are strings."""
    if isinstance(t, T.LongType | T.TimestampType | T.TimestampNTZType | T.DateType):
        return "TIMESTAMP" if isinstance(t, T.TimestampType | T.TimestampNTZType) else "LONG"
    if isinstance(t, T.IntegerType | T.ShortType | T.ByteType):
        return "INT"
    if isinstance(t, T.DoubleType | T.FloatType | T.DecimalType):
        return "DOUBLE"
    return "BOOLEAN" if isinstance(t, T.BooleanType) else "STRING"


def generate(namespace: str, tables: dict[str, DataFrame], keys: dict[str, str], constraints: dict[tuple[str, str], str] | None = None) -> dict[str, EntitySchema]:
    """Schemas from a catalogue: the key, foreign keys and up to 15 more columns are indexed. Foreign keys come from
    constraints, or else from names (see ``infer_keys``) where they are certain enough."""
    related = {(e, f): t for (e, f, t, c) in infer_keys(tables, keys, constraints) if c != "low"}
    out = {}
    for entity, df in tables.items():
        extra, fields = 0, []
        for col in df.schema:
            target = related.get((entity, col.name))
            must = col.name == keys[entity] or target is not None
            simple = not isinstance(col.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)
            extra += not must and simple
            fields.append(FieldSchema(col.name, declared(col.dataType), must or (simple and extra <= MOST_INDEXED), related=target))
        out[entity] = EntitySchema(namespace, entity, keys[entity], tuple(fields))
    return out


def infer_keys(tables: dict[str, DataFrame], keys: dict[str, str], constraints: dict[tuple[str, str], str] | None = None) -> list[tuple[str, str, str, str]]:
    """(entity, field, target, confidence). Explicit ones come from constraints. ``<base>_id`` leads to the table
    ``<base>``, or else to the shortest one named ``.._<base>``; it is low if several are so named. Where keys have
    other names, a column leads to the table whose key has its name, both without prefixes such as ``o_``."""
    plain = lambda n: n.split("_", 1)[1] if "_" in n and len(n.split("_", 1)[0]) <= 2 else n
    targets: dict[str, list[str]] = {}
    for entity, key in keys.items():
        targets.setdefault(plain(key), []).append(entity)
    shortest = lambda found: min(found, key=lambda t: (len(t), t))
    out = []
    for entity, df in sorted(tables.items()):
        for name in df.columns:
            base = name.removesuffix("_id") if name.endswith("_id") and len(name) > 3 else None
            named = [t for t in tables if t.endswith(f"_{base}")] if base else []
            alike = [t for t in targets.get(plain(name), []) if t != entity] if name != keys[entity] and plain(name) != "id" else []
            if target := (constraints or {}).get((entity, name)):
                out.append((entity, name, target, "explicit"))
            elif base in tables and (base, name) != (entity, keys[entity]):
                out.append((entity, name, base, "high"))
            elif found := named or alike:
                out.append((entity, name, shortest(found), "high" if len(found) == 1 else "low"))
    return out


def describe(schema: EntitySchema, df: DataFrame) -> DataFrame:
    """One row per declared field: entity, field, type, index kind, relation, and the entity's rows."""
    spark: SparkSession = df.sparkSession
    fields = spark.createDataFrame([(schema.entity, f.name, f.type, f.kind, f.related) for f in schema.fields], "entity string, field string, type string, kind string, related string")
    from pyspark.sql import functions as F

    return fields.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("docs"))))
