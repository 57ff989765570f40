"""Relationship navigation along declared foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.govern import guard, mask, row_scope, tenant_scope
from lodestone.plans.errors import NOT_FOUND, RequestError, invalid
from lodestone.plans.schema import EntitySchema

Tables = dict[str, tuple[EntitySchema, DataFrame]]


def seen(schema: EntitySchema, df: DataFrame, tenant: str | None, tags: frozenset[str] | None) -> DataFrame:
    """Rows and columns that the caller may see."""
    rows = df.where(tenant_scope(schema, tenant, {}) & row_scope(schema, tags, {}))
    return rows.select(*mask(schema, df.columns, tags))


def edges(tables: Tables) -> dict[str, list[tuple[str, str]]]:
    """By entity, the (child entity, foreign key) pairs that point at it."""
    out: dict[str, list[tuple[str, str]]] = {}
    for schema, _ in tables.values():
        for fk, target in sorted(schema.foreign_keys().items()):
            out.setdefault(target, []).append((schema.entity, fk))
    return out


def forward(tables: Tables, entity: str, fk: str, where: Column | None = None, tenant: str | None = None, tags: frozenset[str] | None = None) -> DataFrame:
    """Targets of the source rows' key, one row per source: a null key or missing target has none."""
    schema, df = tables[entity]
    target = schema.foreign_keys().get(fk)
    if target is None or target not in tables:
        raise invalid(f"{fk} of {entity} isn't a foreign key")
    guard(schema, tags, fk)
    source = seen(schema, df if where is None else df.where(where), tenant, tags).select(F.col(schema.primary_key).alias("source_key"), F.col(fk).alias("fk"))
    dim_schema, dim = tables[target]
    dim = seen(dim_schema, dim, tenant, tags)
    return source.join(dim, F.col("fk") == F.col(dim_schema.primary_key)).drop("fk")


def reverse(tables: Tables, entity: str, child: str, fk: str, keys: DataFrame | None = None, tenant: str | None = None, tags: frozenset[str] | None = None) -> DataFrame:
    """Children that point at the entity's rows (or at ``keys`` of them)."""
    schema, df = tables[entity]
    child_schema, rows = tables[child]
    if child_schema.foreign_keys().get(fk) != entity:
        raise invalid(f"{fk} of {child} doesn't point at {entity}")
    guard(child_schema, tags, fk)
    parents = seen(schema, df, tenant, tags).select(F.col(schema.primary_key).alias("source_key"))
    if keys is not None:
        parents = parents.join(keys.select(F.col(keys.columns[0]).alias("source_key")), "source_key", "left_semi")
    return seen(child_schema, rows, tenant, tags).join(parents, F.col(fk) == F.col("source_key"))


def bundle(tables: Tables, entity: str, key, field: str | None = None, page_size: int = 20, tenant: str | None = None, tags: frozenset[str] | None = None) -> list[dict]:
    """All relations of one row: forward ones first, then the reverse ones with a page and a total each."""
    schema, df = tables[entity]
    at = F.col(schema.primary_key) == F.lit(key)
    if seen(schema, df.where(at), tenant, tags).isEmpty():
        raise RequestError(NOT_FOUND, f"{entity} {key}")
    back = edges(tables).get(entity, [])
    if field is not None and field not in schema.foreign_keys() and field not in {f for _, f in back}:
        raise invalid(f"{field} isn't a foreign key")
    out = []
    for fk, target in sorted(schema.foreign_keys().items()):
        if target in tables and field in (None, fk):
            out.append({"relation": f"{fk}->{target}", "direction": "forward", "rows": forward(tables, entity, fk, at, tenant, tags)})
    one = df.where(at).select(schema.primary_key)
    for child, fk in back:
        if field in (None, fk):
            rows = reverse(tables, entity, child, fk, one, tenant, tags)
            pk = tables[child][0].primary_key
            out.append({"relation": f"{child}.{fk}", "direction": "reverse", "rows": rows.orderBy(pk).limit(page_size), "total": rows.count()})
    return out


def relation_counts(tables: Tables, entity: str, tenant: str | None = None, tags: frozenset[str] | None = None) -> DataFrame:
    """For every row of an entity that the caller may see, the children they may see per relation: one aggregate per
    child table, united. A hidden foreign key is an error."""
    schema, df = tables[entity]
    parents = seen(schema, df, tenant, tags).select(F.col(schema.primary_key).alias("source_key"))
    out = None
    for child, fk in edges(tables).get(entity, []):
        child_schema, rows = tables[child]
        guard(child_schema, tags, fk)
        counts = seen(child_schema, rows, tenant, tags).where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("source_key")).agg(F.count(F.lit(1)).alias("total"))
        part = parents.join(counts, "source_key", "left")
        part = part.select("source_key", F.lit(f"{child}.{fk}").alias("relation"), F.coalesce("total", F.lit(0)).alias("total"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise invalid(f"nothing points at {entity}")
    return out
