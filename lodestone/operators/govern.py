"""Governance: tenants, row tags, column masks. Everything fails closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.filters import is_list
from lodestone.plans.errors import TENANT_MISMATCH, TENANT_REQUIRED, RequestError, invalid
from lodestone.plans.requests import AggregateRequest, QueryRequest
from lodestone.plans.schema import EntitySchema

ALL = "*"


def tenant_scope(schema: EntitySchema, tenant: str | None, filters: dict) -> Column:
    if schema.tenant_field is None:
        return F.lit(True)
    if not tenant:
        raise RequestError(TENANT_REQUIRED, f"{schema.entity} needs a tenant")
    asked = filters.get(schema.tenant_field)
    if asked is not None and (str(tenant) not in map(str, asked) if is_list(asked) else str(asked) != str(tenant)):
        raise RequestError(TENANT_MISMATCH, "the filter names another tenant")
    return F.col(schema.tenant_field).cast("string") == F.lit(str(tenant))


def row_scope(schema: EntitySchema, tags: frozenset[str] | None, filters: dict) -> Column:
    """Rows whose tag the caller holds. ``*`` is unrestricted; no tags see nothing. A list-valued filter on the
    tag field counts as one value and so matches none."""
    if schema.access_field is None or (tags and ALL in tags):
        return F.lit(True)
    if not tags:
        return F.lit(False)
    asked = filters.get(schema.access_field)
    if asked is not None and (is_list(asked) or str(asked) not in tags):
        return F.lit(False)
    return F.col(schema.access_field).isin(sorted(tags))


def scope(schema: EntitySchema, request: QueryRequest | AggregateRequest) -> Column:
    return tenant_scope(schema, request.tenant, request.filters) & row_scope(schema, request.tags, request.filters)


def mask(schema: EntitySchema, columns: list[str], tags: frozenset[str] | None) -> list[str]:
    """Columns the caller may see, in their order; undeclared ones carry no tags."""
    hidden = {f.name for f in schema.fields} - set(schema.visible(tags))
    return [c for c in columns if c not in hidden]


def guard(schema: EntitySchema, tags: frozenset[str] | None, *names: str | None) -> None:
    """Refuses hidden columns wherever their values could show through: filters, sorts, groups and metrics."""
    for name in names:
        if name and (f := schema.find(name)) is not None and not f.visible(tags):
            raise invalid(f"{name} isn't available")
