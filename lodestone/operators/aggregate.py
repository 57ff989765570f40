"""Governed aggregates: groups, metrics, top-N and one-hop dimension roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import predicates
from lodestone.operators.govern import guard, scope
from lodestone.plans.errors import invalid
from lodestone.plans.requests import MOST_INPUT_GROUPS, UNKNOWN, AggregateRequest, Metric
from lodestone.plans.schema import EntitySchema


@dataclass(frozen=True)
class Aggregated:
    rows: DataFrame
    groups: DataFrame
    input_groups: DataFrame | None = None

    def total_groups(self) -> int:
        return self.groups.count()


def metric(m: Metric) -> Column:
    if m.op == "count":
        return F.count(F.lit(1)).alias(m.alias)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[m.op](m.field).alias(m.alias)


def top(groups: DataFrame, keys: list[str], request: AggregateRequest) -> DataFrame:
    """The first groups by one key; group columns break ties."""
    by = request.sort_by or request.metrics[0].alias
    if by not in groups.columns:
        raise invalid(f"{by} is neither a metric nor a group column")
    first = F.col(by).desc_nulls_last() if request.sort_desc else F.col(by).asc_nulls_last()
    return groups.orderBy(first, *(F.col(k).asc_nulls_last() for k in keys if k != by)).limit(request.limit)


def check_columns(schema: EntitySchema, request: AggregateRequest) -> None:
    for name in request.group_by:
        if schema.need(name).kind is None:
            raise invalid(f"{name} isn't indexed")
    for m in request.metrics:
        if m.field is not None and schema.need(m.field).kind != "numeric":
            raise invalid(f"{m.field} has no numeric index")
    aliases = {m.alias for m in request.metrics}
    fk = request.dimension.fk if request.dimension else None
    guard(schema, request.tags, *request.group_by, fk, *(m.field for m in request.metrics), None if request.sort_by in aliases else request.sort_by)
    guard(schema, request.tags, *request.filters, *(r.field for r in request.ranges), *request.text)


def plan_aggregate(schema: EntitySchema, request: AggregateRequest, df: DataFrame, dims: dict[str, tuple[EntitySchema, DataFrame]] | None = None) -> Aggregated:
    check_columns(schema, request)
    facts = df.where(scope(schema, request) & predicates(schema, df, request.filters, request.ranges, request.text, strict=True))
    if request.dimension is None:
        keys = list(request.group_by)
        groups = facts.groupBy(*keys).agg(*map(metric, request.metrics)) if keys else facts.agg(*map(metric, request.metrics))
        return Aggregated(top(groups, keys, request) if keys else groups, groups)
    return _rolled_up(schema, request, facts, dims or {})


def _rolled_up(schema: EntitySchema, request: AggregateRequest, facts: DataFrame, dims: dict) -> Aggregated:
    """Partial aggregates by foreign key, then the dimension, then the final ones: what meets the dimension is
    one row per key, not per fact. Averages travel as sums and counts."""
    path = request.dimension
    if schema.need(path.fk).related != path.entity or path.entity not in dims:
        raise invalid(f"{path.fk} doesn't lead to {path.entity}")
    dim_schema, dim = dims[path.entity]
    guard(dim_schema, request.tags, dim_schema.need(path.column).name)
    # the dimension's own row scope holds too
    seen = dim.where(scope(dim_schema, AggregateRequest(dim_schema.namespace, dim_schema.entity, tenant=request.tenant, tags=request.tags)))
    partial, final, out = {"__n": F.count(F.lit(1))}, [], []
    for m in request.metrics:
        if m.op == "count":
            final.append(F.sum("__n").alias(m.alias))
        elif m.op == "avg":
            partial |= {f"__s_{m.field}": F.sum(m.field), f"__c_{m.field}": F.count(m.field)}
            final.append((F.sum(f"__s_{m.field}") / F.sum(f"__c_{m.field}")).alias(m.alias))
        else:
            partial[f"__{m.alias}"] = {"sum": F.sum, "min": F.min, "max": F.max}[m.op](m.field)
            final.append({"sum": F.sum, "min": F.min, "max": F.max}[m.op](f"__{m.alias}").alias(m.alias))
        out.append(m.alias)
    inputs = facts.groupBy(F.col(path.fk).alias("__fk")).agg(*(c.alias(k) for k, c in partial.items()))
    keys = seen.select(F.col(dim_schema.primary_key).alias("__pk"), F.col(path.column).cast("string").alias(path.column))
    joined = inputs.join(keys, F.col("__fk") == F.col("__pk"), "left")
    if request.unknown == "discard":
        joined = joined.where(F.col(path.column).isNotNull())
    elif request.unknown == "error":
        problem = F.raise_error(F.lit(f"1003: rows without {path.column}"))
        joined = joined.withColumn(path.column, F.when(F.col(path.column).isNull(), problem.cast("string")).otherwise(F.col(path.column)))
    else:
        joined = joined.withColumn(path.column, F.coalesce(path.column, F.lit(UNKNOWN)))
    groups = joined.groupBy(path.column).agg(*final).select(path.column, *out)
    return Aggregated(top(groups, [path.column], request), groups, inputs)


def check_input_groups(result: Aggregated, most: int = MOST_INPUT_GROUPS) -> int:
    """Keys that the roll-up went over; more than the limit is an error."""
    n = result.input_groups.limit(most + 1).count() if result.input_groups is not None else 0
    if n > most:
        raise invalid(f"more than {most} keys; narrow the filters")
    return n
