"""Callable tools generated from schemas, and their search."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.aggregate import check_input_groups, plan_aggregate
from lodestone.operators.query import Plan, lookup, plan_query
from lodestone.operators.relations import bundle
from lodestone.plans.errors import NOT_FOUND, UNAUTHORISED, RequestError, invalid
from lodestone.plans.requests import AggregateRequest, QueryRequest, RangeFilter
from lodestone.plans.schema import EntitySchema
from lodestone.sources.registry import describe

PER_ENTITY, LIMIT, MOST = 8, 8, 20
#: What a word of a search is worth where it equals or occurs in a tool's text; the best place counts.
NAME_EQUAL, NAME_IN = 100, 60
ENTITY_EQUAL, ENTITY_IN = 80, 50
FIELD_NAMES_IN, NAMESPACE_IN, FIELD_DESCRIPTIONS_IN, DESCRIPTION_IN = 40, 30, 20, 10


@dataclass(frozen=True)
class Tool:
    name: str
    kind: str
    schema: EntitySchema
    field: str | None = None

    @property
    def description(self) -> str:
        return f"{self.kind} {self.schema.entity}" + (f" by {self.field}" if self.field else "") + (f": {self.schema.description}" if self.schema.description else "")


def generate(schemas: list[EntitySchema]) -> list[Tool]:
    """query, get by key, range, filter and text tools, at most eight an entity; clashing names get the namespace in
    front, and then numbers. Foreign keys have range tools as any number has."""
    out, taken = [], set()
    for s in schemas:
        wanted = [(f"query_{s.entity}", "query", None), (f"get_{s.entity}_by_{s.primary_key}", "get", s.primary_key)]
        wanted += [(f"find_{s.entity}_by_{f.name}_range", "range", f.name) for f in s.fields if f.kind == "numeric" and f.name != s.primary_key]
        wanted += [(f"filter_{s.entity}_by_{f.name}", "filter", f.name) for f in s.fields if f.kind == "tag" and f.name != s.primary_key]
        texts = [f.name for f in s.fields if f.kind == "text"]
        wanted += [(f"search_{s.entity}_by_{'text' if len(texts) == 1 else t}", "text", t) for t in texts]
        for name, kind, field in wanted[:PER_ENTITY]:
            final, n = name, 2
            if final in taken:
                final = f"{s.namespace}_{name}"
            while final in taken:
                final, n = f"{s.namespace}_{name}_{n}", n + 1
            taken.add(final)
            out.append(Tool(final, kind, s, field))
    return out


def request(tool: Tool, args: dict) -> QueryRequest:
    """Arguments as a request."""
    common = {k: args[k] for k in ("fields", "sort_field", "sort_desc", "page", "page_size", "tenant", "tags", "fresh") if k in args}
    s = tool.schema
    if tool.kind == "query":
        return QueryRequest(s.namespace, s.entity, args.get("filters") or {}, args.get("ranges") or (), args.get("text") or {}, **common)
    if tool.kind == "range":
        return QueryRequest(s.namespace, s.entity, ranges=(RangeFilter(tool.field, args.get("min"), args.get("max")),), **common)
    if "value" not in args:
        raise invalid(f"{tool.name} needs a value")
    if tool.kind == "text":
        return QueryRequest(s.namespace, s.entity, text={tool.field: args["value"]}, **common)
    return QueryRequest(s.namespace, s.entity, {tool.field: args["value"]}, **common)


def call(tool: Tool, args: dict, tables: Callable[[str], DataFrame]) -> DataFrame:
    asked = request(tool, args)
    df = tables(tool.schema.entity)
    if tool.kind == "get":
        return lookup(tool.schema, asked, df)
    plan: Plan = plan_query(tool.schema, asked, df)
    return plan.page


def catalogue(spark: SparkSession, tools: list[Tool]) -> DataFrame:
    """One row per tool, with the texts that a search looks at."""
    rows = [(t.name, t.schema.entity, t.schema.namespace, " ".join(f.name for f in t.schema.fields), " ".join(f.description or "" for f in t.schema.fields), t.description) for t in tools]
    return spark.createDataFrame(rows, "name string, entity string, namespace string, field_names string, field_descriptions string, description string")


def tool_score(word: str) -> Column:
    """The best place that one lower-case word is found at."""
    low = {c: F.lower(c) for c in ("name", "entity", "namespace", "field_names", "field_descriptions", "description")}
    held = lambda c: low[c].contains(word)
    places = [
        (low["name"] == word, NAME_EQUAL), (low["entity"] == word, ENTITY_EQUAL), (held("name"), NAME_IN), (held("entity"), ENTITY_IN),
        (held("field_names"), FIELD_NAMES_IN), (held("namespace"), NAMESPACE_IN), (held("field_descriptions"), FIELD_DESCRIPTIONS_IN), (held("description"), DESCRIPTION_IN),
    ]
    return F.coalesce(*(F.when(found, worth) for found, worth in places), F.lit(0))


def search(tools: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(name, score): an exact name alone, else the best by summed word scores. Words are runs of ASCII letters and
    digits and of Chinese characters; a query without any finds nothing, and ``overview`` serves it."""
    limit = min(LIMIT if limit is None or limit < 1 else limit, MOST)
    exact = tools.where(F.col("name") == query.strip()).select("name", F.lit(NAME_EQUAL).alias("score"))
    if not exact.isEmpty():
        return exact
    score = sum((tool_score(w) for w in re.findall("[a-z0-9\u4e00-\u9fa5]+", query.lower())), F.lit(0))
    return tools.select("name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "name").limit(limit)


def overview(tools: DataFrame) -> DataFrame:
    """Tools per entity: what a blank search is answered with."""
    return tools.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("tools"), F.min("name").alias("first"))


def find(tools: list[Tool], name: str) -> Tool:
    for t in tools:
        if t.name == name:
            return t
    raise RequestError(NOT_FOUND, name)


def writable(tags: frozenset[str] | None, operator_tag: str = "operator") -> None:
    """Refuses writes to callers who aren't operators."""
    if not tags or not tags & {operator_tag, "*"}:
        raise RequestError(UNAUTHORISED, f"needs the tag {operator_tag}")


class Toolbox:
    """Tools that exist whatever the schemas are, as functions by name, over tables that ``read`` gives by entity.
    Writes go through ``writable``."""

    def __init__(self, schemas: list[EntitySchema], read: Callable[[str], DataFrame], spark: SparkSession):
        self.schemas, self.read, self.spark = {s.entity: s for s in schemas}, read, spark
        self.made = generate(schemas)
        self.known = {
            "list_entities": self.list_entities, "describe_entity": self.describe_entity, "query_entity": self.query_entity, "get_entity": self.get_entity, "aggregate_entity": self.aggregate_entity,
            "related_entities": self.related_entities, "find_tools": self.find_tools, "call_tool": self.call_tool, "reload_schemas": self.reload_schemas,
        }

    def names(self) -> list[str]:
        return sorted(self.known)

    def call(self, name: str, /, **args):
        if name not in self.known:
            raise RequestError(NOT_FOUND, name)
        return self.known[name](**args)

    def schema(self, entity: str) -> EntitySchema:
        if entity not in self.schemas:
            raise RequestError(NOT_FOUND, entity)
        return self.schemas[entity]

    def tables(self) -> dict[str, tuple[EntitySchema, DataFrame]]:
        return {e: (s, self.read(e)) for e, s in self.schemas.items()}

    def list_entities(self) -> DataFrame:
        return self.spark.createDataFrame([(s.namespace, e, s.primary_key, len(s.fields)) for e, s in sorted(self.schemas.items())], "namespace string, entity string, key string, fields int")

    def describe_entity(self, entity: str) -> DataFrame:
        return describe(self.schema(entity), self.read(entity))

    def query_entity(self, entity: str, **request) -> DataFrame:
        s = self.schema(entity)
        return plan_query(s, QueryRequest(s.namespace, entity, **request), self.read(entity)).page

    def get_entity(self, entity: str, key, **request) -> DataFrame:
        s = self.schema(entity)
        return lookup(s, QueryRequest(s.namespace, entity, {s.primary_key: key}, **request), self.read(entity))

    def aggregate_entity(self, entity: str, **request) -> DataFrame:
        s = self.schema(entity)
        asked = AggregateRequest(s.namespace, entity, **request)
        dims = {asked.dimension.entity: self.tables()[asked.dimension.entity]} if asked.dimension is not None and asked.dimension.entity in self.schemas else {}
        made = plan_aggregate(s, asked, self.read(entity), dims)
        check_input_groups(made)
        return made.rows

    def related_entities(self, entity: str, key, **scope) -> list[dict]:
        return bundle(self.tables(), entity, key, **scope)

    def find_tools(self, query: str = "", limit: int | None = None) -> DataFrame:
        every = catalogue(self.spark, self.made)
        return search(every, query, limit) if query.strip() else overview(every)

    def call_tool(self, name: str, **args) -> DataFrame:
        return call(find(self.made, name), args, self.read)

    def reload_schemas(self, schemas: list[EntitySchema], tags: frozenset[str] | None = None) -> int:
        writable(tags)
        self.schemas, self.made = {s.entity: s for s in schemas}, generate(schemas)
        return len(schemas)


def latency(timings: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 and p99 of timings per entity."""
    p = lambda q: F.percentile(value, F.lit(q))
    return timings.groupBy(by).agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
