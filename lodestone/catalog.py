"""Entities over the star-schema tables, as the registered queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans.schema import EntitySchema, FieldSchema
from lodestone.sources.tables import parquet

NS = "shop"


def _f(name: str, type_: str = "STRING", **more) -> FieldSchema:
    return FieldSchema(name, type_, more.pop("indexed", True), **more)


REGION = EntitySchema(NS, "region", "r_regionkey", (_f("r_regionkey", "INT"), _f("r_name")))
NATION = EntitySchema(NS, "nation", "n_nationkey", (_f("n_nationkey", "INT"), _f("n_name"), _f("n_regionkey", "INT", related="region")))
CUSTOMER = EntitySchema(NS, "customer", "c_custkey", (_f("c_custkey", "LONG"), _f("c_name"), _f("c_nationkey", "INT", related="nation"), _f("c_acctbal", "DOUBLE"), _f("c_mktsegment")))
SUPPLIER = EntitySchema(NS, "supplier", "s_suppkey", (_f("s_suppkey", "LONG"), _f("s_name"), _f("s_nationkey", "INT", related="nation"), _f("s_acctbal", "DOUBLE")))
PART = EntitySchema(NS, "part", "p_partkey", (_f("p_partkey", "LONG"), _f("p_name", index="text"), _f("p_brand"), _f("p_type"), _f("p_size", "INT"), _f("p_retailprice", "DOUBLE")))
ORDERS = EntitySchema(NS, "orders", "o_orderkey", (
    _f("o_orderkey", "LONG"), _f("o_custkey", "LONG", related="customer"), _f("o_orderstatus"), _f("o_totalprice", "DOUBLE"), _f("o_orderdate", "TIMESTAMP"), _f("o_orderpriority"),
))
LINEITEM = EntitySchema(NS, "lineitem", "l_orderkey", (
    _f("l_orderkey", "LONG", related="orders"), _f("l_partkey", "LONG", related="part"), _f("l_suppkey", "LONG", related="supplier"), _f("l_linenumber", "INT"),
    _f("l_quantity", "DOUBLE"), _f("l_extendedprice", "DOUBLE"), _f("l_discount", "DOUBLE"), _f("l_tax", "DOUBLE"), _f("l_returnflag"), _f("l_linestatus"), _f("l_shipdate", "TIMESTAMP"),
))
EVENTS = EntitySchema(NS, "events", "event_id", (_f("event_id", "LONG"), _f("ts", "TIMESTAMP"), _f("user_id", "LONG"), _f("event_type"), _f("value", "DOUBLE"), _f("props", indexed=False)))
DOCUMENTS = EntitySchema(NS, "documents", "doc_id", (_f("doc_id", "LONG"), _f("text", index="text"), _f("lang"), _f("source"), _f("n_chars", "LONG")))

ALL = {s.entity: s for s in (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS)}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, tuple[EntitySchema, DataFrame]]:
    return {n: (ALL[n], parquet(spark, sf_dir, n)) for n in names}
