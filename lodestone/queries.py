"""One query per operator, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import catalog
from lodestone.catalog import NS, tables
from lodestone.functions import text as tx
from lodestone.functions.vectors import cosine
from lodestone.operators import aggregate, cache, memory, query, reconcile, relations, tools, topk
from lodestone.plans.requests import AggregateRequest, QueryRequest, RangeFilter
from lodestone.plans.schema import FieldSchema
from lodestone.sources import registry
from lodestone.sources.tables import parquet
from lodestone.streaming import cdc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LATER: dict[str, Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """``sql`` may be a function where it is made of what stands further down."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if callable(sql):
            LATER[name] = sql
        elif sql:
            ORACLES[name] = sql
        return f

    return put


def matched(name: str, entity: str, sql: str, columns: list[str], **request) -> None:
    """A whole filtered table, without its page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema, df = tables(spark, sf_dir, entity)[entity]
        return query.plan_query(schema, QueryRequest(NS, entity, **request), df).matched.select(*columns)

    register(name, sql)(run)


def paged(name: str, entity: str, sql: str, schema=None, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, df = tables(spark, sf_dir, entity)[entity]
        return query.plan_query(schema or own, QueryRequest(NS, entity, **request), df).page

    register(name, sql)(run)


def aggregated(name: str, entity: str, sql: str, rounded: tuple[str, ...] = (), dims: tuple[str, ...] = (), schema=None, part: str = "rows", **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, df = tables(spark, sf_dir, entity)[entity]
        out = aggregate.plan_aggregate(schema or own, AggregateRequest(NS, entity, **request), df, tables(spark, sf_dir, *dims))
        df = getattr(out, part)
        return df.select(*(F.round(c, 2).alias(c) if c in rounded else F.col(c) for c in df.columns))

    register(name, sql)(run)


def computed(name: str, table: str, sql: str, **columns) -> None:
    """Columns over a whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parquet(spark, sf_dir, table).select(*(c().alias(k) for k, c in columns.items()))

    register(name, sql)(run)


col = F.col
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+')"

# --- sources ---------------------------------------------------------------------------------------------------

paged("src_10_pk_lookup", "orders", "SELECT * FROM orders WHERE o_orderkey = 7", filters={"o_orderkey": 7})
paged("src_11_index_scan", "orders", "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 20", filters={"o_orderstatus": "F"}, sort_field="o_totalprice")
paged("src_12_full_scan", "part", "SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 20", sort_field="p_name")


@register("src_4_describe", """SELECT 'nation' AS entity, field, type, kind, related, (SELECT count(*) FROM nation) AS docs
FROM (VALUES ('n_nationkey', 'INT', 'numeric', NULL), ('n_name', 'STRING', 'tag', NULL), ('n_regionkey', 'INT', 'numeric', 'region')) t(field, type, kind, related)""")
def describe(spark, sf_dir):
    return registry.describe(*tables(spark, sf_dir, "nation")["nation"])


@register("src_5_generate", """SELECT * FROM (VALUES ('nation', 'n_nationkey', 'INT', 'numeric', NULL), ('nation', 'n_name', 'STRING', 'tag', NULL), ('nation', 'n_regionkey', 'INT', 'numeric', 'region'),
('customer', 'c_custkey', 'LONG', 'numeric', NULL), ('customer', 'c_name', 'STRING', 'tag', NULL), ('customer', 'c_nationkey', 'INT', 'numeric', 'nation'), ('customer', 'c_acctbal', 'DOUBLE', 'numeric', NULL),
('customer', 'c_mktsegment', 'STRING', 'tag', NULL), ('region', 'r_regionkey', 'INT', 'numeric', NULL), ('region', 'r_name', 'STRING', 'tag', NULL)) t(entity, field, type, kind, related)""")
def generated(spark, sf_dir):
    dfs = {n: df for n, (_, df) in tables(spark, sf_dir, "region", "nation", "customer").items()}
    made = registry.generate(NS, dfs, {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey"})
    return spark.createDataFrame([(s.entity, f.name, f.type, f.kind, f.related) for s in made.values() for f in s.fields], "entity string, field string, type string, kind string, related string")


@register("src_6_infer_keys", """SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'high'), ('customer', 'c_nationkey', 'nation', 'high'), ('supplier', 's_nationkey', 'nation', 'high'),
('nation', 'n_regionkey', 'region', 'high'), ('lineitem', 'l_suppkey', 'supplier', 'high'), ('lineitem', 'l_partkey', 'part', 'explicit'), ('lineitem', 'l_orderkey', 'orders', 'high')) t(entity, field, target, confidence)""")
def inferred(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    dfs = {n: df for n, (_, df) in tables(spark, sf_dir, *names).items()}
    keys = {n: catalog.ALL[n].primary_key for n in names if n != "lineitem"} | {"lineitem": "l_linenumber"}
    return spark.createDataFrame(registry.infer_keys(dfs, keys, {("lineitem", "l_partkey"): "part"}), "entity string, field string, target string, confidence string")


LOG_ROWS = """SELECT event_id, '{"op":"' || CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END || '"}' AS body FROM events"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes made of events: sign-ups create, errors delete, anything else updates. Every 97th is blank and every
    101st broken."""
    e = parquet(spark, sf_dir, "events")
    row = F.struct("user_id", "event_type", "value")
    op = F.when(col("event_type") == "signup", "c").when(col("event_type") == "error", "d").otherwise("u")
    body = F.to_json(F.struct(op.alias("op"), F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after")))
    body = F.when(col("event_id") % 97 == 0, " ").when(col("event_id") % 101 == 0, F.concat(F.lit("{"), body)).otherwise(body)
    return e.select(col("event_id").alias("seq"), body.alias("body"))


ROW = "user_id bigint, event_type string, value double"


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return cdc.parse(change_log(spark, sf_dir), StructType.fromDDL(ROW))


CHANGES = "(SELECT event_id AS seq, user_id, event_type, value, event_type = 'error' AS deleted FROM events WHERE event_id % 97 != 0 AND event_id % 101 != 0)"


@register("src_8_envelope", """SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'SKIP' WHEN event_id % 101 = 0 THEN 'FAIL' ELSE 'WRITE' END AS kind,
CASE WHEN event_id % 97 = 0 OR event_id % 101 = 0 THEN NULL WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op FROM events""")
def envelopes(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("seq", "kind", F.when(col("kind") == "WRITE", col("op")).alias("op"))


@register("src_13_multi_get", "SELECT k AS n_nationkey, n_name, n_regionkey, o AS ord FROM (VALUES (0, 9), (1, 3), (2, 99), (3, 7)) t(o, k) LEFT JOIN nation ON n_nationkey = k")
def multi_get(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "nation")["nation"]
    keyed = spark.createDataFrame([(9, 0), (3, 1), (99, 2), (7, 3)], "n_nationkey int, ord int")
    return query.multi_get(df, "n_nationkey", [9, 3, 99, 7]).join(F.broadcast(keyed), "n_nationkey")


@register("snk_3_dead_letters", "SELECT 'shop' AS ns, 'events' AS entity, CAST(event_id AS VARCHAR) AS \"msgId\", '3' AS \"deliveryCount\", 'broken JSON' AS error FROM events WHERE event_id % 97 != 0 AND event_id % 101 = 0")
def dead_letters(spark, sf_dir):
    failed = parsed_log(spark, sf_dir).where("kind = 'FAIL'")
    return cdc.dead_letter(failed, NS, "events", "events", "apply", "seq", "body", F.lit("broken JSON"), F.lit(3)).select("ns", "entity", "msgId", "deliveryCount", "error")


@register("snk_4_side_writes", lambda: f"""WITH {embed_sql('doc_id', 'text', 'documents')}, vectors AS (SELECT doc_id, list(round(coalesce(x, 0), 5) ORDER BY slot) AS vector
  FROM (SELECT doc_id, unnest(range(256)) AS slot FROM documents) LEFT JOIN entries USING (doc_id, slot) GROUP BY doc_id)
SELECT doc_id AS id, sha256(text) AS memory_hash, array_to_string({TOKENS}, ' ') AS lex, source AS owner, vector FROM documents JOIN vectors USING (doc_id)""")
def side_writes(spark, sf_dir):
    made = memory.remembered(parquet(spark, sf_dir, "documents"), "doc_id", "text", col("source"))
    return made.select("id", "memory_hash", "lex", "owner", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


# --- filters and projections -----------------------------------------------------------------------------------

paged("flt_1_project", "customer", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_custkey LIMIT 200", fields=("c_mktsegment", "c_custkey"), page_size=200)
matched("flt_3_eq_tag", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", ["c_custkey"], filters={"c_mktsegment": "BUILDING"})
matched("flt_4_eq_numeric", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17", ["l_orderkey", "l_linenumber"], filters={"l_quantity": "17"})
matched("flt_5_eq_text", "documents", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'the') AND list_contains({TOKENS}, 'idiot')", ["doc_id"], filters={"text": "the Idiot"})
matched("flt_6_in_tag", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", ["o_orderkey"], filters={"o_orderpriority": ["1-URGENT", "2-HIGH"]})
matched("flt_7_in_numeric", "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)", ["p_partkey"], filters={"p_size": [1, 7, 49]})
matched("flt_8_range", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", ["o_orderkey"], ranges=(RangeFilter("o_totalprice", 1000, 50000),))
matched("flt_8_open_range", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0", ["c_custkey"], ranges=(RangeFilter("c_acctbal", 0),))
matched("flt_9_text_and", "documents", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'of') AND list_contains({TOKENS}, 'with')", ["doc_id"], text={"text": "with of"})
matched("flt_10_date_literal", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-05 23:59:59.999'", ["event_id"], ranges=(RangeFilter("ts", "2024-01-03", "2024-01-05"),))
matched("flt_10_offset_literal", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 04:00:00'", ["event_id"], ranges=(RangeFilter("ts", "2024-01-03T12:00:00+08:00"),))
matched("flt_11_conjunction", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.05 AND l_quantity <= 10", ["l_orderkey", "l_linenumber"], filters={"l_returnflag": "R"}, ranges=(RangeFilter("l_discount", 0.02, 0.05), RangeFilter("l_quantity", None, 10)))
matched("flt_11_match_all", "region", "SELECT r_regionkey FROM region", ["r_regionkey"])
matched("flt_12_residual_string", "events", "SELECT event_id FROM events WHERE CAST(props AS VARCHAR) = '{\"k\": 1}'", ["event_id"], filters={"props": '{"k": 1}'})

TENANT = replace(catalog.CUSTOMER, tenant_field="c_mktsegment")
TAGGED = replace(catalog.ORDERS, access_field="o_orderpriority")
MASKED = catalog.CUSTOMER.with_field(FieldSchema("c_acctbal", "DOUBLE", True, tags=frozenset({"finance"})))
paged("gov_1_tenant", "customer", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100", schema=TENANT, tenant="BUILDING", page_size=100)
paged("gov_2_row_tags", "orders", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderkey LIMIT 100", schema=TAGGED, tags=frozenset({"1-URGENT", "5-LOW"}), page_size=100)
paged("gov_2_no_tags", "orders", "SELECT * FROM orders WHERE false", schema=TAGGED)
paged("gov_2_narrowed", "orders", "SELECT * FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 20", schema=TAGGED, tags=frozenset({"1-URGENT", "5-LOW"}), filters={"o_orderpriority": "5-LOW"})
paged("gov_3_masked", "customer", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50", schema=MASKED, tags=frozenset({"sales"}), page_size=50)
paged("gov_3_unmasked", "customer", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50", schema=MASKED, tags=frozenset({"finance"}), page_size=50)
aggregated("gov_4_visible_metric", "customer", "SELECT c_nationkey, round(max(c_acctbal), 2) AS max_c_acctbal FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", ("max_c_acctbal",), schema=MASKED, tags=frozenset({"finance"}), group_by=("c_nationkey",), metrics=(("max", "c_acctbal"),), limit=100)

# --- sorting and paging ----------------------------------------------------------------------------------------

paged("srt_1_default_key", "orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
paged("srt_1_desc", "orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", sort_field="o_totalprice", sort_desc=True)
paged("srt_3_text_sort", "part", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey LIMIT 30", fields=("p_partkey", "p_name"), sort_field="p_name", sort_desc=True, page_size=30)
paged("lim_1_page", "orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40", sort_field="o_totalprice", sort_desc=True, page=3)
paged("lim_1_past_end", "region", "SELECT * FROM region WHERE false", page=9)


@register("srt_2_null_order", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 200")
def null_order(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "customer")["customer"]
    holed = df.withColumn("c_acctbal", F.when(col("c_custkey") % 3 != 0, col("c_acctbal")))
    return query.plan_query(schema, QueryRequest(NS, "customer", sort_field="c_acctbal", sort_desc=True, page_size=200, fields=("c_custkey", "c_acctbal")), holed).page


@register("lim_2_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def total(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "orders")["orders"]
    return query.plan_query(schema, QueryRequest(NS, "orders", {"o_orderstatus": "O"}), df).matched.agg(F.count(F.lit(1)).alias("total"))


# --- aggregates ------------------------------------------------------------------------------------------------

for op in ("count", "sum", "avg", "min", "max"):
    alias = "count" if op == "count" else f"{op}_l_extendedprice"
    expr = "count(*)" if op == "count" else f"round({op}(l_extendedprice), 2)"
    aggregated(f"agg_{'count sum avg min max'.split().index(op) + 1}_{op}", "lineitem", f"SELECT l_returnflag, {expr} AS {alias} FROM lineitem GROUP BY 1", (alias,) if op != "count" else (), group_by=("l_returnflag",), metrics=((op, "l_extendedprice"),) if op != "count" else (("count",),))
aggregated("agg_6_multi", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_discount), 2) AS avg_l_discount FROM lineitem GROUP BY 1, 2", ("sum_l_quantity", "avg_l_discount"), group_by=("l_returnflag", "l_linestatus"), metrics=(("count",), ("sum", "l_quantity"), ("avg", "l_discount")))
aggregated("agg_7_global", "orders", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders", ("sum_o_totalprice",), metrics=(("count",), ("sum", "o_totalprice")))
aggregated("agg_8_default_metric", "orders", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1", group_by=("o_orderpriority",))
aggregated("agg_9_filtered", "orders", "SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999' AND o_orderpriority = '1-URGENT' GROUP BY 1", group_by=("o_orderstatus",), filters={"o_orderpriority": "1-URGENT"}, ranges=(RangeFilter("o_orderdate", "1996-01-01", "1996-12-31"),))
aggregated("agg_10_top_n", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10", ("sum_o_totalprice",), group_by=("o_custkey",), metrics=(("sum", "o_totalprice"),), sort_by="sum_o_totalprice", limit=10)
aggregated("agg_11_all_groups", "orders", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1", part="groups", group_by=("o_custkey",), limit=1)
DIMENSION = "SELECT COALESCE(c.c_mktsegment, 'UNKNOWN') AS c_mktsegment, count(*) AS count, round(sum(o.o_totalprice), 2) AS sum_o_totalprice, round(avg(o.o_totalprice), 2) AS avg_o_totalprice, round(min(o.o_totalprice), 2) AS min_o_totalprice, round(max(o.o_totalprice), 2) AS max_o_totalprice FROM orders o {join} JOIN customer c ON o.o_custkey = c.c_custkey {more} GROUP BY 1"
ROLL_UP = {"group_by": ("o_custkey->customer.c_mktsegment",), "metrics": (("count",), ("sum", "o_totalprice"), ("avg", "o_totalprice"), ("min", "o_totalprice"), ("max", "o_totalprice")), "sort_by": "sum_o_totalprice"}
ROUNDED = ("sum_o_totalprice", "avg_o_totalprice", "min_o_totalprice", "max_o_totalprice")
aggregated("agg_12_dimension", "orders", DIMENSION.format(join="LEFT", more=""), ROUNDED, ("customer",), **ROLL_UP)


def _with_gaps(policy: str) -> Query:
    def run(spark, sf_dir):
        schema, df = tables(spark, sf_dir, "orders")["orders"]
        dim_schema, dim = tables(spark, sf_dir, "customer")["customer"]
        out = aggregate.plan_aggregate(schema, AggregateRequest(NS, "orders", unknown=policy, **ROLL_UP), df, {"customer": (dim_schema, dim.where("c_mktsegment != 'BUILDING'"))}).rows
        return out.select(*(F.round(c, 2).alias(c) if c in ROUNDED else col(c) for c in out.columns))

    return run


register("agg_13_unknown_keep", DIMENSION.format(join="LEFT", more="AND c.c_mktsegment != 'BUILDING'"))(_with_gaps("keep"))
register("agg_13_unknown_discard", DIMENSION.format(join="INNER", more="AND c.c_mktsegment != 'BUILDING'"))(_with_gaps("discard"))


@register("agg_14_input_groups", "SELECT count(DISTINCT o_custkey) AS input_groups FROM orders WHERE o_orderstatus = 'F'")
def input_groups(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "orders")["orders"]
    out = aggregate.plan_aggregate(schema, AggregateRequest(NS, "orders", filters={"o_orderstatus": "F"}, **ROLL_UP), df, tables(spark, sf_dir, "customer"))
    return out.input_groups.agg(F.count(F.lit(1)).alias("input_groups"))


@register("agg_16_match_count", f"SELECT count(*) AS n FROM documents WHERE list_contains({TOKENS}, 'und')")
def match_count(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "documents")["documents"]
    return query.plan_query(schema, QueryRequest(NS, "documents", text={"text": "und"}), df).matched.agg(F.count(F.lit(1)).alias("n"))


aggregated("agg_17_governed", "customer", "SELECT c_nationkey, count(*) AS count FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", schema=TENANT, tenant="MACHINERY", group_by=("c_nationkey",))

# --- joins -----------------------------------------------------------------------------------------------------


@register("jn_1_forward", "SELECT c_custkey AS source_key, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def forward(spark, sf_dir):
    return relations.forward(tables(spark, sf_dir, "customer", "nation"), "customer", "c_nationkey")


@register("jn_2_reverse", "SELECT n_nationkey AS source_key, s.* FROM supplier s JOIN nation ON s_nationkey = n_nationkey")
def reverse(spark, sf_dir):
    return relations.reverse(tables(spark, sf_dir, "nation", "supplier"), "nation", "supplier", "s_nationkey")


@register("jn_2_totals", """SELECT n_nationkey AS source_key, 'customer.c_nationkey' AS relation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS total FROM nation
UNION ALL SELECT n_nationkey, 'supplier.s_nationkey', (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation""")
def reverse_totals(spark, sf_dir):
    return relations.relation_counts(tables(spark, sf_dir, "nation", "customer", "supplier"), "nation")


@register("jn_3_bundle", """SELECT 'n_regionkey->region' AS relation, 'forward' AS direction, count(*) AS n, CAST(NULL AS BIGINT) AS total FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'customer.c_nationkey', 'reverse', least(20, count(*)), count(*) FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'supplier.s_nationkey', 'reverse', least(20, count(*)), count(*) FROM supplier WHERE s_nationkey = 3""")
def bundle(spark, sf_dir):
    found = relations.bundle(tables(spark, sf_dir, "nation", "region", "customer", "supplier"), "nation", 3)
    out = None
    for r in found:
        part = r["rows"].agg(F.count(F.lit(1)).alias("n")).select(F.lit(r["relation"]).alias("relation"), F.lit(r["direction"]).alias("direction"), "n", F.lit(r.get("total")).cast("long").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


aggregated("jn_4_dimension_region", "nation", "SELECT r_name, count(*) AS count FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", dims=("region",), group_by=("n_regionkey->region.r_name",))
aggregated("jn_4_dimension_brand", "lineitem", "SELECT p_brand, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 100", ("sum_l_quantity",), ("part",), group_by=("l_partkey->part.p_brand",), metrics=(("count",), ("sum", "l_quantity")), sort_by="sum_l_quantity", limit=100)


@register("jn_5_carried_fill", """SELECT coalesce(CASE WHEN o_orderkey % 5 != 0 THEN o_orderstatus END, l_linestatus) AS pay, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 3 != 0 GROUP BY 1""")
def carried_fill(spark, sf_dir):
    """Some parents are absent, others have no value: children keep their own."""
    t = tables(spark, sf_dir, "lineitem", "orders")
    parents = t["orders"][1].where("o_orderkey % 3 != 0").withColumn("o_orderstatus", F.when(col("o_orderkey") % 5 != 0, col("o_orderstatus")))
    wide = cdc.fill_carried(t["lineitem"][1].withColumn("pay", col("l_linestatus")), parents, "l_orderkey", "o_orderkey", "o_orderstatus", "pay")
    return wide.groupBy("pay").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@register("jn_6_carried_propagate", """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS pay, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def carried_propagate(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "orders")
    wide = cdc.fill_carried(t["lineitem"][1], t["orders"][1], "l_orderkey", "o_orderkey", "o_orderstatus", "pay")
    changed = t["orders"][1].where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return cdc.propagate(wide, changed, "l_orderkey", "o_orderkey", "o_orderstatus", "pay").groupBy("pay").agg(F.count(F.lit(1)).alias("n"))


def drifted(orders: DataFrame) -> DataFrame:
    """A projection that lost, gained and changed rows."""
    kept = orders.where("o_orderkey % 11 != 0")
    changed = kept.withColumn("o_totalprice", F.when(col("o_orderkey") % 7 == 0, col("o_totalprice") + 1).otherwise(col("o_totalprice")))
    return changed.unionByName(orders.where("o_orderkey % 13 = 0").withColumn("o_orderkey", -col("o_orderkey") - 1))


RECON = """SELECT o_orderkey, 'missing' AS status, CAST([] AS VARCHAR[]) AS fields FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'mismatched', ['o_totalprice'] FROM orders WHERE o_orderkey % 11 != 0 AND o_orderkey % 7 = 0
UNION ALL SELECT -o_orderkey - 1, 'orphan', [] FROM orders WHERE o_orderkey % 13 = 0"""


@register("jn_7_reconcile", RECON)
def reconciled(spark, sf_dir):
    orders = parquet(spark, sf_dir, "orders")
    return reconcile.reconcile(orders, drifted(orders), "o_orderkey")


@register("t_7_repair", "SELECT * FROM orders")
def repaired(spark, sf_dir):
    orders = parquet(spark, sf_dir, "orders")
    d = drifted(orders)
    return reconcile.repair(orders, d, reconcile.reconcile(orders, d, "o_orderkey"), "o_orderkey")


register("set_1_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0")(lambda spark, sf_dir: reconcile.missing(o := parquet(spark, sf_dir, "orders"), drifted(o), "o_orderkey"))
register("set_1_orphans", "SELECT -o_orderkey - 1 AS o_orderkey FROM orders WHERE o_orderkey % 13 = 0")(lambda spark, sf_dir: reconcile.orphans(o := parquet(spark, sf_dir, "orders"), drifted(o), "o_orderkey"))
VECTOR = "(SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE vec_id = 0)"


def vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return parquet(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@register("top_1_knn", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score, CAST(row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS INTEGER) AS rank FROM embeddings, {VECTOR} ORDER BY rank LIMIT 10")
def nearest(spark, sf_dir):
    return topk.knn(parquet(spark, sf_dir, "embeddings"), "vec_id", "embedding", vector(spark, sf_dir), 10).select("id", F.round("score", 4).alias("score"), "rank")


@register("m_2_filtered_knn", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, {VECTOR} WHERE label = 1 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 5")
def nearest_in(spark, sf_dir):
    return topk.knn(parquet(spark, sf_dir, "embeddings"), "vec_id", "embedding", vector(spark, sf_dir), 5, col("label") == 1).select("id", F.round("score", 4).alias("score"))


def bm25_sql(terms: list[str], cte: str = "scored") -> str:
    tf = ", ".join(f"CAST(len(list_filter(tk, lambda x: x = '{t}')) AS DOUBLE) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN t{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(len(terms)))
    some = " OR ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"tok AS (SELECT doc_id, {TOKENS} AS tk FROM documents), tfs AS (SELECT doc_id, len(tk) AS dl, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM tfs), {cte} AS (SELECT doc_id AS id, {score} AS score FROM tfs, st WHERE {some})"


@register("top_2_bm25", f"WITH {bm25_sql(['idiot', 'clown', 'the'])} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 12")
def lexical(spark, sf_dir):
    return topk.bm25(parquet(spark, sf_dir, "documents"), "doc_id", "text", "idiot clown the", 12).select("id", F.round("score", 6).alias("score"))


@register("m_6_keyword_all", f"WITH {bm25_sql(['license', 'und'])} SELECT id, round(score, 6) AS score FROM scored")
def keyword_all(spark, sf_dir):
    return topk.bm25(parquet(spark, sf_dir, "documents"), "doc_id", "text", "license und", None).select("id", F.round("score", 6).alias("score"))


HYBRID = f"""WITH {bm25_sql(['the', 'clown'])},
dense AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS rank FROM embeddings, {VECTOR} QUALIFY rank <= 12),
lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 12)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY id"""


@register("set_2_rrf", HYBRID)
def fused(spark, sf_dir):
    dense = topk.knn(parquet(spark, sf_dir, "embeddings"), "vec_id", "embedding", vector(spark, sf_dir), 12)
    lex = topk.bm25(parquet(spark, sf_dir, "documents"), "doc_id", "text", "the clown", 12)
    return topk.rrf([dense, lex]).select("id", F.round("score", 9).alias("score"))


QUALIFIED = HYBRID.replace("SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM", "SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM")


@register("m_7_hybrid", QUALIFIED + " ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10")
def hybrid(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents")
    e = parquet(spark, sf_dir, "embeddings")
    # vectors without a document take part, as they do in the channels
    m = d.select(col("doc_id").alias("id"), col("text").alias("content"), col("source").alias("owner")).join(e.select(col("vec_id").alias("id"), col("embedding").alias("vector")), "id", "full_outer")
    return memory.search(m, "the clown", vector(spark, sf_dir), limit=10).select("id", F.round("score", 9).alias("score"))


register("top_3_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 15")(lambda spark, sf_dir: topk.recent(parquet(spark, sf_dir, "events"), "ts", "event_id", 15).select("event_id", "ts"))
register("jn_8_fetch", f"WITH {bm25_sql(['idiot'])}, best AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10) SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM best JOIN documents ON doc_id = id WHERE lang = 'en'")(
    lambda spark, sf_dir: topk.fetch(topk.bm25(d := parquet(spark, sf_dir, "documents"), "doc_id", "text", "idiot", 10), d, "doc_id", "lang", "en").select("doc_id", "source", "rank")
)
register("set_3_hash_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY sha256(text)")(
    lambda spark, sf_dir: parquet(spark, sf_dir, "documents").groupBy(tx.sha256_hex(col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
)

# --- scalar functions ------------------------------------------------------------------------------------------

computed("fn_1_lex_tokens", "documents", f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, array_to_string({TOKENS}, '|') AS t FROM documents", doc_id=lambda: col("doc_id"), n=lambda: F.size(tx.lex_tokens(col("text"))), t=lambda: F.array_join(tx.lex_tokens(col("text")), "|"))
computed("fn_2_lex_text", "part", r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{Nd}]+'), ' ') AS t FROM part", p_partkey=lambda: col("p_partkey"), t=lambda: tx.lex_text(col("p_name")))
computed("fn_3_or_query", "documents", f"SELECT doc_id, array_to_string(({TOKENS})[1:24], '|') AS q FROM documents", doc_id=lambda: col("doc_id"), q=lambda: tx.or_query(col("text")))
computed("fn_4_sha256", "documents", "SELECT doc_id, sha256(text) AS h FROM documents", doc_id=lambda: col("doc_id"), h=lambda: tx.sha256_hex(col("text")))
computed("fn_8_digit_slots", "documents", r"SELECT doc_id, list_sort(regexp_extract_all(text, '\d+')) AS s FROM documents", doc_id=lambda: col("doc_id"), s=lambda: tx.digit_slots(col("text")))
computed("fn_9_slot_consistent", "documents", r"SELECT doc_id, list_sort(regexp_extract_all(text, '\d+')) = list_sort(regexp_extract_all(source, '\d+')) AS same FROM documents", doc_id=lambda: col("doc_id"), same=lambda: tx.slot_consistent(col("text"), col("source")))
computed("fn_10_model_tag", "documents", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'none' ELSE substr(sha256(source), 1, 8) END AS tag FROM documents", doc_id=lambda: col("doc_id"), tag=lambda: tx.model_tag(F.when(col("source") != "src3", F.concat(F.lit("  "), col("source"), F.lit(" ")))))
computed("fn_11_fresh", "conversations", "SELECT conv_id, turn, coalesce(contains(text, 'Th') OR contains(text, 'live'), false) AS named, conv_id % 7 = 0 AND turn % 2 = 0 AS usual FROM conversations", conv_id=lambda: col("conv_id"), turn=lambda: col("turn"),
         named=lambda: tx.is_fresh_sensitive(col("text"), ("Th", "live")), usual=lambda: tx.is_fresh_sensitive(F.concat(F.coalesce("text", F.lit("")), F.when((col("conv_id") % 7 == 0) & (col("turn") % 2 == 0), "订单 今天").otherwise("now, today"))))
computed("fn_14_values_equal", "orders", "SELECT o_orderkey, true AS a, o_orderkey % 2 = 0 AS b, false AS c, o_totalprice = round(o_totalprice) AS d, o_orderkey % 3 = 0 AS e FROM orders", o_orderkey=lambda: col("o_orderkey"), a=lambda: tx.values_equal(col("o_orderkey").cast("string"), F.concat(col("o_orderkey").cast("string"), F.lit(".00"))),
         b=lambda: tx.values_equal((col("o_orderkey") % 2).cast("string"), F.lit("0")), c=lambda: tx.values_equal(F.concat(col("o_orderkey").cast("string"), F.lit(".12345678901")), F.concat(col("o_orderkey").cast("string"), F.lit(".12345678902"))),
         d=lambda: tx.values_equal(col("o_totalprice").cast("string"), F.round("o_totalprice").cast("string")), e=lambda: tx.values_equal(F.when(col("o_orderkey") % 3 != 0, col("o_orderstatus")), F.lit(None).cast("string")))
computed("fn_15_normalize", "events", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS t FROM events", event_id=lambda: col("event_id"), t=lambda: tx.normalize_scalar(col("ts"), "timestamp_ntz"))
computed("fn_16_unwrap", "events", "SELECT event_id, event_type AS a, event_type AS b FROM events", event_id=lambda: col("event_id"), a=lambda: tx.unwrap_json(F.to_json(F.array("event_type"))), b=lambda: tx.unwrap_json(col("event_type")))
computed("fn_18_usage", "documents", "SELECT doc_id, CAST(least(100, floor(length(text) * 100 / 8000)) AS INTEGER) AS pct FROM documents", doc_id=lambda: col("doc_id"), pct=lambda: tx.usage_percent(F.char_length("text")))


@register("fn_5_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS c FROM embeddings, {VECTOR}")
def cosines(spark, sf_dir):
    q = F.array(*(F.lit(float(x)) for x in vector(spark, sf_dir)))
    return parquet(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(col("embedding"), q), 6).alias("c"))


def embed_sql(key: str, text: str, table: str) -> str:
    """Common table expressions that end in entries ({key}, slot, x) of the hashed embedding."""
    return rf"""low AS (SELECT {key}, regexp_replace(lower(coalesce({text}, '')), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM {table}),
term AS (SELECT {key}, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS t FROM low
  UNION ALL SELECT {key}, substr(t, i, 2) FROM (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS i FROM low) WHERE NOT regexp_matches(substr(t, i, 1), '[a-z0-9]')),
tf AS (SELECT {key}, t, count(*) AS f FROM term GROUP BY ALL),
dl AS (SELECT {key}, count(*) AS dl FROM term GROUP BY ALL),
h AS (SELECT {key}, f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / 24)) AS w, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(unicode(c) AS BIGINT) FOR c IN string_split(t, '')]), lambda a, c: (a * 31 + c) % 4294967296) % 256 AS slot FROM tf JOIN dl USING ({key})),
s AS (SELECT {key}, slot, sum(w) AS w FROM h GROUP BY ALL),
entries AS (SELECT {key}, CAST(slot AS INTEGER) AS slot, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS x FROM s)"""


register("fn_6_bm25_embed", f"WITH {embed_sql('p_partkey', 'p_name', 'part')} SELECT p_partkey, slot, round(x, 6) AS x FROM entries")(
    lambda spark, sf_dir: tx.bm25_entries(parquet(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("x", F.round("x", 6))
)
register("fn_6_other_scripts", f"WITH {embed_sql('doc_id', 'text', 'documents')} SELECT doc_id, slot, round(x, 6) AS x FROM entries")(
    lambda spark, sf_dir: tx.bm25_entries(parquet(spark, sf_dir, "documents"), "doc_id", "text").withColumn("x", F.round("x", 6))
)

TOOL_SCORES = """WITH t AS (SELECT *, 'shop' AS namespace, CASE entity WHEN 'orders' THEN 'o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority' ELSE 'c_custkey c_name c_nationkey c_acctbal c_mktsegment' END AS fields
  FROM (VALUES ('query_orders', 'orders', 'query orders'), ('get_orders_by_o_orderkey', 'orders', 'get orders by o_orderkey'), ('find_orders_by_o_custkey_range', 'orders', 'range orders by o_custkey'),
    ('find_orders_by_o_totalprice_range', 'orders', 'range orders by o_totalprice'), ('find_orders_by_o_orderdate_range', 'orders', 'range orders by o_orderdate'), ('filter_orders_by_o_orderstatus', 'orders', 'filter orders by o_orderstatus'),
    ('filter_orders_by_o_orderpriority', 'orders', 'filter orders by o_orderpriority'), ('query_customer', 'customer', 'query customer'), ('get_customer_by_c_custkey', 'customer', 'get customer by c_custkey'),
    ('find_customer_by_c_nationkey_range', 'customer', 'range customer by c_nationkey'), ('find_customer_by_c_acctbal_range', 'customer', 'range customer by c_acctbal'), ('filter_customer_by_c_name', 'customer', 'filter customer by c_name'),
    ('filter_customer_by_c_mktsegment', 'customer', 'filter customer by c_mktsegment')) v(name, entity, description)),
w AS (SELECT unnest(string_split('{words}', ' ')) AS w)
SELECT name, CAST(sum(greatest(CASE WHEN name = w THEN 100 WHEN contains(name, w) THEN 60 ELSE 0 END, CASE WHEN entity = w THEN 80 WHEN contains(entity, w) THEN 50 ELSE 0 END, CASE WHEN contains(fields, w) THEN 40 ELSE 0 END,
  CASE WHEN contains(namespace, w) THEN 30 ELSE 0 END, CASE WHEN contains(description, w) THEN 10 ELSE 0 END)) AS INTEGER) AS score FROM t, w GROUP BY name HAVING sum(greatest(CASE WHEN contains(name, w) THEN 60 ELSE 0 END, CASE WHEN contains(entity, w) THEN 50 ELSE 0 END,
  CASE WHEN contains(fields, w) THEN 40 ELSE 0 END, CASE WHEN contains(namespace, w) THEN 30 ELSE 0 END, CASE WHEN contains(description, w) THEN 10 ELSE 0 END)) > 0 ORDER BY 2 DESC, 1 LIMIT 20"""


def searched_tools(asked: str) -> Query:
    return lambda spark, sf_dir: tools.search(tools.catalogue(spark, tools.generate([catalog.ORDERS, catalog.CUSTOMER])), asked, 20).withColumn("score", col("score").cast("int"))


register("fn_19_tool_score", TOOL_SCORES.format(words="get orders"))(searched_tools("get orders"))
register("fn_19_tool_fields", TOOL_SCORES.format(words="custkey customer shop filter"))(searched_tools("Custkey, customer_shop: FILTER!"))
register("fn_19_exact_name", "SELECT 'query_orders' AS name, 100 AS score")(searched_tools(" query_orders "))

# --- change log ------------------------------------------------------------------------------------------------


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.dispatch(parsed_log(spark, sf_dir), "user_id", "seq")


@register("str_1_dispatch", f"SELECT user_id AS key, seq AS ord, deleted FROM {CHANGES}")
def dispatched(spark, sf_dir):
    return changes(spark, sf_dir).select("key", "ord", "deleted")


STATE = f"SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM {CHANGES}) WHERE rn = 1 AND NOT deleted"
register("str_2_fold", STATE)(lambda spark, sf_dir: cdc.state(changes(spark, sf_dir)))
register("str_3_versions", f"SELECT 'events' AS entity, count(DISTINCT seq // 100) AS version FROM {CHANGES}")(lambda spark, sf_dir: cdc.versions(changes(spark, sf_dir).withColumn("batch", F.floor(col("ord") / 100)), "events", "batch"))


@register("snk_2_applied", STATE)
def applied(spark, sf_dir):
    """The log in three micro-batches, the second given twice, out of order."""
    a = applier(spark)
    log = change_log(spark, sf_dir)
    for batch_id, third in enumerate((2, 0, 0, 1)):
        a.apply(log.where(col("seq") % 3 == third), min(batch_id, 1) if batch_id < 3 else 2)
    return a.current()


@register("str_8_metrics", "SELECT count(*) AS size, max(event_id) AS last, sum(CASE WHEN event_id > 500 THEN 1 ELSE 0 END) AS lag FROM events".replace("sum(CASE WHEN event_id > 500 THEN 1 ELSE 0 END)", "CAST(sum(CASE WHEN event_id > 500 THEN 1 ELSE 0 END) AS BIGINT)"))
def log_metrics(spark, sf_dir):
    m = cdc.metrics(change_log(spark, sf_dir), 500, "seq", None)
    return spark.createDataFrame([(m["size"], m["last"], m["lag"])], "size bigint, last bigint, lag bigint")


register("str_11_ttl", "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-10'")(
    lambda spark, sf_dir: cache.alive(parquet(spark, sf_dir, "events").withColumn("expires", F.expr("ts + INTERVAL 1 DAY")), "expires", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("event_id")
)
register("str_12_due", "SELECT conv_id, count(*) AS entries, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(floor(count(*) / 6) AS BIGINT) AS extractions, sum(length(coalesce(text, ''))) >= 8000 AND count(*) >= 2 AS summary_due FROM conversations GROUP BY conv_id")(
    lambda spark, sf_dir: memory.due(parquet(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
)

# --- memory and caches -----------------------------------------------------------------------------------------

register("m_1_sessions", "SELECT conv_id, len(list(turn)) AS n, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS t FROM conversations GROUP BY conv_id")(
    lambda spark, sf_dir: memory.sessions(parquet(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.size("entries").cast("long").alias("n"), F.array_join(F.transform("entries", lambda e: F.coalesce(e["content"], F.lit(""))), "|").alias("t"))
)
register("m_3_summary_split", """SELECT conv_id, turn, CASE WHEN rn = 1 OR coalesce(newer, 0) < (total * 40) // 100 THEN 'keep' ELSE 'summarise' END AS part FROM (
SELECT conv_id, turn, row_number() OVER w AS rn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer,
sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))""")(
    lambda spark, sf_dir: memory.summary_split(parquet(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "part")
)


@register("m_10_dedup", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 5 = 0 AS fresh, label FROM embeddings)
SELECT vec_id AS id FROM v a WHERE fresh AND NOT EXISTS (SELECT 1 FROM v b WHERE NOT b.fresh AND b.label = a.label AND list_cosine_similarity(a.e, b.e) >= 0.6)""")
def deduped(spark, sf_dir):
    e = parquet(spark, sf_dir, "embeddings").select(col("vec_id").alias("id"), col("label").cast("string").alias("owner"), F.sha2(col("vec_id").cast("string"), 256).alias("memory_hash"), col("embedding").cast("array<double>").alias("vector"))
    return memory.dedup(e.where("id % 5 = 0"), e.where("id % 5 != 0"), 0.6).select("id")


register("m_6_contains", "SELECT doc_id AS id, n_chars FROM documents WHERE contains(text, 'The ') ORDER BY n_chars DESC, doc_id LIMIT 25")(
    lambda spark, sf_dir: memory.contains(parquet(spark, sf_dir, "documents").select(col("doc_id").alias("id"), col("text").alias("content"), "n_chars"), "The ", "n_chars", 25).select("id", "n_chars")
)
register("m_8_owner", f"WITH tok AS (SELECT doc_id, {TOKENS} AS tk FROM documents WHERE source = 'src5'), s AS (SELECT count(*) AS n, avg(len(tk)) AS a, sum(CASE WHEN list_contains(tk, 'the') THEN 1 ELSE 0 END) AS d FROM tok), f AS (SELECT doc_id, len(tk) AS dl, CAST(len(list_filter(tk, lambda x: x = 'the')) AS DOUBLE) AS t FROM tok) SELECT doc_id AS id, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM f, s WHERE t > 0 ORDER BY ln(1 + (n - d + 0.5) / (d + 0.5)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / a)) DESC, doc_id LIMIT 10")(
    lambda spark, sf_dir: memory.search(parquet(spark, sf_dir, "documents").select(col("doc_id").alias("id"), col("text").alias("content"), col("source").alias("owner")), "the", None, "KEYWORD", "src5").select("id", F.round("score", 6).alias("score"))
)
register("c_4_evict", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")(lambda spark, sf_dir: cache.evict(parquet(spark, sf_dir, "events"), "ts", 1000, "event_id").select("event_id"))


@register("jn_9_version_fence", "SELECT o_orderkey AS entry_id, o_orderkey % 3 = 0 OR (o_orderkey % 5 != 0 AND o_orderkey % 3 = 1) AS current FROM orders")
def fenced(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    deps = F.when(col("o_orderkey") % 3 == 1, F.create_map(F.lit("customer"), F.lit(7).cast("long"), F.lit("part"), F.when(col("o_orderkey") % 5 == 0, 1).otherwise(2).cast("long"))).when(col("o_orderkey") % 3 == 2, F.create_map(F.lit("gone"), F.lit(1).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>"))
    versions = spark.createDataFrame([("customer", 7), ("part", 2)], "entity string, version bigint")
    return cache.fenced(o.select(col("o_orderkey").alias("entry_id"), deps.alias("dependencies")), versions).select("entry_id", "current")


@register("c_8_candidates", f"""WITH {bm25_sql(['the', 'clown'])},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, text FROM embeddings JOIN documents ON doc_id = vec_id),
hit AS (SELECT vec_id, list_cosine_similarity(v, q) AS c, text FROM e, {VECTOR})
SELECT vec_id AS entry_id, round(c, 4) AS cosine FROM hit WHERE c >= 0.1 AND len(regexp_extract_all(text, '\\d+')) = 0 AND vec_id IN (
  SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) AS r FROM hit) WHERE r <= 5
  UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)) DESC, id) AS r
    FROM (SELECT f.*, f.doc_id AS id, s.n, s.a, s.d0, s.d1 FROM (SELECT * FROM tfs WHERE doc_id IN (SELECT vec_id FROM e)) f,
      (SELECT count(*) AS n, avg(dl) AS a, sum(CASE WHEN t0 > 0 THEN 1 ELSE 0 END) AS d0, sum(CASE WHEN t1 > 0 THEN 1 ELSE 0 END) AS d1 FROM tfs WHERE doc_id IN (SELECT vec_id FROM e)) s WHERE t0 > 0 OR t1 > 0)) WHERE r <= 12)""")
def llm_candidates(spark, sf_dir):
    d, e = parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "embeddings")
    entries = d.join(e, d.doc_id == e.vec_id).select(col("vec_id").alias("entry_id"), col("text").alias("prompt"), col("embedding").alias("vector"))
    return cache.candidates(entries, "the clown", vector(spark, sf_dir), 0.1).select("entry_id", F.round("cosine", 4).alias("cosine"))


register("t_8_latency", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")(
    lambda spark, sf_dir: tools.latency(parquet(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))
)


@register("t_1_tools", """SELECT * FROM (VALUES ('query_nation', 'nation'), ('get_nation_by_n_nationkey', 'nation'), ('find_nation_by_n_regionkey_range', 'nation'), ('filter_nation_by_n_name', 'nation'),
('query_part', 'part'), ('get_part_by_p_partkey', 'part'), ('find_part_by_p_size_range', 'part'), ('find_part_by_p_retailprice_range', 'part'), ('filter_part_by_p_brand', 'part'), ('filter_part_by_p_type', 'part'), ('search_part_by_text', 'part')) t(name, entity)""")
def made_tools(spark, sf_dir):
    return tools.catalogue(spark, tools.generate([catalog.NATION, catalog.PART])).select("name", "entity")


@register("t_2_tool_call", "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 ORDER BY o_orderkey LIMIT 20")
def tool_call(spark, sf_dir):
    made = tools.generate([catalog.ORDERS])
    return tools.call(tools.find(made, "find_orders_by_o_totalprice_range"), {"min": 1000, "max": 20000}, lambda n: parquet(spark, sf_dir, n))


# --- retries, replay, carried columns, errors and keys -----------------------------------------------------------


def applier(spark: SparkSession, **options) -> cdc.Applier:
    """Over a folder of its own, in the shared one; only a session of this process may have none."""
    import tempfile
    import uuid

    from pyspark.sql.types import StructType

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return cdc.Applier(spark, f"{root}/applied-{uuid.uuid4().hex}", NS, "events", StructType.fromDDL(ROW), "user_id", **options)


@register("str_5_retry", """SELECT CAST(event_id AS VARCHAR) AS "msgId", '3' AS "deliveryCount", CASE WHEN event_id % 101 = 0 THEN 'broken JSON' ELSE 'refused' END AS error
FROM events WHERE event_id % 97 != 0 AND (event_id % 101 = 0 OR (event_type != 'error' AND value < 5 AND user_id % 2 = 0))""")
def retried(spark, sf_dir):
    """Changes of small values are refused; from the third batch on only those of odd users are let through."""
    seen = []
    a = applier(spark, check=lambda p: (col("op") == "d") | (col("after.value") >= 5) | ((col("after.user_id") % 2 == 1) & F.lit(len(seen) >= 2)))
    log = change_log(spark, sf_dir)
    for batch_id in range(4):
        seen.append(batch_id)
        a.apply(log.where(col("seq") % 2 == batch_id) if batch_id < 2 else log.limit(0), batch_id)
    return a.dead().select("msgId", "deliveryCount", "error")


@register("str_6_replay", "SELECT CAST(event_id AS VARCHAR) AS \"msgId\" FROM events WHERE event_id % 97 != 0 AND event_id % 101 = 0 ORDER BY event_id OFFSET 10")
def replayed(spark, sf_dir):
    """Of all broken changes, the ten oldest are mended and replayed; the others stay."""
    a = applier(spark, attempts=1)
    a.apply(change_log(spark, sf_dir), 0)
    a.replay(1, most=10, mend=lambda c: F.regexp_replace(c, r"^\{\{", "{"))
    return a.dead().select("msgId")


@register("str_6_state", STATE.replace("AND event_id % 101 != 0", "AND (event_id % 101 != 0 OR event_id <= (SELECT max(event_id) FROM (SELECT event_id FROM events WHERE event_id % 97 != 0 AND event_id % 101 = 0 ORDER BY 1 LIMIT 10)))"))
def replayed_state(spark, sf_dir):
    a = applier(spark, attempts=1)
    a.apply(change_log(spark, sf_dir), 0)
    a.replay(1, most=10, mend=lambda c: F.regexp_replace(c, r"^\{\{", "{"))
    return a.current()


@register("str_10_carried", f"SELECT user_id, coalesce(CASE WHEN c_custkey % 4 != 0 THEN c_mktsegment END, event_type) AS event_type, value FROM ({STATE}) LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 != 0")
def carried_applied(spark, sf_dir):
    """Segments of customers are carried to their events as these are applied."""
    parents = parquet(spark, sf_dir, "customer").where("c_custkey % 3 != 0").withColumn("c_mktsegment", F.when(col("c_custkey") % 4 != 0, col("c_mktsegment")))
    a = applier(spark, carried=(cdc.Carried(lambda: parents, "user_id", "c_custkey", "c_mktsegment", "event_type"),))
    a.apply(change_log(spark, sf_dir), 0)
    return a.current()


@register("str_10_spread", f"SELECT user_id, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE event_type END AS event_type, value FROM ({STATE}) LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0")
def carried_spread(spark, sf_dir):
    parents = parquet(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    a = applier(spark)
    a.apply(change_log(spark, sf_dir), 0)
    a.spread(parents, cdc.Carried(lambda: parents, "user_id", "c_custkey", "c_mktsegment", "event_type"), 1)
    return a.current()


GOVERNED = replace(catalog.SUPPLIER, tenant_field="s_nationkey")
register("jn_2_governed", """SELECT n_nationkey AS source_key, 'supplier.s_nationkey' AS relation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_nationkey = 7) AS total FROM nation""")(
    lambda spark, sf_dir: relations.relation_counts(tables(spark, sf_dir, "nation") | {"supplier": (GOVERNED, parquet(spark, sf_dir, "supplier"))}, "nation", tenant="7")
)


def code_of(ask: Callable[[], object]) -> int:
    """The error that a request ends with; 0 for none."""
    from lodestone.plans.errors import RequestError

    try:
        ask()
    except RequestError as e:
        return e.code
    return 0


@register("flt_2_errors", """SELECT * FROM (VALUES ('unknown field', 1002), ('unknown filter', 1002), ('unknown sort', 1002), ('page too large', 1003), ('range without ends', 1003), ('not a date', 1003), ('no such row', 1001), ('no tenant', 1004), ('another tenant', 1005),
('hidden filter', 1003), ('hidden sort', 1003), ('text on a tag', 1003), ('sum of a tag', 1003), ('too many groups', 1003), ('unknown policy', 1003), ('too many keys', 1003), ('hidden key', 1003), ('none', 0)) t(request, code)""")
def errors(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "orders")
    plan = lambda schema, **r: lambda: query.plan_query(schema, QueryRequest(NS, schema.entity, **r), t[schema.entity][1])
    sums = lambda **r: lambda: aggregate.plan_aggregate(catalog.ORDERS, AggregateRequest(NS, "orders", **r), t["orders"][1], tables(spark, sf_dir, "customer"))
    hidden = replace(catalog.ORDERS, tenant_field=None).with_field(FieldSchema("o_custkey", "LONG", True, related="customer", tags=frozenset({"secret"})))
    asked = {
        "unknown field": plan(catalog.ORDERS, fields=("nothing",)), "unknown filter": plan(catalog.ORDERS, filters={"nothing": 1}), "unknown sort": plan(catalog.ORDERS, sort_field="nothing"),
        "page too large": lambda: QueryRequest(NS, "orders", page_size=201), "range without ends": lambda: RangeFilter("o_totalprice"), "not a date": lambda: plan(catalog.ORDERS, ranges=(RangeFilter("o_orderdate", "soon"),))(),
        "no such row": lambda: query.lookup(catalog.ORDERS, QueryRequest(NS, "orders", {"o_orderkey": -1}), t["orders"][1]),
        "no tenant": plan(TENANT), "another tenant": plan(TENANT, tenant="BUILDING", filters={"c_mktsegment": "MACHINERY"}),
        "hidden filter": plan(MASKED, filters={"c_acctbal": 1}, tags=frozenset({"x"})), "hidden sort": plan(MASKED, sort_field="c_acctbal", tags=frozenset({"x"})), "text on a tag": plan(catalog.CUSTOMER, text={"c_name": "x"}),
        "sum of a tag": sums(metrics=(("sum", "o_orderstatus"),)), "too many groups": lambda: AggregateRequest(NS, "orders", ("o_custkey",), limit=101), "unknown policy": lambda: AggregateRequest(NS, "orders", ("o_custkey",), unknown="maybe"),
        "too many keys": lambda: aggregate.check_input_groups(sums(**ROLL_UP)(), 3), "hidden key": lambda: relations.forward({"orders": (hidden, t["orders"][1]), "customer": t["customer"]}, "orders", "o_custkey"), "none": plan(catalog.ORDERS),
    }
    return spark.createDataFrame([(k, code_of(f)) for k, f in asked.items()], "request string, code int")


@register("flt_14_pushable", "SELECT * FROM (VALUES ('c_name', 'x', true), ('c_acctbal', '1.5', true), ('c_acctbal', 'x', false), ('nothing', '1', false), ('props', 'x', false), ('c_name', '[x, y]', true), ('c_acctbal', '[1, 2]', false), ('c_name', '[]', false)) t(field, value, pushable)")
def pushables(spark, sf_dir):
    from lodestone.operators.filters import pushable

    find = lambda f: catalog.EVENTS.find(f) if f == "props" else catalog.CUSTOMER.find(f)
    asked = [("c_name", "x"), ("c_acctbal", "1.5"), ("c_acctbal", "x"), ("nothing", "1"), ("props", "x"), ("c_name", ["x", "y"]), ("c_acctbal", [1, 2]), ("c_name", [])]
    shown = lambda v: f"[{', '.join(map(str, v))}]" if isinstance(v, list) else v
    return spark.createDataFrame([(f, shown(v), pushable(find(f), v)) for f, v in asked], "field string, value string, pushable boolean")


@register("fn_13_instants", """SELECT * FROM (VALUES ('2024-01-03', false, epoch_ms(TIMESTAMP '2024-01-03')), ('2024-01-03', true, epoch_ms(TIMESTAMP '2024-01-03 23:59:59.999')), ('2024-01-03T12:00:00+08:00', false, epoch_ms(TIMESTAMP '2024-01-03 04:00:00')),
('2024-01-03T12:00:00', true, epoch_ms(TIMESTAMP '2024-01-03 12:00:00')), ('2024-02-29T00:00:00Z', false, epoch_ms(TIMESTAMP '2024-02-29')), ('1700000000000', false, CAST(1700000000000 AS BIGINT))) t(literal, upper_end, millis)""")
def instants(spark, sf_dir):
    from lodestone.plans.requests import to_epoch_ms

    asked = [("2024-01-03", False), ("2024-01-03", True), ("2024-01-03T12:00:00+08:00", False), ("2024-01-03T12:00:00", True), ("2024-02-29T00:00:00Z", False), ("1700000000000", False)]
    return spark.createDataFrame([(t, up, int(to_epoch_ms(t, up))) for t, up in asked], "literal string, upper_end boolean, millis bigint")


@register("fn_12_canonical", "SELECT * FROM (VALUES ('order of filters', true), ('order of values', true), ('case of words', false), ('page', false), ('meaning', true), ('exact', false)) t(difference, same)")
def canonicals(spark, sf_dir):
    from lodestone.plans.requests import canonical

    r = lambda **more: QueryRequest(NS, "orders", **more)
    key = lambda q, **more: canonical(q, catalog.ORDERS, **more)
    pairs = {
        "order of filters": (key(r(filters={"o_custkey": 1, "o_orderstatus": "F"})), key(r(filters={"o_orderstatus": "F", "o_custkey": 1}))),
        "order of values": (key(r(filters={"o_custkey": [1, 2]})), key(r(filters={"o_custkey": [2, 1]}))),
        "case of words": (key(r(filters={"o_orderstatus": "F"})), key(r(filters={"o_orderstatus": "f"}))),
        "page": (key(r(page=1)), key(r(page=2))),
        "meaning": (key(r(filters={"o_orderstatus": "F"}), semantic=True), key(r(filters={"o_orderstatus": "O"}), semantic=True)),
        "exact": (key(r(filters={"o_orderstatus": "F"})), key(r(filters={"o_orderstatus": "O"}))),
    }
    return spark.createDataFrame([(k, a == b) for k, (a, b) in pairs.items()], "difference string, same boolean")


@register("c_1_exact_cache", "SELECT * FROM (VALUES ('first', 1), ('again', 1), ('other order', 1), ('fresh', 2), ('after fresh', 2), ('expired', 3), ('fresh word', 4), ('dropped', 5)) t(step, runs)")
def exact_cache(spark, sf_dir):
    now, runs, out = [0.0], [], []
    c = cache.ExactCache(clock=lambda: now[0])
    ask = lambda fresh=False, **filters: c.through(QueryRequest(NS, "orders", filters, fresh=fresh), lambda q: runs.append(q) or [len(runs)])
    for step, do in {
        "first": lambda: ask(a=1, b=2), "again": lambda: ask(a=1, b=2), "other order": lambda: ask(b=2, a=1), "fresh": lambda: ask(True, a=1, b=2), "after fresh": lambda: ask(a=1, b=2),
        "expired": lambda: (now.__setitem__(0, 61.0), ask(a=1, b=2)), "fresh word": lambda: ask(a="最新"), "dropped": lambda: (c.invalidate("orders"), ask(a=1, b=2)),
    }.items():
        do()
        out.append((step, len(runs)))
    return spark.createDataFrame(out, "step string, runs int")


@register("c_2_semantic_cache", "SELECT * FROM (VALUES ('same words', true), ('other hard part', false), ('no string', false), ('far', false), ('reindexed', true), ('dropped', false)) t(step, hit)")
def semantic_cache(spark, sf_dir):
    c = cache.SemanticCache(embed=lambda s: tx.embed_tokens(s.lower().split()), clock=lambda: 0.0)
    r = lambda **filters: QueryRequest(NS, "customer", filters)
    got = lambda **filters: c.get(r(**filters), catalog.CUSTOMER) is not None
    c.put(r(c_name="big red customer", c_nationkey=3), catalog.CUSTOMER, [{"c_custkey": 1}])
    out = [("same words", got(c_name="Big red customer", c_nationkey=3)), ("other hard part", got(c_name="big red customer", c_nationkey=4)), ("no string", got(c_nationkey=3)), ("far", got(c_name="tiny blue one", c_nationkey=3))]
    c.fingerprint = "next"
    assert not got(c_name="big red customer", c_nationkey=3) and c.reindex() == {"scanned": 1, "skipped": 0, "migrated": 1, "failed": 0}
    out.append(("reindexed", got(c_name="big red customer", c_nationkey=3)))
    assert c.invalidate("customer") == 1
    out.append(("dropped", got(c_name="big red customer", c_nationkey=3)))
    return spark.createDataFrame(out, "step string, hit boolean")


@register("lim_3_trim", "SELECT * FROM (VALUES (10, 10, false), (80, 50, true), (0, 0, false)) t(given, shown, told)")
def trimmed(spark, sf_dir):
    rows = [r.asDict() for r in parquet(spark, sf_dir, "nation").orderBy("n_nationkey").limit(10).collect()] * 8
    out = [(n, len(kept), told is not None) for n in (10, 80, 0) for kept, told in [query.trim(rows[:n])]]
    return spark.createDataFrame(out, "given int, shown int, told boolean")


register("m_5_semantic", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, {VECTOR} WHERE label = 2 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")(
    lambda spark, sf_dir: memory.search(parquet(spark, sf_dir, "embeddings").select(col("vec_id").alias("id"), F.lit("").alias("content"), col("label").cast("string").alias("owner"), col("embedding").alias("vector")), "x", vector(spark, sf_dir), "SEMANTIC", "2").select("id", F.round("score", 4).alias("score"))
)

WRITES = """(SELECT conv_id, turn, text, CASE WHEN turn = 0 AND conv_id % 9 = 0 THEN 'clear' ELSE 'append' END AS op, CAST(turn AS BIGINT) AS moment FROM conversations
UNION ALL SELECT conv_id, turn, 'edited', 'edit', turn + 1000 FROM conversations WHERE turn % 4 = 1
UNION ALL SELECT conv_id, turn, NULL, 'delete', turn + 2000 FROM conversations WHERE turn % 5 = 2
UNION ALL SELECT conv_id, 0, NULL, 'clear', 3000 FROM conversations WHERE conv_id % 11 = 3 AND turn = 0)"""


@register("m_1_writes", f"""WITH w AS {WRITES}, c AS (SELECT conv_id, max(moment) FILTER (op = 'clear') AS cleared FROM w GROUP BY conv_id), live AS (SELECT w.* FROM w JOIN c USING (conv_id) WHERE op != 'clear' AND (cleared IS NULL OR moment > cleared))
SELECT conv_id, turn, arg_max(coalesce(text, '-'), moment) AS text FROM live GROUP BY conv_id, turn HAVING bool_or(op = 'append') AND NOT bool_or(op = 'delete')""")
def memory_writes(spark, sf_dir):
    c = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    write = lambda df, op, at, text=None: df.select("conv_id", "turn", (col("text") if text is None else text).alias("text"), op.alias("op"), at.cast("long").alias("at"))
    none = F.lit(None).cast("string")
    log = write(c, F.when((col("turn") == 0) & (col("conv_id") % 9 == 0), "clear").otherwise("append"), col("turn"))
    log = log.unionByName(write(c.where("turn % 4 = 1"), F.lit("edit"), col("turn") + 1000, F.lit("edited"))).unionByName(write(c.where("turn % 5 = 2"), F.lit("delete"), col("turn") + 2000, none))
    log = log.unionByName(write(c.where("conv_id % 11 = 3 and turn = 0"), F.lit("clear"), F.lit(3000), none))
    return memory.written(log, "conv_id", "turn", "text", "op", "at").withColumn("text", F.coalesce("text", F.lit("-")))


register("m_4_forget", "SELECT doc_id AS id, source AS owner FROM documents WHERE NOT (doc_id % 3 = 0 AND source = 'src5')")(
    lambda spark, sf_dir: memory.forget(parquet(spark, sf_dir, "documents").select(col("doc_id").alias("id"), col("source").alias("owner")), parquet(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id"), "src5")
)
register("m_9_extract", r"""SELECT conv_id, fact FROM (SELECT DISTINCT conv_id, trim(unnest(string_split(string_agg(replace(coalesce(text, ''), chr(10), ' '), '|' ORDER BY turn), '|'))) AS fact FROM conversations GROUP BY conv_id) WHERE fact != ''""")(
    lambda spark, sf_dir: memory.extract(
        parquet(spark, sf_dir, "conversations").withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\n", " ")), "conv_id", "turn", "text", lambda t: F.filter(F.transform(F.split(t, r"\n"), F.trim), lambda x: x != "")
    )
)


@register("c_9_store", """WITH old AS (SELECT event_id AS entry_id, 'p' || event_id AS prompt, event_type AS response, ts + INTERVAL 1 DAY AS expires FROM events WHERE event_id % 2 = 0),
new AS (SELECT 100000000 + event_id AS entry_id, 'p' || event_id AS prompt, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'new' END AS response, ts + INTERVAL 2 DAY AS expires FROM events WHERE event_id % 3 = 0),
fits AS (SELECT * FROM new WHERE response != ''), kept AS (SELECT * FROM old WHERE prompt NOT IN (SELECT prompt FROM fits) UNION ALL SELECT * FROM fits)
SELECT entry_id, prompt, response FROM kept WHERE expires > TIMESTAMP '2024-01-10' ORDER BY expires DESC, entry_id DESC LIMIT 1000""")
def cache_store(spark, sf_dir):
    e = parquet(spark, sf_dir, "events")
    made = lambda df, first, response, days: df.select((F.lit(first) + col("event_id")).alias("entry_id"), F.concat(F.lit("p"), col("event_id").cast("string")).alias("prompt"), response.alias("response"), F.expr(f"ts + INTERVAL {days} DAY").alias("expires"))
    old = made(e.where("event_id % 2 = 0"), 0, col("event_type"), 1)
    new = made(e.where("event_id % 3 = 0"), 100_000_000, F.when(col("event_id") % 6 == 0, "").otherwise("new"), 2)
    return cache.stored(old, new, F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("entry_id", "prompt", "response")


@register("c_10_expansion", "SELECT * FROM (VALUES ('off', 'none', 0, 1), ('on-miss', 'a', 1, 1), ('on-miss', 'none', 2, 4), ('always', 'a', 3, 4), ('fails', 'none', 0, 1)) t(mode, prompt, found, asked)")
def expansion(spark, sf_dir):
    answers, out = {"a": [1], "b": [1, 2], "c": [3]}, []
    for mode, prompt, paraphrase in (("off", "none", None), ("on-miss", "a", None), ("on-miss", "none", ["b", "b", "d", "e", "c"]), ("always", "a", ["b", "c", "a", "d"]), ("fails", "none", 0)):
        asked = []

        def ask(p, asked=asked):
            asked.append(p)
            return answers.get(p, [])

        found = cache.expanded(prompt, ask, lambda p, some=paraphrase: [x for x in (some if some is not None else ["b"])], "always" if mode == "fails" else mode)
        out.append((mode, prompt, len(found), len(asked)))
    return spark.createDataFrame(out, "mode string, prompt string, found int, asked int")


def toolbox(spark: SparkSession, sf_dir: str) -> tools.Toolbox:
    return tools.Toolbox([catalog.ALL[n] for n in ("region", "nation", "customer", "orders", "supplier")], lambda n: parquet(spark, sf_dir, n), spark)


register("t_4_aggregate", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")(lambda spark, sf_dir: toolbox(spark, sf_dir).call("aggregate_entity", entity="orders", group_by=("o_orderstatus",)))
register("t_4_get", "SELECT * FROM nation WHERE n_nationkey = 4")(lambda spark, sf_dir: toolbox(spark, sf_dir).call("get_entity", entity="nation", key=4))
register("t_4_call_found", "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 ORDER BY o_orderkey LIMIT 20")(
    lambda spark, sf_dir: (b := toolbox(spark, sf_dir)).call("call_tool", name=b.call("find_tools", query="find totalprice range", limit=1).first()["name"], min=1000, max=20000)
)
register("t_4_overview", "SELECT * FROM (VALUES ('shop', 'customer', 6), ('shop', 'nation', 4), ('shop', 'orders', 7), ('shop', 'region', 3), ('shop', 'supplier', 5)) t(namespace, entity, tools)")(
    lambda spark, sf_dir: toolbox(spark, sf_dir).call("find_tools").select("namespace", "entity", col("tools").cast("int").alias("tools"))
)


@register("t_6_operators_write", "SELECT * FROM (VALUES ('none', 3001), ('reader', 3001), ('operator', 0), ('all', 0), ('unknown tool', 1001)) t(caller, code)")
def operators_write(spark, sf_dir):
    box = toolbox(spark, sf_dir)
    write = lambda tags: lambda: box.call("reload_schemas", schemas=[catalog.NATION], tags=tags)
    asked = {"none": write(None), "reader": write(frozenset({"reader"})), "operator": write(frozenset({"operator"})), "all": write(frozenset({"*"})), "unknown tool": lambda: box.call("drop_everything")}
    return spark.createDataFrame([(k, code_of(f)) for k, f in asked.items()], "caller string, code int")


# --- the flagship ----------------------------------------------------------------------------------------------


@register("flagship", """SELECT COALESCE(c.c_mktsegment, 'UNKNOWN') AS c_mktsegment, count(*) AS count, round(sum(o.o_totalprice), 2) AS sum_o_totalprice FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999' GROUP BY 1 ORDER BY 3 DESC LIMIT 10""")
def flagship(spark, sf_dir):
    schema, df = tables(spark, sf_dir, "orders")["orders"]
    request = AggregateRequest(NS, "orders", ("o_custkey->customer.c_mktsegment",), (("count",), ("sum", "o_totalprice")), ranges=(RangeFilter("o_orderdate", "1996-01-01", "1996-12-31"),), sort_by="sum_o_totalprice", limit=10)
    return aggregate.plan_aggregate(schema, request, df, tables(spark, sf_dir, "customer")).rows.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


ORACLES.update({name: sql() for name, sql in LATER.items()})
