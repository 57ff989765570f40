import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.catalog import CUSTOMER, NS, ORDERS
from lodestone.functions import text as tx
from lodestone.operators import cache, memory
from lodestone.operators.aggregate import check_input_groups, plan_aggregate
from lodestone.operators.query import lookup, plan_query
from lodestone.plans.errors import RequestError
from lodestone.plans.requests import AggregateRequest, QueryRequest
from lodestone.streaming import cdc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_pages_make_the_whole(spark, orders):
    rows = []
    for page in range(1, 9):
        rows += plan_query(ORDERS, QueryRequest(NS, "orders", page=page, page_size=200, sort_field="o_totalprice"), orders).page.collect()
    assert rows == orders.orderBy(F.asc_nulls_last("o_totalprice"), "o_orderkey").limit(1600).collect()


def test_lookup_of_nothing_is_an_error(orders):
    with pytest.raises(RequestError) as e:
        lookup(ORDERS, QueryRequest(NS, "orders", {"o_orderkey": -5}), orders)
    assert e.value.code == 1001


def test_roll_up_is_group_after_join(spark, orders):
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    request = AggregateRequest(NS, "orders", ("o_custkey->customer.c_mktsegment",), (("count",), ("avg", "o_totalprice")))
    got = plan_aggregate(ORDERS, request, orders, {"customer": (CUSTOMER, customer)})
    want = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)), F.avg("o_totalprice"))
    rounded = lambda df: sorted((a, b, round(c, 4)) for a, b, c in df.collect())
    assert rounded(got.rows) == rounded(want)
    with pytest.raises(RequestError):
        check_input_groups(got, 3)


def test_filters_reach_the_scan(orders):
    plan = plan_query(ORDERS, QueryRequest(NS, "orders", {"o_orderkey": 5}, fields=("o_orderkey",)), orders).page
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,5)" in text


def test_wide_characters_go_by_pairs(spark):
    row = spark.createDataFrame([(" Ab1 日本語 x",), (None,)], "s string").select(tx.lex_tokens(F.col("s")).alias("t")).collect()
    assert row[0]["t"] == ["ab1", "日本", "本語", "x"] and row[1]["t"] == []
    assert tx.java_hash("ab") == 3105 and tx.java_hash("") == 0


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def log(spark, *bodies, first=0):
    return spark.createDataFrame([(first + i, b) for i, b in enumerate(bodies)], "seq bigint, body string")


def put(op, i, v):
    row = f'{{"id":{i},"v":"{v}"}}'
    return f'{{"op":"{op}","{"before" if op == "d" else "after"}":{row}}}'


def test_applier(spark, tmp_path):
    a = cdc.Applier(spark, f"file://{tmp_path}", NS, "t", ROW, "id", attempts=1)
    a.apply(log(spark, put("c", 1, "a"), put("c", 2, "b"), "", "{broken", '{"op":"u"}', put("x", 9, "z")), 0)
    a.apply(log(spark, put("u", 1, "c"), put("d", 2, ""), first=10), 1)
    a.apply(log(spark, put("u", 1, "late"), first=5), 2)
    a.apply(log(spark, put("u", 1, "again"), first=90), 2)  # a batch that was done already
    assert [tuple(r) for r in a.current().collect()] == [(1, "c")]
    assert a.version() == 3 and a.dead().count() == 1
    assert a.replay(3, mend=lambda c: F.lit(put("c", 7, "mended"))) == 1
    assert sorted(tuple(r) for r in a.current().collect()) == [(1, "c"), (7, "mended")]


def test_replay_keeps_all_other_letters(spark, tmp_path, monkeypatch):
    a = cdc.Applier(spark, f"file://{tmp_path}", NS, "t", ROW, "id", attempts=1)
    a.apply(spark.range(100_250).select(F.col("id").alias("seq"), F.lit("{broken").alias("body")), 0)
    a.apply(log(spark, "{twin", "{twin").withColumn("seq", F.lit(7)), 1)
    mend = lambda c: F.lit(put("c", 7, "mended"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(a, "apply", lambda *_: (_ for _ in ()).throw(RuntimeError))
        a.replay(2, mend=mend)
    assert a.dead().count() == 100_252
    # three letters share a number; one replay takes two of them
    assert a.replay(2, most=9, mend=mend) == 9 and a.dead().count() == 100_243
    assert a.replay(2, mend=mend) == 0 and a.dead().count() == 100_243
    assert a.replay(3) == 100 and a.dead().count() == 100_243
    assert sorted(int(r["msgId"]) for r in a.dead().collect()) == [7, *range(8, 100_250)]
    assert [tuple(r) for r in a.current().collect()] == [(7, "mended")]
    assert a.replay(4, most=10**6, mend=mend) == 100_243 and a.dead() is None


def test_failures_are_tried_again(spark, tmp_path):
    """A row whose parent hasn't arrived is applied once it has; a broken body is dead after three tries, with its cause."""
    parents = []
    known = lambda: spark.createDataFrame([(p,) for p in parents], "v string")
    here = lambda parsed: (F.col("op") == "d") | F.col("after.v").isin([*parents, "-"])
    a = cdc.Applier(spark, f"file://{tmp_path}", NS, "t", ROW, "id", check=here)
    parents.append("p")
    a.apply(log(spark, put("c", 1, "p"), put("c", 2, "q"), put("c", 3, "never"), "{broken"), 0)
    assert [tuple(r) for r in a.current().collect()] == [(1, "p")] and a.dead() is None and a.pending().count() == 3
    parents.append("q")
    a.apply(log(spark, put("c", 4, "p"), first=10), 1)
    assert sorted(tuple(r) for r in a.current().collect()) == [(1, "p"), (2, "q"), (4, "p")] and a.dead() is None
    a.apply(log(spark, first=20), 2)
    a.apply(log(spark, first=20), 3)
    assert sorted((r["msgId"], r["deliveryCount"], r["error"]) for r in a.dead().collect()) == [("2", "3", "refused"), ("3", "3", "broken JSON")]
    assert a.pending().count() == 0 and known().count() == 2 and a.done() == [0, 1, 2, 3]


def test_carried_columns_are_applied_and_spread(spark, tmp_path):
    rows = T.StructType([T.StructField("id", T.LongType()), T.StructField("fk", T.LongType()), T.StructField("name", T.StringType())])
    of = {1: "one", 2: None}
    carried = cdc.Carried(lambda: spark.createDataFrame(list(of.items()), "pk bigint, label string"), "fk", "pk", "label", "name")
    a = cdc.Applier(spark, f"file://{tmp_path}", NS, "t", rows, "id", carried=(carried,))
    child = lambda i, fk, name: f'{{"op":"c","after":{{"id":{i},"fk":{fk},"name":"{name}"}}}}'
    a.apply(log(spark, child(10, 1, "own"), child(11, 2, "own"), child(12, 9, "own"), child(13, "null", "own")), 0)
    assert {r["id"]: r["name"] for r in a.current().collect()} == {10: "one", 11: "own", 12: "own", 13: "own"}
    a.spread(spark.createDataFrame([(1, None), (9, "nine")], "pk bigint, label string"), carried, 1)
    assert {r["id"]: r["name"] for r in a.current().collect()} == {10: None, 11: "own", 12: "nine", 13: "own"} and a.version() == 2


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_instants_without_a_zone_are_in_utc(spark, zone):
    """In any session: filters of days, and milliseconds."""
    from lodestone.catalog import EVENTS
    from lodestone.plans.requests import RangeFilter

    events = spark.read.parquet(f"{SF}/events.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        ask = QueryRequest(NS, "events", ranges=(RangeFilter("ts", "2024-01-03", "2024-01-05"),))
        got = plan_query(EVENTS, ask, events).matched
        assert got.count() == events.where("ts >= timestamp_ntz'2024-01-03' and ts < timestamp_ntz'2024-01-06'").count() > 0
        assert "timestamp" not in {t for _, t in events.dtypes} and "ts" in str(got._jdf.queryExecution().executedPlan())
        one = events.select(tx.normalize_scalar(F.lit(None).cast("timestamp_ntz"), "timestamp_ntz").alias("n"), tx.normalize_scalar(F.expr("timestamp_ntz'2024-03-10 02:30:01.250'"), "timestamp_ntz").alias("t")).first()
        assert (one["n"], one["t"]) == (None, "1710037801250")
        old = events.select(tx.normalize_scalar(F.expr("timestamp_ntz'1969-12-31 23:59:59.500'"), "timestamp_ntz").alias("t")).first()
        assert old["t"] == "-500"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_values_are_equal_as_numbers_only_if_they_are(spark):
    pairs = [("1", "1.00", True), ("0.12345678901", "0.12345678902", False), ("9007199254740993", "9007199254740992", False), ("1e3", "1000", True), ("a", "a", True), ("a", "1", False), (None, None, True), (None, "1", False), ("1e-30", "2e-30", False)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(tx.values_equal(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["e"] for r in got] == [p[2] for p in pairs]


def test_counts_of_relations_are_governed(spark):
    from dataclasses import replace

    from lodestone.catalog import NATION, SUPPLIER
    from lodestone.operators import relations
    from lodestone.plans.schema import FieldSchema

    nation, supplier = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("nation", "supplier"))
    tenant = {"nation": (NATION, nation), "supplier": (replace(SUPPLIER, tenant_field="s_name"), supplier)}
    with pytest.raises(RequestError):
        relations.relation_counts(tenant, "nation")
    name = supplier.first()["s_name"]
    counted = relations.relation_counts(tenant, "nation", tenant=name).agg(F.sum("total")).first()[0]
    assert counted == supplier.where(F.col("s_name") == name).count()
    hidden = SUPPLIER.with_field(FieldSchema("s_nationkey", "INT", True, related="nation", tags=frozenset({"secret"})))
    for ask in (lambda t: relations.relation_counts(t, "nation"), lambda t: relations.reverse(t, "nation", "supplier", "s_nationkey"), lambda t: relations.forward(t, "supplier", "s_nationkey")):
        with pytest.raises(RequestError):
            ask({"nation": (NATION, nation), "supplier": (hidden, supplier)})


def test_embeddings_in_the_jvm_are_those_of_the_column(spark):
    texts = spark.createDataFrame([(1, "Ab 12 ab"), (2, "日本 x"), (3, "é"), (4, " "), (5, None), (6, "a,b\nc")], "id int, t string")
    wide = {(r["id"], s): round(x, 9) for r in texts.select("id", tx.bm25_embed(F.col("t")).alias("v")).collect() for s, x in enumerate(r["v"]) if x}
    assert wide == {(r["id"], r["slot"]): round(r["x"], 9) for r in tx.bm25_entries(texts, "id", "t").collect()}
    assert texts.where("id = 1").select(tx.embed_terms(F.col("t")).alias("t")).first()["t"] == ["ab", "12", "ab", " 1", " a"]
    assert texts.where("id = 2").select(tx.embed_terms(F.col("t")).alias("t")).first()["t"] == ["x", "日本", "本 ", " x"]


def test_keys_are_inferred_from_names(spark):
    from lodestone.sources import registry

    made = {n: spark.createDataFrame([], f"id bigint, {c} bigint") for n, c in {"shop_order": "member_id", "crm_member": "id2", "old_crm_member": "order_id", "member_level": "shop_order_id"}.items()}
    got = registry.infer_keys(made, {n: "id" for n in made}, {("crm_member", "id2"): "member_level"})
    assert got == [("crm_member", "id2", "member_level", "explicit"), ("member_level", "shop_order_id", "shop_order", "high"), ("old_crm_member", "order_id", "shop_order", "high"), ("shop_order", "member_id", "crm_member", "low")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [put("c", i % 5, f"v{i}") if i % 7 else put("d", i % 5, "") for i in range(40)]
    for k in range(3):
        log(spark, *rows).where(F.col("seq") % 3 == k).write.mode("append").json(str(tmp_path / "in"))
    a = cdc.Applier(spark, f"file://{tmp_path}/s", NS, "t", ROW, "id")
    stream = spark.readStream.schema("seq bigint, body string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    a.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    batch = cdc.state(cdc.dispatch(cdc.parse(log(spark, *rows), ROW), "id", "seq"))
    assert sorted(map(tuple, a.current().collect())) == sorted(map(tuple, batch.collect()))


def test_llm_cache_reasons(spark):
    entries = spark.createDataFrame([(1, "orders in 2024", [1.0, 0.0], {"orders": 3}), (2, "orders in 2023", [0.9, 0.1], {"orders": 3})], "entry_id int, prompt string, vector array<double>, dependencies map<string,bigint>")
    now = lambda v: spark.createDataFrame([("orders", v)], "entity string, version bigint")
    ask = lambda p, v, **k: cache.lookup(entries, now(k.pop("version", 3)), p, v, **k)
    assert ask("orders in 2024", None)[0] == "hit"
    assert ask("orders in 2024", None, version=4)[0] == "stale"
    reason, hit = ask("orders during 2024", [1.0, 0.05])
    assert reason == "hit" and hit["entry_id"] == 1
    assert ask("orders during 2022", [1.0, 0.05])[0] == "no-match"
    assert ask("anything", None)[0] == "no-embedder" and ask("anything", [0.0, 0.0])[0] == "empty-vector"
    assert ask("今天 orders", None)[0] == "fresh-keyword" and ask("orders today", None)[0] == "no-embedder" and ask("x", None, bypass=True)[0] == "bypass"
    assert ask("orders during 2024", [1.0, 0.05], reranker=lambda a, b: 0.1)[0] == "no-match"


def test_summary_keeps_at_least_the_newest(spark):
    t = spark.createDataFrame([(1, 1, "a" * 10), (1, 2, "b" * 10), (1, 3, "c" * 100), (2, 1, None)], "s int, n int, c string")
    got = {(r["s"], r["n"]): r["part"] for r in memory.summary_split(t, "s", "n", "c").collect()}
    assert got == {(1, 1): "summarise", (1, 2): "summarise", (1, 3): "keep", (2, 1): "keep"}


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_dedup_of_memories_is_exact_in_blocks(spark, monkeypatch):
    import random

    from lodestone.functions.vectors import cosine

    monkeypatch.setattr(memory, "BLOCK", 7)
    pick = random.Random(3)
    vec = lambda: [pick.gauss(0, 1) for _ in range(4)]
    rows = [(i, f"o{i % 3}", f"h{i if i != 5 else 6}", vec() if i % 11 else ([0.0] * 4 if i % 2 else [1.0])) for i in range(120)]
    both = spark.createDataFrame(rows, "id int, owner string, memory_hash string, vector array<double>")
    new, stored = both.where("id % 4 = 0"), both.where("id % 4 != 0")
    got = {r["id"] for r in memory.dedup(new, stored, 0.8).collect()}
    a, b = new.alias("a"), stored.alias("b")
    near = a.join(b, (F.col("a.owner") == F.col("b.owner")) & ((cosine(F.col("a.vector"), F.col("b.vector")) >= 0.8) | (F.col("a.memory_hash") == F.col("b.memory_hash")))).select("a.id").distinct()
    assert got == {r["id"] for r in new.select("id").subtract(near).collect()} and 0 < len(got) < new.count()
