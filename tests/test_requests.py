import pytest

from lodestone.catalog import CUSTOMER, NATION, NS, ORDERS
from lodestone.operators import cache, govern, tools
from lodestone.operators.query import trim
from lodestone.plans import errors
from lodestone.plans.requests import AggregateRequest, Metric, QueryRequest, RangeFilter, canonical, to_epoch_ms
from lodestone.plans.schema import DimensionPath, EntitySchema, FieldSchema
from lodestone.sources import registry


def code(f, *a, **k):
    with pytest.raises(errors.RequestError) as e:
        f(*a, **k)
    return e.value.code


def test_date_literals_are_utc_days():
    assert to_epoch_ms("2024-01-03") == 1704240000000
    assert to_epoch_ms("2024-01-03", True) == 1704240000000 + 86_400_000 - 1
    assert to_epoch_ms("2024-01-03T08:00:00+08:00") == 1704240000000
    assert to_epoch_ms("2024-01-03T00:00:00") == 1704240000000
    assert to_epoch_ms(5) == 5 and to_epoch_ms("7") == 7
    assert code(to_epoch_ms, "soon") == errors.INVALID


def test_request_limits():
    assert code(QueryRequest, "", "orders") == errors.INVALID
    assert code(QueryRequest, NS, "orders", page_size=201) == errors.INVALID
    assert code(QueryRequest, NS, "orders", {"a": list(range(201))}) == errors.INVALID
    assert code(RangeFilter, "a") == errors.INVALID
    assert code(RangeFilter, "a", 2, 1) == errors.INVALID
    assert code(AggregateRequest, NS, "orders", limit=101) == errors.INVALID
    assert code(AggregateRequest, NS, "orders", ("a->b.c", "d")) == errors.INVALID
    assert code(Metric, "median", "a") == errors.INVALID
    assert code(DimensionPath.parse, "a->b") == errors.INVALID
    assert QueryRequest(NS, "orders", page=-3).page == 1
    assert AggregateRequest(NS, "orders", limit=0).limit == 20
    assert AggregateRequest(NS, "orders").metrics == (Metric("count"),)


def test_schema_invariants():
    assert code(EntitySchema, NS, "x", "id", (FieldSchema("id", "LONG"),)) == errors.INVALID
    assert code(EntitySchema, NS, "x", "id", (FieldSchema("id", "LONG", True), FieldSchema("t")), "t") == errors.INVALID
    assert FieldSchema("a", "INT", index="text").kind == "tag"
    assert FieldSchema("a", "INT", index="odd", indexed=True).kind == "numeric"
    assert code(ORDERS.need, "nothing") == errors.UNKNOWN_FIELD


def test_canonical_keys_ignore_order():
    a = QueryRequest(NS, "orders", {"o_orderstatus": ["F", "O"], "o_custkey": 1})
    b = QueryRequest(NS, "orders", {"o_custkey": 1, "o_orderstatus": ["O", "F"]})
    assert canonical(a) == canonical(b) and cache.key_of(a) == cache.key_of(b)
    assert canonical(a) != canonical(QueryRequest(NS, "orders", {"o_custkey": 2, "o_orderstatus": ["O", "F"]}))


def test_tenants_fail_closed():
    from dataclasses import replace

    t = replace(CUSTOMER, tenant_field="c_mktsegment")
    assert code(govern.tenant_scope, t, None, {}) == errors.TENANT_REQUIRED
    assert code(govern.tenant_scope, t, "A", {"c_mktsegment": "B"}) == errors.TENANT_MISMATCH
    masked = CUSTOMER.with_field(FieldSchema("c_acctbal", "DOUBLE", True, tags=frozenset({"x"})))
    assert code(govern.guard, masked, None, "c_acctbal") == errors.INVALID
    assert "c_acctbal" not in masked.visible(frozenset({"y"})) and "c_acctbal" in masked.visible(frozenset({"*"}))


def test_trim_really_cuts():
    rows, note = trim([{"a": "x" * 1000}] * 60, 60)
    assert len(rows) < 40 and note
    assert trim([{"a": 1}], 1) == ([{"a": 1}], None)


def test_caches():
    now = [0.0]
    c = cache.ExactCache(clock=lambda: now[0], capacity=2)
    asked = []
    r = QueryRequest(NS, "orders")
    assert c.through(r, lambda q: asked.append(q) or [1]) == [1] and c.through(r, lambda q: asked.append(q) or [2]) == [1]
    assert c.through(QueryRequest(NS, "orders", fresh=True), lambda q: [3]) == [3] and len(asked) == 1
    assert c.through(r, lambda q: [4]) == [3]
    now[0] = 61
    assert c.get(cache.key_of(r)) is None
    c.put("orders:a", 1), c.put("orders:b", 2), c.put("orders:c", 3)
    assert len(c.entries) == 2 and c.invalidate("orders") == 2
    s = cache.SemanticCache(lambda t: [float(len(t)), 1.0], threshold=0.9)
    q = QueryRequest(NS, "customer", {"c_mktsegment": "BUILDING"})
    assert s.put(q, CUSTOMER, [1]) and s.get(QueryRequest(NS, "customer", {"c_mktsegment": "MACHINES"}), CUSTOMER) == [1]
    assert s.get(QueryRequest(NS, "customer", {"c_mktsegment": "BUILDING", "c_custkey": 1}), CUSTOMER) is None
    assert not s.put(q, CUSTOMER, []) and s.get(QueryRequest(NS, "customer"), CUSTOMER) is None


def test_registry(tmp_path):
    reg = registry.Registry({(NS, "nation"): NATION}, str(tmp_path))
    (tmp_path / "bad.yml").write_text("entity: [")
    assert not reg.poll() and reg.errors and reg.get(NS, "nation") == NATION
    (tmp_path / "bad.yml").unlink()
    reg.write(CUSTOMER)
    assert reg.get(NS, "customer") == CUSTOMER
    assert reg.relate(NS, "customer", "c_nationkey", None).foreign_keys() == {}
    assert code(reg.get, NS, "gone") == errors.NOT_FOUND


def test_tool_names_are_unique():
    made = tools.generate([NATION, EntitySchema("other", "nation", "n_nationkey", NATION.fields), EntitySchema("other", "nation", "n_nationkey", NATION.fields)])
    names = [t.name for t in made]
    assert len(set(names)) == len(names) and "other_query_nation" in names and "other_query_nation_2" in names
