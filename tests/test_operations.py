"""Deliveries, stores, caches, registries and order keys against plain Python."""

import hashlib
import hmac
import struct

import pytest
from docweave import operations
from docweave.functions import cel
from docweave.model import AlreadyExists, Filter, IndexNotReady, InvalidQuery, NotFound, Order, Query
from docweave.operators import analytics, databases, delivery, rules, writes
from docweave.plans import indexes
from docweave.sources import tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["k", "x" * 64, "é" * 50])
def test_signatures(spark, key):
    bodies = ["", "a", '{"é": 1}', "x" * 500]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    found = {r.i: r.h for r in rows.select("i", delivery.hmac_sha256(key, F.col("body")).alias("h")).collect()}
    assert found == {i: hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest() for i, b in enumerate(bodies)}


def test_webhook_headers(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "id int, secret_ref string")
    found = {r.id: r for r in delivery.webhook_requests(tasks, F.lit("{}"), F.lit(5), {"a": "s"}).collect()}
    assert found[1].headers["X-Signature"] == "t=5,v1=" + hmac.new(b"s", b"5.{}", hashlib.sha256).hexdigest()
    assert all("X-Signature" not in found[i].headers for i in (2, 3, 4)) and [found[i].fault for i in (1, 2, 3, 4)] == [None, None, None, "unknown_secret"]


def test_fnv(spark):
    def plain(b):
        h = delivery.FNV_BASIS
        for x in b:
            h = (h ^ x) * delivery.FNV_PRIME % 2**32
        return h

    texts = ["", "a", "foobar", "é漢🙂", "users7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in rows.select("t", delivery.fnv32a(F.col("t")).alias("h")).collect()} == {t: plain(t.encode()) for t in texts}
    assert plain(b"a") == 0xE40C292C


def test_order_keys(spark):
    def plain(v, desc):
        if v is None:
            b = b"\0"
        elif isinstance(v, bool):
            b = bytes([1, v])
        elif isinstance(v, float):
            n = struct.unpack(">Q", struct.pack(">d", v + 0.0))[0]
            b = b"\2" + struct.pack(">Q", n ^ (1 << 63) if v >= 0 else ~n & (2**64 - 1))
        else:
            b = b"\3" + v.encode().replace(b"\0", b"\0\1") + b"\0\0"
        return (bytes(255 - x for x in b) if desc else b).hex().upper()

    rows = [(0, 1.5, "a", True), (1, -0.0, "a\0b", False), (2, -1e300, "", None), (3, None, None, True), (4, float("inf"), "é", False), (5, 0.0, "ab", None), (6, 1e-300, "b\0", None), (7, -2.0, "\x10\x01", None)]
    docs = spark.createDataFrame(rows, "i int, n double, s string, b boolean")
    for d in ("asc", "desc"):
        found = docs.select("i", *[indexes.memcomparable(F.col(c), k, d).alias(c) for c, k in (("n", "number"), ("s", "string"), ("b", "boolean"))]).collect()
        assert {r.i: (r.n, r.s, r.b) for r in found} == {i: tuple(plain(v, d == "desc") for v in r) for i, *r in rows}
    key = docs.select("i", indexes.order_key([(F.col("s"), "string", "asc")], F.col("i").cast("string")).alias("k")).orderBy("k").collect()
    assert [r.i for r in key] == [3, 2, 7, 0, 1, 5, 6, 4] and key[0].k == "01" + "00" + "0001" + "33"


def test_stores_keep_databases_apart(spark, tmp_path):
    store = databases.Stores(f"file://{tmp_path}")
    docs = tables.orders_docs(spark, SF)
    other = docs.withColumn("database", F.lit("b")).limit(10)
    store.write(docs.unionByName(other), "default")
    store.write(other, "b")
    assert store.read(spark, "default").count() == docs.count() and store.read(spark, "b").count() == 10
    for _ in range(3):  # a write that reads what it replaces
        store.write(store.read(spark, "default").where("not deleted"), "default")
    assert store.read(spark, "default").count() == docs.where("not deleted").count()
    assert len(store.generations(spark, f"file://{tmp_path}/default")) == 2
    store.drop(spark, "b")
    with pytest.raises(NotFound):
        store.read(spark, "b")


def test_repeated_keys_in_a_batch(spark):
    store = tables.orders_docs(spark, SF).where("doc_id in ('1', '7')")
    change = spark.createDataFrame([("default", f"orders/{k}", s, (5, "N", 1.0 * s, "-")) for k in (1, 99) for s in (1, 2, 3)], "database string, fullpath string, seq int, data struct<custkey:bigint,status:string,total:double,priority:string>")
    base = {r.doc_id: r.version for r in store.collect()}["1"]
    for verb, one, new in ((writes.create, ["exists"] * 3, ["created", "exists", "exists"]), (writes.replace, ["replaced"] * 3, ["created", "replaced", "replaced"]), (writes.delete, ["deleted", "not_found", "not_found"], ["not_found"] * 3)):
        found = verb(change, store, 9)
        status = {(r.fullpath, r.seq): r.status for r in found.collect()}
        assert [status["orders/1", s] for s in (1, 2, 3)] == one and [status["orders/99", s] for s in (1, 2, 3)] == new
        after = writes.apply(store, writes.rows_of(found.where("status in ('created', 'replaced', 'deleted')"), store))
        assert after.columns == store.columns and after.count() == after.select("fullpath").distinct().count()
        if verb is writes.replace:
            rows = {r.doc_id: r for r in after.collect()}
            assert (rows["1"].version, rows["1"].data.total, rows["99"].version, rows["99"].collection, rows["99"].created_at) == (base + 3, 3.0, 3, "orders", 9)
    two = writes.replace(change, store, 9, F.col("cur_version") == base).where("fullpath = 'orders/1'").orderBy("seq").collect()
    assert [(r.status, r.version) for r in two] == [("replaced", base + 1), ("precondition_failed", base), ("precondition_failed", base)]


def test_pushes_follow_one_another(spark):
    store = tables.orders_docs(spark, SF).where("doc_id = '1'")
    base = store.first().version
    data = (5, "N", 2.5, "-")
    rows = [(1, "update", base, data), (2, "update", base, data), (3, "delete", base + 1, None), (4, "delete", None, None), (5, "create", None, data), (6, "create", None, data)]
    changes = spark.createDataFrame([("default", "orders/1", *r) for r in rows], "database string, fullpath string, seq int, action string, base_version long, data struct<custkey:bigint,status:string,total:double,priority:string>")
    outcomes, after = writes.push_apply(changes, store, 9, "orders")
    assert [r.outcome for r in outcomes.orderBy("place").collect()] == ["update", "conflict", "delete", "noop", "create", "conflict"]
    row = after.first()
    assert after.count() == 1 and (row.version, row.deleted, row.data.total) == (1, False, 2.5)
    with pytest.raises(InvalidQuery):
        writes.push_apply(changes, store, 9, "customers")


def test_cache():
    asked = []
    rows = {"id:1": {"id": "1", "slug": "one"}, "one": {"id": "1", "slug": "one"}}

    def load(name):
        asked.append(name)
        return rows.get(name)

    c = databases.Cache(load, 100, 10, 3)
    assert c.get("one", 0)["id"] == "1" and c.get("id:1", 50)["slug"] == "one" and asked == ["one"]
    for now in (0, 5, 20):
        with pytest.raises(NotFound):
            c.get("gone", now)
    assert asked == ["one", "gone", "gone"]
    c.get("one", 100)
    c.forget(rows["one"])
    c.get("one", 101)
    assert asked[3:] == ["one", "one"] and len(c.kept) <= 3


def test_registry():
    r = rules.Registry()
    r.subscribe(rules.Subscription("a", "g", "c"))
    with pytest.raises(AlreadyExists):
        r.subscribe(rules.Subscription("a", "h", "c"))
    with pytest.raises(InvalidQuery):
        r.subscribe(rules.Subscription("b", "h", "c", (Filter("x", "~", 1),)))
    r.unsubscribe("a")
    assert r.all() == [] and r.drop_gateway("g") == 0
    with pytest.raises(NotFound):
        r.unsubscribe("a")


def test_benchmark_run(spark):
    steps = []
    tick = iter(range(1000))

    def operation(worker):
        steps.append(worker)
        if len(steps) == 3:
            raise KeyError("x")

    run = analytics.Run(operation, 1, 10, lambda: steps.append("up"), lambda: steps.append("down"), lambda: next(tick))
    out = run.run()
    assert steps[0] == "up" and steps[-1] == "down" and out["errors"] == 1 and out["operations"] == len(steps) - 2 > 3
    assert run.frame(spark).where("error = 'KeyError'").count() == 1


def test_index_states(spark):
    docs = tables.orders_docs(spark, SF)
    q = Query("orders", (Filter("status", "==", "O"),), (Order("total", "desc"),), 5)
    assert indexes.serve(docs, q, operations.SERVING, {"status_total": "healthy"}).count() == 5
    for templates, states in ((operations.SERVING, {"status_total": "rebuilding"}), ([], {})):
        with pytest.raises(IndexNotReady):
            indexes.serve(docs, q, templates, states)


def test_parsed_expressions_are_kept():
    cel.parsed.cache_clear()
    a, b = cel.parsed("doc.x > 1"), cel.parsed("doc.x > 1")
    assert a is b and cel.parsed.cache_info().hits == 1


def test_many_subscriptions(spark, monkeypatch):
    """Thousands of subscriptions of all kinds, several passes of conditions, against a plain loop."""
    monkeypatch.setattr(rules, "CONDITIONS", 50)
    events = spark.createDataFrame([("default" if i % 7 else "other", f"c{i % 3}", str(i), (i * 37 % 50,)) for i in range(60)], "database string, collection string, doc_id string, data struct<x:long>")
    subs = [rules.Subscription(f"d{i}", f"g{i % 5}", f"c{i % 4}", (Filter("id", "==", str(i % 90)),)) for i in range(2000)]
    subs += [rules.Subscription(f"a{i}", "g", f"c{i}", database="other", include_data=False) for i in range(4)]
    subs += [rules.Subscription(f"x{i}", "g", f"c{i % 4}", (Filter("x", ">", i % 90),)) for i in range(1500)]
    assert len({(s.collection, s.filters) for s in subs if s.kind() == "expression"}) > 2 * rules.CONDITIONS

    def hits(s, e):
        if (s.database, s.collection) != (e.database, e.collection):
            return False
        return s.kind() == "collection" or (e.doc_id == s.filters[0].value if s.kind() == "document" else e.data.x > s.filters[0].value)

    want = sorted((e.doc_id, s.gateway, s.id, s.include_data) for e in events.collect() for s in subs if hits(s, e))
    found = rules.match(events, subs)
    assert found.columns == [*events.columns, "gateway", "subscription_id", "include_data"]
    assert sorted(tuple(r) for r in found.select("doc_id", "gateway", "subscription_id", "include_data").collect()) == want and want
    monkeypatch.setattr(rules, "BROADCAST", 0)
    assert rules.match(events, subs[:2004]).count() == sum(s.kind() != "expression" and hits(s, e) for e in events.collect() for s in subs)
    assert rules.match(events, []).count() == 0 and rules.match(events.limit(0), subs[:3]).count() == 0


def test_token_bucket_of_one_client(spark):
    """A client with most requests, one without a name, and requests without a time."""
    from docweave.operators import analytics

    rows = [("hot" if i % 4 else None, i, i * 10 if i % 9 else None) for i in range(20_000)]
    found = analytics.token_bucket(spark.createDataFrame(rows, "k string, event_id long, at long"), "k", "at", 2.0, 0.05)
    got = {r.id: r.allowed for r in found.collect()}
    assert found.columns == ["k", "id", "ts", "allowed"]
    want = {}
    for k in ("hot", None):
        tokens, at = 2.0, None
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            tokens = min(2.0, tokens + (0 if t is None or at is None else t - at) * 0.05)
            at, want[i] = t, tokens >= 1
            tokens -= want[i]
    assert got == want and 0 < sum(got.values()) < len(rows)
